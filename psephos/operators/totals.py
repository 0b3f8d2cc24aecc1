"""Totals, shares, margins, versions and comparisons over a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.functions.pdsem import known, pct, share, sum0, tercile_by_rank, tercile_by_value
from psephos.operators.areas import party_key, party_label, scope


def overview(stations: DataFrame) -> DataFrame:
    """One row of sums and rates; a rate without a base is null."""
    row = stations.agg(
        F.count("*").alias("stations"), sum0("eligible_voters").alias("eligible_voters"), sum0("voters_present").alias("voters_present"),
        sum0("ballots_used").alias("ballots_used"), sum0("ballots_spoiled").alias("ballots_spoiled"), sum0("ballots_no_vote").alias("ballots_no_vote"),
    )
    for name, num, den in (("turnout_pct", "voters_present", "eligible_voters"), ("spoiled_pct", "ballots_spoiled", "ballots_used"), ("no_vote_pct", "ballots_no_vote", "ballots_used")):
        row = row.withColumn(name, share(F.col(num), F.col(den)))
    return row


def kpi(stations: DataFrame, candidate: DataFrame, party: DataFrame) -> DataFrame:
    """Stations as rows, voters, turnout (0 without eligible voters) and votes of both kinds."""
    s = stations.agg(F.count("*").alias("stations"), sum0("eligible_voters").alias("eligible_voters"), sum0("voters_present").alias("voters_present"))
    s = s.withColumn("turnout_pct", pct(F.col("voters_present"), F.col("eligible_voters"), 0.0))
    return s.crossJoin(candidate.agg(sum0("votes").alias("candidate_votes"))).crossJoin(party.agg(sum0("votes").alias("party_votes")))


def turnout_by(stations: DataFrame, column: str = "subdistrict") -> DataFrame:
    by = known(stations, column).groupBy(column).agg(sum0("eligible_voters").alias("eligible_voters"), sum0("voters_present").alias("voters_present"))
    return by.withColumn("turnout_pct", share(F.col("voters_present"), F.col("eligible_voters")))


def ballot_composition(stations: DataFrame) -> DataFrame:
    """Good, spoiled and no-vote ballots as three rows."""
    sums = stations.agg(sum0("ballots_good").alias("Good"), sum0("ballots_spoiled").alias("Spoiled"), sum0("ballots_no_vote").alias("No vote"))
    return sums.unpivot([], ["Good", "Spoiled", "No vote"], "ballot", "ballots")


def totals(votes: DataFrame, by: str = "entity_name") -> DataFrame:
    """Votes and share of each entity; all entities are the base of the share."""
    grouped = known(votes, by).groupBy(by).agg(sum0("votes").alias("votes"))
    total = grouped.agg(sum0("votes").alias("_t"))
    return grouped.crossJoin(F.broadcast(total)).withColumn("share_pct", pct(F.col("votes"), F.col("_t"), 0.0)).drop("_t")


def top(df: DataFrame, n: int, column: str, key: str) -> DataFrame:
    """The n largest, nulls last, ties by key."""
    return df.orderBy(F.desc_nulls_last(column), F.asc_nulls_last(key)).limit(n)


def top_changes(df: DataFrame, n: int, change: str, then: str, key: str) -> DataFrame:
    """The n largest changes either way, in the order of another column."""
    return df.orderBy(F.desc_nulls_last(F.abs(change)), key).limit(n).orderBy(then, key)


def winning_margin(votes: DataFrame, stations: DataFrame, narrow: float = 5.0) -> DataFrame:
    """First and second candidate, and the margin in percent of the voters present."""
    two = top(known(votes, "entity_name").groupBy("entity_name").agg(sum0("votes").alias("votes")), 2, "votes", "entity_name")
    ranked = two.agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("o"), F.col("entity_name").alias("e"), F.col("votes").alias("v")))).alias("r")).where(F.size("r") >= 2)
    out = ranked.select(F.col("r")[0]["e"].alias("winner"), F.col("r")[0]["v"].alias("winner_votes"), F.col("r")[1]["e"].alias("runner_up"), F.col("r")[1]["v"].alias("runner_up_votes"))
    out = out.withColumn("margin_votes", F.col("winner_votes") - F.col("runner_up_votes")).crossJoin(stations.agg(sum0("voters_present").alias("_p")))
    out = out.withColumn("margin_pct", share(F.col("margin_votes"), F.col("_p"))).drop("_p")
    return out.withColumn("narrow", F.col("margin_pct") < narrow)


def margin_by_version(versions: dict[str, DataFrame]) -> DataFrame:
    """The two largest of each version's totals, and the margin in percent of its total votes."""
    every: DataFrame | None = None
    for name, votes in versions.items():
        one = known(votes, "entity_name").groupBy("entity_name").agg(sum0("votes").alias("votes")).withColumn("version", F.lit(name))
        every = one if every is None else every.unionByName(one)
    r = F.row_number().over(Window.partitionBy("version").orderBy(F.desc("votes"), "entity_name"))
    picks = [F.max(F.when(F.col("_r") == i, F.col(c))).alias(a) for i, c, a in ((1, "entity_name", "winner"), (1, "votes", "winner_votes"), (2, "votes", "runner_up_votes"))]
    out = every.withColumn("_r", r).groupBy("version").agg(sum0("votes").alias("total_votes"), *picks).fillna(0, subset=["runner_up_votes"])
    return out.withColumn("margin_votes", F.col("winner_votes") - F.col("runner_up_votes")).withColumn("margin_pct", pct(F.col("margin_votes"), F.col("total_votes")))


def split_ticket(candidate: DataFrame, party: DataFrame) -> DataFrame:
    """Candidates' and party votes of each party, the gap and the sum."""
    a = known(candidate, "party_name").groupBy(F.col("party_name").alias("party")).agg(sum0("votes").alias("candidate_votes"))
    b = known(party, "entity_name").groupBy(F.col("entity_name").alias("party")).agg(sum0("votes").alias("party_list_votes"))
    out = a.join(b, "party", "full").fillna(0, subset=["candidate_votes", "party_list_votes"])
    return out.withColumn("vote_gap", F.col("candidate_votes") - F.col("party_list_votes")).withColumn("total_combined", F.col("candidate_votes") + F.col("party_list_votes"))


def size_preference(stations: DataFrame, party: DataFrame, n: int, by_rank: bool, order: str = "station_no") -> DataFrame:
    """Votes of the n largest parties by station size; station rows are not made distinct first."""
    sized = tercile_by_rank(stations, "eligible_voters", order) if by_rank else tercile_by_value(stations, "eligible_voters")
    leaders = top(known(party, "entity_name").groupBy("entity_name").agg(sum0("votes").alias("votes")), n, "votes", "entity_name").select("entity_name")
    rows = party.join(F.broadcast(leaders), "entity_name", "left_semi").join(sized.select("station_code", "station_size"), "station_code").where("station_size is not null")
    return rows.groupBy("station_size", "entity_name").agg(sum0("votes").alias("votes"))


def size_pivot(preference: DataFrame, names: list[str]) -> DataFrame:
    """A row for each size, a column for each named party, 0 where there is nothing."""
    return preference.groupBy("station_size").pivot("entity_name", names).agg(F.first("votes")).fillna(0)


def missing_stations(reference: DataFrame, stations: DataFrame) -> DataFrame:
    """Reference stations without data; a ? at a code's end is put aside."""
    have = stations.select(F.replace("station_code", F.lit("?"), F.lit("")).alias("station_code")).distinct()
    return reference.join(have, "station_code", "left_anti")


def scaled_totals(votes: DataFrame, reference_total: DataFrame) -> DataFrame:
    """V2 by totals: each entity's sum, scaled to the official total (one row, column total), half to even."""
    own = known(votes, "entity_name").groupBy("entity_name").agg(sum0("votes").alias("v1"))
    both = own.crossJoin(F.broadcast(own.agg(sum0("v1").alias("_o")))).crossJoin(F.broadcast(reference_total.select(F.col("total").alias("_t"))))
    return both.withColumn("v2", F.bround(F.col("v1") * F.try_divide(F.col("_t"), F.col("_o"))).cast("long")).drop("_o", "_t")


def scaled_rows(votes: DataFrame, reference_total: DataFrame) -> DataFrame:
    """V2 by rows: each count scaled and rounded by itself."""
    sums = votes.agg(sum0("votes").alias("_o")).crossJoin(reference_total.select(F.col("total").alias("_t")))
    return votes.crossJoin(F.broadcast(sums)).withColumn("votes", F.bround(F.col("votes") * F.try_divide(F.col("_t"), F.col("_o"))).cast("long")).drop("_o", "_t")


def compare_versions(v1: DataFrame, v3: DataFrame, v4: DataFrame, places: int = 1) -> DataFrame:
    """V1, V2 and V4 beside the official V3 (entity_name, votes), with accuracy in percent, largest V3 first."""
    a = scaled_totals(v1, v3.agg(sum0("votes").alias("total")))
    b = v3.groupBy("entity_name").agg(F.sum("votes").alias("v3"))
    c = known(v4, "entity_name").groupBy("entity_name").agg(sum0("votes").alias("v4"))
    out = a.join(b, "entity_name", "full").join(c, "entity_name", "full")
    for v in ("v1", "v2", "v4"):
        out = out.withColumn(f"{v}_accuracy_pct", F.bround(share(F.col(v), F.col("v3")), places))
    return out.orderBy(F.desc_nulls_last("v3"), "entity_name")


def coverage(votes: DataFrame, reference_total: DataFrame) -> DataFrame:
    """Votes found, official votes, and the part found in percent."""
    row = votes.agg(sum0("votes").alias("votes")).crossJoin(reference_total.select(F.col("total").alias("reference")))
    return row.withColumn("coverage_pct", share(F.col("votes"), F.col("reference")))


def _named(votes: DataFrame, keys: list[Column]) -> DataFrame:
    return votes.groupBy(*keys).agg(sum0("votes").alias("votes_2026"))


def candidate_totals(votes: DataFrame, version: str = "V1") -> DataFrame:
    """Current votes of each candidate and party. V3's rows are official totals, one a candidate, and pass as they are."""
    if version == "V3":
        return votes.select(F.col("entity_name").alias("candidate_name"), F.col("party_name").alias("party_name_2026"), F.col("votes").alias("votes_2026"))
    return _named(votes, [F.col("entity_name").alias("candidate_name"), F.col("party_name").alias("party_name_2026")])


def party_totals(votes: DataFrame) -> DataFrame:
    return _named(known(votes, "entity_name"), [party_key(F.col("entity_name")).alias("compare_party")])


def votes_of(version: str, frames: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(candidate votes, party votes) of a version; those of V1 for a name that isn't one."""
    return frames.get(version, frames["V1"])


def _by_area(rows: DataFrame, district: str, subdistrict: str) -> bool:
    """Whether a scope's own rows count: it is narrower than the whole, and rows by area are known."""
    return (district != "All" or subdistrict != "All") and not rows.isEmpty()


def past_candidate_totals(rows: DataFrame, official: DataFrame, district: str = "All", subdistrict: str = "All") -> DataFrame:
    """(candidate_name, party_name_2023, votes_2023): the scope's rows summed, official totals without a scope or area rows."""
    if not _by_area(rows, district, subdistrict):
        return official.select("candidate_name", F.col("party_name").alias("party_name_2023"), F.col("official_candidate_total").alias("votes_2023"))
    inside = known(scope(rows, district, subdistrict), "candidate_name", "party_name")
    return inside.groupBy("candidate_name", F.col("party_name").alias("party_name_2023")).agg(sum0("votes").alias("votes_2023"))


def scoped_party_totals(rows: DataFrame, official: DataFrame, district: str = "All", subdistrict: str = "All") -> DataFrame:
    """(compare_party, votes_2023) from the scope's rows, or from official totals (party_name, votes) without a scope or area rows."""
    return past_party_totals(scope(rows, district, subdistrict) if _by_area(rows, district, subdistrict) else official)


def past_turnout(summary: DataFrame, district: str = "All", subdistrict: str = "All") -> DataFrame:
    return scope(summary, district, subdistrict).select("district", "subdistrict", F.col("turnout_pct").alias("turnout_2023"), "station_count")


def past_party_totals(rows: DataFrame) -> DataFrame:
    return known(rows, "party_name").groupBy(party_key(F.col("party_name")).alias("compare_party")).agg(sum0("votes").alias("votes_2023"))


def same_candidate(past: DataFrame, current: DataFrame) -> DataFrame:
    """Candidates who stood in both elections; shares are of all candidates' votes."""
    sums = past.agg(sum0("votes_2023").alias("_a")).crossJoin(current.agg(sum0("votes_2026").alias("_b")))
    out = past.join(current, "candidate_name").fillna(0).crossJoin(F.broadcast(sums))
    out = out.withColumn("change", F.col("votes_2026") - F.col("votes_2023"))
    return out.withColumn("share_2023", pct(F.col("votes_2023"), F.col("_a"), 0.0)).withColumn("share_2026", pct(F.col("votes_2026"), F.col("_b"), 0.0)).drop("_a", "_b")


def compare_parties(past: DataFrame, current: DataFrame) -> DataFrame:
    """Both elections' party totals, shares of the whole scope, swing, and the name to show."""
    out = past.join(current, "compare_party", "full").fillna(0, subset=["votes_2023", "votes_2026"])
    sums = out.agg(sum0("votes_2023").alias("_a"), sum0("votes_2026").alias("_b"))
    out = out.crossJoin(F.broadcast(sums)).withColumn("share_2023", pct(F.col("votes_2023"), F.col("_a"), 0.0)).withColumn("share_2026", pct(F.col("votes_2026"), F.col("_b"), 0.0))
    return out.withColumn("swing_pp", F.col("share_2026") - F.col("share_2023")).withColumn("party", party_label(F.col("compare_party"))).drop("_a", "_b")


def turnout_change(past: DataFrame, stations: DataFrame, n: int = 12) -> DataFrame:
    """Areas with the largest change of turnout; past is (district, subdistrict, turnout_2023)."""
    now = known(stations, "district", "subdistrict").groupBy("district", "subdistrict").agg(sum0("eligible_voters").alias("eligible"), sum0("voters_present").alias("present"))
    now = now.withColumn("turnout_2026", pct(F.col("present"), F.col("eligible")))
    out = past.join(now, ["district", "subdistrict"]).dropna(subset=["turnout_2023", "turnout_2026"])
    out = out.withColumn("change", F.col("turnout_2026") - F.col("turnout_2023"))
    return out.orderBy(F.desc(F.abs("change")), "district", "subdistrict").limit(n).orderBy("turnout_2026", "district", "subdistrict")


def feature_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: its median and largest value."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "x")
    return long.groupBy("feature").agg(F.median("x").alias("median"), F.max("x").alias("max"))


def years_long(df: DataFrame, ids: list[str], prefix: str, name: str) -> DataFrame:
    """prefix_2023 and prefix_2026 as two rows of (Year, name)."""
    long = df.unpivot(ids, [f"{prefix}_2023", f"{prefix}_2026"], "Year", name)
    return long.withColumn("Year", F.regexp_replace("Year", f"^{prefix}_", ""))
