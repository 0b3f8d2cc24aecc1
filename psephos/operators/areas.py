"""Areas and stations: turnout, winners, gaps, swings, hotspots and review scores.

Every function takes and gives DataFrames. Ties of votes go to the first name, then to
the first party, nulls last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.functions.pdsem import area_key, first_of, joined_set, known, label_of_score, pct, robust_z, row_in, strip, sum0

#: Parties that went on under another name, and how both are shown (fixed values).
SUCCESSOR = {"ก้าวไกล": "ประชาชน"}
SHOWN = {"ประชาชน": "ก้าวไกล / ประชาชน"}

#: Weights and names of what a review score is made of (fixed values).
REVIEW = {
    "turnout_pct": (0.20, "turnout"),
    "spoiled_pct": (0.13, "spoiled ballots"),
    "no_vote_pct": (0.10, "no-vote"),
    "winner_share_pct": (0.18, "winner share"),
    "margin_pct": (0.17, "victory margin"),
    "split_abs_gap_pp": (0.22, "split-ticket gap"),
}


def _renamed(c: Column, table: dict[str, str]) -> Column:
    out = c
    for old, new in table.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def party_key(c: Column) -> Column:
    return _renamed(strip(c), SUCCESSOR)


def party_label(c: Column) -> Column:
    return _renamed(strip(c), SHOWN)


def scope(df: DataFrame, district: str = "All", subdistrict: str = "All") -> DataFrame:
    """Rows of one district or subdistrict; All keeps all."""
    if district != "All":
        df = df.where(F.col("district") == district)
    if subdistrict != "All":
        df = df.where(F.col("subdistrict") == subdistrict)
    return df


def geo_filter(stations: DataFrame, tables: list[DataFrame], district: str = "All", subdistrict: str = "All") -> tuple[DataFrame, list[DataFrame]]:
    """Stations in scope, and of the tables the rows of those stations."""
    if district == "All" and subdistrict == "All":
        return stations, tables
    inside = scope(stations, district, subdistrict)
    codes = inside.select("station_code").distinct()
    return inside, [t.join(codes, "station_code", "left_semi") for t in tables]


def options(stations: DataFrame, column: str) -> DataFrame:
    return stations.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def ordered_list(df: DataFrame, keys: list[str | Column], order: str, value: str, name: str) -> DataFrame:
    """For each group its values in the order of another column, ties by value; grows with the group, as the list does."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x["v"]).alias(name))


def display_table(df: DataFrame, names: dict[str, str], counts: list[str], rates: list[str], level: str = "Sub-district") -> DataFrame:
    """The columns of names under their headings: counts as whole numbers, rates to two places; no subdistrict at district level."""
    shown = {c: heading for c, heading in names.items() if not (level == "District" and c == "subdistrict")}
    cell = lambda c: F.bround(c).cast("long") if c in counts else F.bround(c, 2) if c in rates else F.col(c)
    return df.select(*[cell(c).alias(heading) for c, heading in shown.items()])


def station_map(stations: DataFrame, level: str) -> DataFrame:
    keyed = known(stations.withColumn("area_key", area_key(level)), "area_key")
    out = keyed.groupBy("area_key").agg(F.count_distinct("station_code").alias("stations"), sum0("eligible_voters").alias("eligible_voters"), sum0("voters_present").alias("voters_present"))
    return out.withColumn("turnout_pct", pct(F.col("voters_present"), F.col("eligible_voters")))


def _choices(votes: DataFrame, keys: list[str], constituency: bool) -> DataFrame:
    names = ["entity_name", "party_name"] if constituency else ["entity_name"]
    return known(votes, *keys).groupBy(*keys, *names).agg(sum0("votes").alias("votes"))


def _leaders(grouped: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Total, and first and second of each group in one pass over ranked rows."""
    order = [F.desc_nulls_last("votes"), F.asc_nulls_last("entity_name")] + ([F.asc_nulls_last("party_name")] if "party_name" in grouped.columns else [])
    ranked = grouped.withColumn("_r", row_in([key], *order))
    picks = [F.max(F.when(F.col("_r") == rank, c)).alias(f"{name}{rank}") for name, c in fields.items() for rank in (1, 2)]
    return ranked.groupBy(key).agg(sum0("votes").alias("total"), *picks)


def vote_map(votes: DataFrame, level: str, constituency: bool = True) -> DataFrame:
    """Winner, runner-up and margin of each area, for candidates or for parties."""
    grouped = _choices(votes.withColumn("area_key", area_key(level)), ["area_key"], constituency)
    name = F.col("entity_name")
    if constituency:
        label = F.when(F.col("party_name").isNotNull(), F.concat(name, F.lit(" ("), F.col("party_name"), F.lit(")"))).otherwise(name)
        party = F.coalesce("party_name", "entity_name")
    else:
        label = party = name
    top = _leaders(grouped, "area_key", {"label": label, "party": party, "votes": F.col("votes")})
    out = top.select(
        "area_key", F.col("total").alias("total_votes"), F.col("label1").alias("winner"), F.col("party1").alias("winner_party"), F.col("votes1").alias("winner_votes"),
        F.coalesce("label2", F.lit("No runner-up")).alias("runner_up"), F.coalesce("votes2", F.lit(0)).alias("runner_up_votes"),
    )
    out = out.withColumn("margin_votes", F.col("winner_votes") - F.col("runner_up_votes"))
    return out.withColumn("margin_pct", pct(F.col("margin_votes"), F.col("total_votes")))


def map_data(areas: DataFrame, stations: DataFrame, votes: DataFrame, level: str, constituency: bool = True) -> DataFrame:
    """Every area with its stations and winner, filled where it has none."""
    out = areas.join(station_map(stations, level), "area_key", "left").join(vote_map(votes, level, constituency), "area_key", "left")
    out = out.fillna(0, subset=["stations", "eligible_voters", "voters_present", "total_votes", "winner_votes", "runner_up_votes", "margin_votes"])
    out = out.fillna({"winner": "No vote rows in current scope", "winner_party": "No data", "runner_up": "No vote rows"})
    return out.withColumn("has_votes", F.col("total_votes") > 0)


def station_base(stations: DataFrame, order: str = "station_no") -> DataFrame:
    sums = ["eligible_voters", "voters_present", "ballots_used", "ballots_spoiled", "ballots_no_vote"]
    base = stations.groupBy("station_code").agg(
        first_of("station_no", order).alias("station_no"), first_of("district", order).alias("district"), first_of("subdistrict", order).alias("subdistrict"),
        *[sum0(c).alias(c) for c in sums], joined_set("validation_flags").alias("validation_flags"),
    )
    for name, num, den in (("turnout_pct", "voters_present", "eligible_voters"), ("spoiled_pct", "ballots_spoiled", "ballots_used"), ("no_vote_pct", "ballots_no_vote", "ballots_used")):
        base = base.withColumn(name, pct(F.col(num), F.col(den)))
    return base


def station_strength(votes: DataFrame) -> DataFrame:
    grouped = _choices(votes, ["station_code"], True)
    top = _leaders(grouped, "station_code", {"name": F.col("entity_name"), "party": F.col("party_name"), "votes": F.col("votes")})
    out = top.select(
        "station_code", F.col("name1").alias("winner_candidate"), F.col("party1").alias("winner_party"), F.col("votes1").alias("winner_votes"),
        F.coalesce("name2", F.lit("No runner-up")).alias("runner_up_candidate"), F.coalesce("votes2", F.lit(0)).alias("runner_up_votes"), F.col("total").alias("candidate_total_votes"),
    )
    out = out.withColumn("winner_share_pct", pct(F.col("winner_votes"), F.col("candidate_total_votes")))
    return out.withColumn("margin_pct", pct(F.col("winner_votes") - F.col("runner_up_votes"), F.col("candidate_total_votes")))


def _both(candidate: DataFrame, party: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates' votes by their party beside the party's own, an absent one as 0."""
    a = known(candidate, *keys, "party_name").groupBy(*keys, "party_name").agg(sum0("votes").alias("candidate_votes"))
    b = known(party, *keys, "entity_name").groupBy(*keys, F.col("entity_name").alias("party_name")).agg(sum0("votes").alias("party_list_votes"))
    return a.join(b, [*keys, "party_name"], "full").fillna(0, subset=["candidate_votes", "party_list_votes"])


def split_gap(candidate: DataFrame, party: DataFrame) -> DataFrame:
    """For each station the party whose two shares are furthest apart."""
    w = Window.partitionBy("station_code")
    both = _both(candidate, party, ["station_code"])
    both = both.withColumn("ct", F.sum("candidate_votes").over(w)).withColumn("pt", F.sum("party_list_votes").over(w))
    both = both.withColumn("candidate_share_pct", pct(F.col("candidate_votes"), F.col("ct"), 0.0)).withColumn("party_list_share_pct", pct(F.col("party_list_votes"), F.col("pt"), 0.0))
    both = both.withColumn("split_gap_pp", F.col("candidate_share_pct") - F.col("party_list_share_pct")).withColumn("split_abs_gap_pp", F.abs("split_gap_pp"))
    first = both.withColumn("_r", row_in(["station_code"], F.desc("split_abs_gap_pp"), F.asc("party_name"))).where("_r = 1")
    return first.select("station_code", F.col("party_name").alias("split_party"), "candidate_share_pct", "party_list_share_pct", "split_gap_pp", "split_abs_gap_pp")


def station_anomaly(stations: DataFrame, candidate: DataFrame, party: DataFrame) -> DataFrame:
    """Stations with a weighted review score of 0 to 100, its level and what it is for."""
    rows = station_base(stations).join(station_strength(candidate), "station_code", "left").join(split_gap(candidate, party), "station_code", "left")
    rows = rows.fillna(0.0, subset=["winner_share_pct", "margin_pct", "split_abs_gap_pp"])
    rows = robust_z(rows, list(REVIEW))
    total: Column = F.lit(0.0)
    for c, (weight, _) in REVIEW.items():
        total = total + F.col(f"z_{c}") * weight
    rows = rows.withColumn("review_score", F.least(F.greatest(total / 4 * 100, F.lit(0.0)), F.lit(100.0)))
    reason = F.concat_ws(", ", *[F.when(F.col(f"z_{c}") >= 2, label) for c, (_, label) in REVIEW.items()])
    return rows.withColumn("review_level", label_of_score(F.col("review_score"))).withColumn("review_reason", F.when(reason == "", "overall pattern").otherwise(reason))


def anomaly_area(anomaly: DataFrame, level: str) -> DataFrame:
    keyed = known(anomaly.withColumn("area_key", area_key(level)), "area_key")
    return keyed.groupBy("area_key").agg(
        first_of("district", "station_code").alias("district"), first_of("subdistrict", "station_code").alias("subdistrict"), F.count_distinct("station_code").alias("stations"),
        F.count_if(F.col("review_score") >= 55).alias("flagged_stations"), F.max("review_score").alias("max_review_score"), F.avg("review_score").alias("avg_review_score"),
    )


def _index(df: DataFrame, ct: Column, pt: Column) -> DataFrame:
    df = df.withColumn("candidate_share_pct", pct(F.col("candidate_votes"), ct, 0.0)).withColumn("party_list_share_pct", pct(F.col("party_list_votes"), pt, 0.0))
    df = df.withColumn("personal_vote_index_pp", F.col("candidate_share_pct") - F.col("party_list_share_pct"))
    return df.withColumn("abs_personal_vote_index_pp", F.abs("personal_vote_index_pp")).withColumn("gap_votes", F.col("candidate_votes") - F.col("party_list_votes"))


def party_area_index(candidate: DataFrame, party: DataFrame, level: str) -> DataFrame:
    """By area and party: the candidates' share over the party's."""
    keys = ["area_key", "district"] + ([] if level == "District" else ["subdistrict"])
    both = _both(candidate.withColumn("area_key", area_key(level)), party.withColumn("area_key", area_key(level)), keys)
    if level == "District":
        both = both.withColumn("subdistrict", F.lit("All"))
    w = Window.partitionBy("area_key")
    both = both.withColumn("_c", F.sum("candidate_votes").over(w)).withColumn("_p", F.sum("party_list_votes").over(w))
    return _index(both, F.col("_c"), F.col("_p")).drop("_c", "_p")


def party_index_overall(candidate: DataFrame, party: DataFrame) -> DataFrame:
    area = party_area_index(candidate, party, "District")
    by_party = area.groupBy("party_name").agg(F.sum("candidate_votes").alias("candidate_votes"), F.sum("party_list_votes").alias("party_list_votes"))
    total = by_party.agg(F.sum("candidate_votes").alias("_c"), F.sum("party_list_votes").alias("_p"))
    return _index(by_party.crossJoin(F.broadcast(total)), F.col("_c"), F.col("_p")).drop("_c", "_p")


def hotspots(stations: DataFrame, candidate: DataFrame, party: DataFrame, level: str, selected: str | None) -> DataFrame:
    out = station_map(stations, level).join(vote_map(candidate, level), "area_key", "full")
    if not selected:
        return out.withColumn("selected_party_share_pct", F.lit(0.0))
    keyed = known(party.withColumn("area_key", area_key(level)), "area_key", "entity_name")
    own = keyed.groupBy("area_key").agg(sum0("votes").alias("party_total_votes"), sum0(F.when(F.col("entity_name") == selected, F.col("votes"))).alias("selected_party_votes"))
    out = out.join(own, "area_key", "left").fillna(0, subset=["selected_party_votes", "party_total_votes"])
    return out.withColumn("selected_party_share_pct", pct(F.col("selected_party_votes"), F.col("party_total_votes"), 0.0))


def party_swing(current: DataFrame, past: DataFrame, level: str) -> DataFrame:
    """Shares of both elections by area and party, and the change; past names are in party_name."""
    keys = ["area_key", "district"] + ([] if level == "District" else ["subdistrict"])
    w = Window.partitionBy("area_key")

    def side(df: DataFrame, name: str, year: str) -> DataFrame:
        rows = df.withColumn("area_key", area_key(level)).withColumn("compare_party", party_key(F.col(name)))
        rows = known(rows, *keys, "compare_party").groupBy(*keys, "compare_party").agg(sum0("votes").alias(f"votes_{year}"))
        rows = rows.withColumn(f"share_{year}", pct(F.col(f"votes_{year}"), F.sum(f"votes_{year}").over(w), 0.0))
        return rows.withColumn("subdistrict", F.lit("All")) if level == "District" else rows

    out = side(past, "party_name", "2023").join(side(current, "entity_name", "2026"), ["area_key", "district", "subdistrict", "compare_party"], "full")
    out = out.fillna(0, subset=["votes_2023", "share_2023", "votes_2026", "share_2026"])
    return out.withColumn("swing_pp", F.col("share_2026") - F.col("share_2023"))


def vote_mismatch(candidate: DataFrame, party: DataFrame, level: str) -> DataFrame:
    """Areas whose candidate and party winners differ, scored by the widest gap of shares, 15 more where they do."""
    a = vote_map(candidate, level).select("area_key", F.col("winner").alias("constituency_winner"), F.col("winner_party").alias("constituency_winner_party"), F.col("total_votes").alias("constituency_votes"))
    b = vote_map(party, level, False).select("area_key", F.col("winner").alias("party_list_winner"), F.col("total_votes").alias("party_list_votes"))
    index = party_area_index(candidate, party, level)
    widest = index.withColumn("_r", row_in(["area_key"], F.desc("abs_personal_vote_index_pp"), F.asc("party_name"))).where("_r = 1")
    widest = widest.select("area_key", F.col("party_name").alias("gap_party"), F.col("abs_personal_vote_index_pp").alias("max_gap_pp"))
    out = a.join(b, "area_key", "full").join(widest, "area_key", "left")
    left, right = (F.nullif(F.col(c), F.lit("")) for c in ("constituency_winner_party", "party_list_winner"))
    out = out.withColumn("comparable", left.isNotNull() & right.isNotNull())
    out = out.withColumn("winner_mismatch", F.coalesce(F.col("comparable") & (left != right), F.lit(False)))
    gap = F.coalesce("max_gap_pp", F.lit(0.0))
    out = out.withColumn("mismatch_score", F.when(F.col("comparable"), gap + F.when(F.col("winner_mismatch"), 15.0).otherwise(0.0)).otherwise(0.0))
    return out.withColumn("mismatch_label", F.when(~F.col("comparable"), "No data").when(F.col("winner_mismatch"), "Yes").otherwise("No")).fillna(0, subset=["constituency_votes", "party_list_votes", "max_gap_pp"])
