"""The previous election: from one wide row for each station to long votes, totals and area summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.functions.pdsem import row_in, share, sum0

# Fixed values of the wide table.
CANDIDATE, PARTY = "เขต_", "บช_"
SUMMARY = {"ผู้มีสิทธิ์": "eligible_voters", "ผู้มาใช้สิทธิ์": "voters_present", "บัตรเสีย": "spoiled_ballots", "ไม่เลือกผู้ใด": "no_vote"}
SPECIAL_REGISTRARS = {"ล่วงหน้าในเขตเลือกตั้ง": "advance_in_constituency", "ล่วงหน้านอกเขตเลือกตั้ง": "advance_out_constituency"}
IDS = ["id", "index_no", "document", "province", "province_number", "district", "subdistrict", "registrar", "station_number", "area_key", "area_scope", "in_project_area"]


def area_pairs(stations: DataFrame) -> DataFrame:
    return stations.select("district", "subdistrict").distinct()


def single_district(stations: DataFrame) -> DataFrame:
    """(subdistrict, district) of the subdistricts that are in one district only."""
    by = stations.where("subdistrict IS NOT NULL").groupBy("subdistrict").agg(F.count_distinct("district").alias("n"), F.min("district").alias("district"))
    return by.where("n = 1").drop("n")


def add_area(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """area_key, in_project_area and area_scope of every row; a null district or subdistrict is empty."""
    df = scores.withColumn("district", F.coalesce(F.col("district").cast("string"), F.lit(""))).withColumn("subdistrict", F.coalesce(F.col("subdistrict").cast("string"), F.lit("")))
    df = df.withColumn("area_key", F.concat("district", F.lit("||"), "subdistrict"))
    df = df.join(pairs.withColumn("_in", F.lit(True)), ["district", "subdistrict"], "left").withColumn("in_project_area", F.coalesce("_in", F.lit(False))).drop("_in")
    scope = F.when(F.col("in_project_area"), "project_area")
    for registrar, name in SPECIAL_REGISTRARS.items():
        scope = scope.when(F.col("registrar") == registrar, name)
    return df.withColumn("area_scope", scope.otherwise("outside_reference"))


def normalize_locations(locations: DataFrame, pairs: DataFrame, lookup: DataFrame) -> DataFrame:
    """The project's district for a place: its own pair if known, else the only district of its subdistrict, else as it is."""
    df = locations.withColumnsRenamed({"districtname": "raw_district", "subdistrictname": "raw_subdistrict"})
    own = pairs.select(F.col("district").alias("raw_district"), F.col("subdistrict").alias("raw_subdistrict"), F.lit(True).alias("_own"))
    df = df.join(own, ["raw_district", "raw_subdistrict"], "left")
    df = df.join(lookup.select(F.col("subdistrict").alias("raw_subdistrict"), F.col("district").alias("_only")), "raw_subdistrict", "left")
    df = df.withColumn("district", F.when(F.col("_own"), F.col("raw_district")).otherwise(F.coalesce("_only", "raw_district"))).withColumn("subdistrict", F.col("raw_subdistrict"))
    known = pairs.select("district", "subdistrict", F.lit(True).alias("_in"))
    df = df.join(known, ["district", "subdistrict"], "left")
    project = (F.coalesce("_own", F.lit(False)) | F.col("_only").isNotNull()) & F.coalesce("_in", F.lit(False))
    return df.withColumn("area_key", F.concat("district", F.lit("||"), "subdistrict")).withColumn("in_project_area", project).drop("_own", "_only", "_in")


def station_summary(scores: DataFrame) -> DataFrame:
    counts = [F.col(f"{kind}{thai}").alias(f"{name}_{english}") for kind, name in ((CANDIDATE, "constituency"), (PARTY, "party_list")) for thai, english in SUMMARY.items()]
    return scores.select(*[F.col(c).alias("constituency_no" if c == "province_number" else c) for c in IDS], *counts)


def _long(scores: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    if not columns:
        return scores.select(*IDS).limit(0).withColumn("party_name", F.lit("")).withColumn("votes", F.lit(0).cast("long"))
    same = scores.select(*IDS, *[F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias(c) for c in columns])
    long = same.unpivot(IDS, columns, "party_name", "votes")
    return long.withColumn("party_name", F.substring("party_name", len(prefix) + 1, 1_000))


def candidate_votes(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each station and candidate whose party has a column; candidates of one party share its votes."""
    columns = [c for c in scores.columns if c.startswith(CANDIDATE) and c.removeprefix(CANDIDATE) not in SUMMARY]
    roster = candidates.select("candidate_no", "candidate_name", "party_name")
    out = _long(scores, columns, CANDIDATE).join(roster, "party_name")
    return out.withColumnRenamed("province_number", "constituency_no")


def party_votes(scores: DataFrame) -> DataFrame:
    columns = [c for c in scores.columns if c.startswith(PARTY) and c.removeprefix(PARTY) not in SUMMARY]
    return _long(scores, columns, PARTY).withColumnRenamed("province_number", "constituency_no")


def totals(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.dropna(subset=keys).groupBy(*keys).agg(sum0("votes").alias("votes")).orderBy(F.desc("votes"), *keys)


def column_totals(scores: DataFrame) -> DataFrame:
    """Party totals straight from the wide table: one pass of sums, then one row for each column."""
    columns = [c for c in scores.columns if c.startswith(PARTY) and c.removeprefix(PARTY) not in SUMMARY]
    sums = scores.agg(*[sum0(F.col(f"`{c}`")).cast("long").alias(c) for c in columns])
    return sums.unpivot([], columns, "party_name", "votes").withColumn("party_name", F.substring("party_name", len(PARTY) + 1, 1_000)).orderBy(F.desc("votes"), "party_name")


def area_summary(summary: DataFrame, candidate_long: DataFrame, party_long: DataFrame) -> DataFrame:
    """By area: stations, sums, turnout in two places, and the winners of both votes."""
    keys = ["district", "subdistrict"]
    base = summary.groupBy(*keys, "area_key").agg(
        F.count("id").alias("station_count"), sum0("constituency_eligible_voters").alias("eligible_voters"), sum0("constituency_voters_present").alias("voters_present"),
        sum0("constituency_spoiled_ballots").alias("spoiled_ballots"), sum0("constituency_no_vote").alias("no_vote"),
    )
    base = base.withColumn("turnout_pct", F.bround(share(F.col("voters_present"), F.col("eligible_voters")), 2))

    def winner(long: DataFrame, names: dict[str, str], votes: str) -> DataFrame:
        sums = long.groupBy(*keys, *names).agg(sum0("votes").alias(votes))
        first = sums.withColumn("_r", row_in(keys, F.desc(votes), *[F.asc(n) for n in names])).where("_r = 1").drop("_r")
        return first.withColumnsRenamed(names)

    a = winner(candidate_long, {"candidate_name": "constituency_winner", "party_name": "constituency_winner_party"}, "constituency_winner_votes")
    b = winner(party_long, {"party_name": "party_list_winner"}, "party_list_winner_votes")
    return base.join(a, keys, "left").join(b, keys, "left").orderBy(*keys)


def official_difference(totals_: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counted against official candidate totals."""
    official = candidates.select("candidate_no", F.col("vote_count").alias("official_candidate_total"))
    return totals_.join(official, "candidate_no", "left").withColumn("official_difference", F.col("votes") - F.col("official_candidate_total"))
