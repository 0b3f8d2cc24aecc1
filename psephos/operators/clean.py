"""Cleaning: repair of ballot counts, eligible-voter estimates, impossible votes, duplicates, imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.functions.pdsem import known, number, row_in, sum0
from psephos.operators import nearest

#: Turnout where none was observed (a fixed value).
FALLBACK_TURNOUT = 0.71
NEIGHBOURS = 10


def _tag(mask: Column, tag: Column | str) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.when(mask, F.concat(F.coalesce("validation_flags", F.lit("")), tag)).otherwise(F.col("validation_flags"))


def station_rows(stations: DataFrame) -> DataFrame:
    """Distinct rows with a station code, without the columns of provenance."""
    return known(stations.drop("source_pdf", "source_pages", "ocr_status", "ballots_received").distinct(), "station_code")


def heal(stations: DataFrame, votes: DataFrame, by_form: bool = False) -> DataFrame:
    """Fills good from the votes' sum, then used from its parts, then present from used, each with a flag.

    Votes of both forms are summed for a station unless by_form. Flags are set where a
    count was missing, also if it still is.
    """
    keys = ["station_code", "form_type"] if by_form else ["station_code"]
    counted = known(votes, *keys).groupBy(*keys).agg(sum0("votes").alias("_good"))
    df = stations.fillna(0, subset=["ballots_no_vote", "ballots_spoiled"]).join(counted, keys, "left")
    steps = (
        ("ballots_good", F.col("_good"), "|Recovered_Good_from_Votes"),
        ("ballots_used", F.col("ballots_good") + F.col("ballots_spoiled") + F.col("ballots_no_vote"), "|Calculated_Used_via_Sum"),
        ("voters_present", F.col("ballots_used"), "|Estimated_Present_from_Used"),
    )
    for column, value, tag in steps:
        df = df.withColumn("_gap", F.col(column).isNull()).withColumn(column, F.coalesce(column, value)).withColumn("validation_flags", _tag(F.col("_gap"), tag))
    return df.drop("_gap", "_good")


def estimate_eligible(stations: DataFrame, fallback: float = FALLBACK_TURNOUT) -> DataFrame:
    """Missing eligible voters from those present and the mean turnout seen elsewhere, with a flag that names the rate."""
    rate = stations.agg(F.coalesce(F.avg(F.try_divide(F.col("voters_present"), F.col("eligible_voters"))), F.lit(fallback)).alias("_rate"))
    df = stations.crossJoin(F.broadcast(rate)).withColumn("_gap", F.col("eligible_voters").isNull())
    guess = F.bround(F.try_divide(F.col("voters_present"), F.col("_rate"))).cast("long")
    tag = F.concat(F.lit("|ESTIMATED_ELIGIBLE_"), F.format_string("%.2f%%", F.col("_rate") * 100), F.lit("_TURNOUT"))
    return df.withColumn("eligible_voters", F.coalesce("eligible_voters", guess)).withColumn("validation_flags", _tag(F.col("_gap"), tag)).drop("_gap", "_rate")


def most_good(stations: DataFrame) -> DataFrame:
    """One row for each station: the one with most good ballots, nulls last."""
    order = [F.desc_nulls_last("ballots_good"), *[F.asc_nulls_last(c) for c in stations.columns if c != "ballots_good"]]
    return stations.withColumn("_r", row_in(["station_code"], *order)).where("_r = 1").drop("_r")


def drop_impossible(votes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Nulls votes above the station's good ballots, as they were before repair."""
    cap = snapshot.groupBy("station_code").agg(F.max("ballots_good").alias("_cap"))
    df = votes.join(cap, "station_code", "left")
    return df.withColumn("votes", F.when(F.col("votes") > F.col("_cap"), None).otherwise(F.col("votes"))).drop("_cap")


def dedupe_votes(votes: DataFrame) -> DataFrame:
    """The largest count of each station, form and entity; ties by the other columns."""
    keys = ["station_code", "entity_no", "form_type"]
    order = [F.desc_nulls_last("votes"), *[F.asc_nulls_last(c) for c in votes.columns if c not in [*keys, "votes"]]]
    return votes.withColumn("_r", row_in(keys, *order)).where("_r = 1").drop("_r")


def clean_votes(votes: DataFrame, snapshot: DataFrame) -> DataFrame:
    rows = known(votes.distinct(), "station_code").drop("votes_thai_word", "needs_review")
    return dedupe_votes(drop_impossible(rows, snapshot))


def knn_impute(votes: DataFrame, stations: DataFrame, key: str, k: int = NEIGHBOURS) -> DataFrame:
    """votes, missing counts filled by the mean of the k nearest known ones, half to even.

    Coordinates are entity_no and the station's eligible voters and good ballots; the
    distance is the root of 4 / shared times the squared differences of shared ones.
    Ties go to the lower key. Distances depend on a row's coordinates alone, so rows
    with equal coordinates are one target, and of equal donors at most k can count. With
    no shared coordinate the mean of all known counts is taken.
    """
    stats = stations.groupBy("station_code").agg(F.first("eligible_voters").alias("_e"), F.first("ballots_good").alias("_g"))
    df = votes.join(stats, "station_code", "left").withColumn("_n", F.col("entity_no"))
    at = ["_n", "_e", "_g"]
    df = nearest.kept(df.withColumns({c: number(F.col(c).cast("double")) for c in at}))
    donors = df.where("votes is not null").select(*at, F.col(key).alias("_k"), F.col("votes").alias("_v"))
    near = nearest.neighbours(df.where("votes is null"), donors, at, k)
    mean = F.aggregate("_best", F.lit(0.0), lambda s, x: s + x["v"]) / F.size("_best")
    near = near.select(*[F.col(c).alias(f"t{c}") for c in at], F.bround(mean).alias("_fill"))
    overall = df.agg(F.bround(F.avg("votes")).alias("_mean"))
    joined = df.join(near, [df[c].eqNullSafe(near[f"t{c}"]) for c in at], "left").crossJoin(F.broadcast(overall))
    kind = dict(votes.dtypes)["votes"]
    return joined.withColumn("votes", F.coalesce(F.col("votes"), F.coalesce("_fill", "_mean").cast(kind))).select(*votes.columns)
