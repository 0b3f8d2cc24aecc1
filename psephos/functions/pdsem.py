"""Column expressions with data-frame semantics: nulls, ratios, rounding and ranks as the election rules want them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum0(c: str | Column) -> Column:
    """A sum that is 0 where there is nothing to add."""
    return F.coalesce(F.sum(c), F.lit(0))


def pct(num: Column, den: Column, otherwise: float | None = None) -> Column:
    """num / den in percent where den is positive; else otherwise."""
    whole = F.when(den > 0, num / den * 100)
    return whole if otherwise is None else whole.otherwise(F.lit(otherwise))


def share(num: Column, den: Column) -> Column:
    """num / den in percent, without a guard but for zero, where it is null."""
    return F.try_divide(num, den) * 100


def fill(df: DataFrame, value: float | int, *columns: str) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def known(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose grouping keys are all there."""
    return df.dropna(subset=list(keys))


def blank_to_null(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def number(c: str | Column, kind: str = "double") -> Column:
    """What can be read as a number; null for the rest, NaN included."""
    c = F.col(c) if isinstance(c, str) else c
    n = c.try_cast(kind)
    return F.nanvl(n, F.lit(None).cast("double")) if kind == "double" else n


def row_in(group: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order))


def first_of(column: str, order: str) -> Column:
    """The first value that is not null, in the order of another column."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def joined_set(column: str, separator: str = "; ") -> Column:
    """Distinct values, sorted, in one string; empty if there are none."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def strip(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def area_key(level: str) -> Column:
    """district, or district||subdistrict; null if a part is."""
    if level == "District":
        return F.col("district")
    return F.concat(F.col("district"), F.lit("||"), F.col("subdistrict"))


def label_of_score(score: Column) -> Column:
    """Right-closed bins of a review score; null outside of them."""
    return (
        F.when((score > -0.01) & (score <= 35), "Normal").when((score > 35) & (score <= 55), "Watch")
        .when((score > 55) & (score <= 75), "Review").when((score > 75) & (score <= 100), "High")
    )


def tercile_by_rank(df: DataFrame, value: str, order: str, name: str = "station_size") -> DataFrame:
    """Small, Medium and Large thirds by rank, ties in the given order; null values get null.

    Ranks come from counts of equal (value, order) ranges, not from one ordered
    partition: value and order are dealt to range partitions, and each partition's rank
    begins after the rows of those before it.
    """
    rows = df.where(F.col(value).isNotNull())
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("q"))
    tagged = rows.crossJoin(F.broadcast(cuts)).withColumn("_p", F.size(F.filter("q", lambda x: F.col(value) > x))).drop("q")
    counts = tagged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy())).drop("_n")
    ranked = tagged.withColumn("_rn", row_in(["_p"], F.col(value), F.col(order))).join(F.broadcast(starts), "_p")
    rank = (F.col("_rn") + F.col("_at") - 1) * 3
    size = F.when(rank < F.col("_all") - 1, "Small").when(rank < 2 * (F.col("_all") - 1), "Medium").otherwise("Large")
    sized = ranked.withColumn(name, size).drop("_p", "_rn", "_at", "_all")
    return sized.unionByName(df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("string")))


def tercile_by_value(df: DataFrame, value: str, name: str = "station_size") -> DataFrame:
    """Thirds by linear quantile edges, right-closed. Equal edges would leave a class empty: the lower name holds."""
    edges = df.agg(F.percentile(value, [1 / 3, 2 / 3]).alias("_q"))
    v = F.col(value)
    size = F.when(v <= F.col("_q")[0], "Small").when(v <= F.col("_q")[1], "Medium").when(v.isNotNull(), "Large")
    return df.crossJoin(F.broadcast(edges)).withColumn(name, size).drop("_q")


def robust_z(df: DataFrame, columns: list[str], prefix: str = "z_", clip: float = 4.0) -> DataFrame:
    """|robust z-score| of each column, at most clip: 0.6745 (x - median) / MAD, else by the population deviation, else 0."""
    med = df.agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    withm = df.crossJoin(F.broadcast(med))
    dev = withm.agg(*[F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))).alias(f"_d_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = withm.crossJoin(F.broadcast(dev))
    for c in columns:
        x, m, d, s = F.col(c), F.col(f"_m_{c}"), F.col(f"_d_{c}"), F.col(f"_s_{c}")
        z = F.when(d > 0, F.lit(0.6745) * (x - m) / d).when(s > 0, (x - m) / s).otherwise(0.0)
        out = out.withColumn(f"{prefix}{c}", F.least(F.abs(F.coalesce(z, F.lit(0.0))), F.lit(clip)))
    return out.drop(*[f"_{k}_{c}" for k in "mds" for c in columns])
