"""Sinks: CSV, Parquet, checkpoints that are written once, reports only where there is something to report."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, Observation
from pyspark.sql import functions as F

from psephos.sources.readers import exists


#: Written as the first letter of the first heading, so that every file begins with it.
BYTE_ORDER_MARK = "\ufeff"


def _csv(df: DataFrame, mark: bool) -> DataFrameWriter:
    marked = df.withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0]) if mark else df
    return marked.write.mode("overwrite").option("header", True).option("escape", '"')


def csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """CSV with headings, and with a byte-order mark unless mark is False."""
    _csv(df, mark).csv(path)


def parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def split_by_form(df: DataFrame, path: str, as_csv: bool = False) -> None:
    """A folder for each form; one pass over the rows."""
    if as_csv:
        first = [c for c in df.columns if c != "form_type"]
        _csv(df.select(*first, "form_type"), True).partitionBy("form_type").csv(path)
    else:
        parquet(df, path, by="form_type")


def report(df: DataFrame, path: str) -> bool:
    """Writes a CSV only if there are rows; says whether it did."""
    if not df.head(1):
        return False
    csv(df, path)
    return True


def needs_review(stations: DataFrame, path: str) -> None:
    csv(stations.where("ocr_status <> 'ok'"), path)


def checkpoints(rows: DataFrame, path: str, key: str = "key", force: bool = False) -> int:
    """Appends the rows whose key is not there yet (all if forced); returns how many.

    rows hold key beside the checkpoint's columns. A second run adds nothing.
    """
    fresh = rows
    if not force and exists(rows.sparkSession, path):
        done = rows.sparkSession.read.parquet(path).select(key).distinct()
        fresh = rows.join(done, key, "left_anti")
    written = Observation()
    fresh.observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite" if force else "append").parquet(path)
    return written.get["n"]


def bundle(candidates: DataFrame, parties: DataFrame, path: str, source: str, constituency_id: str) -> None:
    """The reference bundle: both rosters with their totals in one nested JSON row."""
    c = candidates.agg(F.array_sort(F.collect_list(F.struct("number", "name", "party", "votes"))).alias("candidates"), F.sum("votes").alias("total_candidate_votes"))
    p = parties.agg(F.array_sort(F.collect_list(F.struct("number", "party", "votes"))).alias("parties"), F.sum("votes").alias("total_party_votes"))
    out = c.crossJoin(p).select(F.struct("candidates", "total_candidate_votes").alias("constituency"), F.struct("parties", "total_party_votes").alias("party_list"), F.lit(source).alias("source"), F.lit(constituency_id).alias("constituency_id"))
    out.write.mode("overwrite").json(path)
