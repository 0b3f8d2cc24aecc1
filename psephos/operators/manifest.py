"""What source files there are: duplicates, coverage of areas, and which file each station's form is in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.functions.pdsem import row_in
from psephos.functions.thai import classify_file

FORMS = ["5_18", "5_18_party"]
WHOLE = ["5_16", "5_16_party", "5_17", "5_17_party"]
#: Subdistricts that files of several municipalities are taken to cover (fixed values).
KNOWN_MULTI = ["บ้านกอก", "หนองบัวโคก"]


def _split(path: str = "path"):
    parts = F.split(F.col(path), "/")
    return F.element_at(parts, -1), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def file_audit(files: DataFrame) -> DataFrame:
    """(action, path, size_kb, note) of (path, content or digest, length): report only, nothing is deleted.

    Files of one folder whose names differ in case alone are one group: equal contents
    keep the first by path, others would go; differing contents are for review.
    """
    name, parent = _split()
    digest = F.col("digest") if "digest" in files.columns else F.md5("content")
    g = ["_p", "_n"]
    rows = files.select("path", (F.col("length") / 1024).cast("long").alias("size_kb"), digest.alias("digest"), parent.alias("_p"), F.lower(name).alias("_n"))
    groups = rows.groupBy(*g).agg(F.count("*").alias("_c"), F.count_distinct("digest").alias("_d"), F.min("path").alias("_first"))
    out = rows.join(groups, g)
    first = F.col("path") == F.col("_first")
    action = F.when(F.col("_c") == 1, "KEEP").when(F.col("_d") > 1, "REVIEW").when(first, "KEEP").otherwise("WOULD_DELETE")
    note = (
        F.when(F.col("_c") == 1, "").when(F.col("_d") > 1, F.concat(F.lit("differs from siblings, hash="), F.substring("digest", 1, 8)))
        .when(first, F.concat(F.lit("original of "), F.col("_c").cast("string"), F.lit(" duplicates"))).otherwise("byte-identical duplicate")
    )
    return out.select(action.alias("action"), "path", "size_kb", note.alias("note"))


def name_sizes(files: DataFrame) -> DataFrame:
    """By lower-cased name: how many files, how many different lengths."""
    name, _ = _split()
    return files.groupBy(F.lower(name).alias("name")).agg(F.count("*").alias("files"), F.count_distinct("length").alias("sizes"), F.sum("length").alias("bytes"))


def classified(files: DataFrame) -> DataFrame:
    """Files once each, however their paths are cased, with what their names tell; mixed forms count as both."""
    one = files.withColumn("_k", F.lower("path")).withColumn("_r", row_in(["_k"], F.asc("path"))).where("_r = 1").select("path")
    name, parent = _split()
    folder = F.element_at(F.split(parent, "/"), -1)
    out = one.withColumn("_c", classify_file(name)).select("path", F.replace(folder, F.lit("อำเภอ"), F.lit("")).alias("folder"), "_c.*")
    forms = F.when(F.col("form_type") == "mixed", F.array(*[F.lit(f) for f in FORMS])).otherwise(F.array("form_type"))
    return out.withColumn("kind", F.when(F.col("form_type") == "mixed", "mixed").otherwise("pure")).withColumn("form_type", F.explode(forms))


def coverage(stations: DataFrame, files: DataFrame, multi: list[str] | None = None) -> DataFrame:
    """By district and subdistrict: stations, which forms there are files of, and how complete that is."""
    c = classified(files).where("level = 'station'")
    names = F.when(F.col("is_multi_tambol"), F.array(*[F.lit(x) for x in (KNOWN_MULTI if multi is None else multi)])).otherwise(F.array("tambol"))
    have = c.select(F.explode(names).alias("subdistrict"), "form_type").groupBy("subdistrict").agg(F.collect_set("form_type").alias("_f"))
    out = stations.groupBy("district", "subdistrict").agg(F.count("*").alias("n_stations")).join(have, "subdistrict", "left")
    for form in FORMS:
        out = out.withColumn(f"has_{form}", F.coalesce(F.array_contains("_f", form), F.lit(False)))
    n = F.coalesce(F.size("_f"), F.lit(0))
    out = out.withColumn("completeness", F.when(n == 2, "complete").when(n > 0, "partial").otherwise("missing")).drop("_f")
    return out.select("district", "subdistrict", "n_stations", "has_5_18", "has_5_18_party", "completeness").orderBy("district", "subdistrict")


def coverage_rollup(report: DataFrame) -> DataFrame:
    return report.groupBy("completeness").agg(F.count("*").alias("n_tambols"), F.sum("n_stations").alias("n_stations"))


def source_manifest(stations: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each station and form, then of the forms of the whole constituency.

    Municipal stations (T in the code) take their district's file of several
    municipalities if it has one; the others their subdistrict's. Of several files the
    last by path stands.
    """
    c = classified(files)
    last = lambda rows, keys: rows.groupBy(*keys, "form_type").agg(F.max(F.struct("path", "kind")).alias("_l")).select(*keys, "form_type", F.col("_l.path").alias("path"), F.col("_l.kind").alias("kind"))
    own = last(c.where("level = 'station' AND NOT is_multi_tambol").withColumnRenamed("tambol", "subdistrict"), ["subdistrict"])
    several = last(c.where("is_multi_tambol").withColumnRenamed("folder", "district"), ["district"]).select("district", "form_type", F.col("path").alias("_m"))
    rows = stations.select("station_code", "station_no", "district", "subdistrict").withColumn("form_type", F.explode(F.array(*[F.lit(f) for f in FORMS])))
    rows = rows.join(several, ["district", "form_type"], "left").join(own, ["subdistrict", "form_type"], "left")
    town = F.col("station_code").contains("T") & F.col("_m").isNotNull()
    names = ["station_code", "station_no", "district", "subdistrict", "form_type", "source_pdf", "source_kind"]
    rows = rows.withColumn("source_pdf", F.when(town, F.col("_m")).otherwise(F.col("path"))).withColumn("source_kind", F.when(town, "multi_tambol_mixed").otherwise(F.coalesce("kind", F.lit("missing"))))
    spark = stations.sparkSession
    whole = spark.createDataFrame([(f,) for f in WHOLE], "form_type string").join(last(c.where("level = 'constituency'").withColumn("_x", F.lit(1)), ["_x"]), "form_type", "left")
    empty = [F.lit(None).cast(t).alias(n) for n, t in stations.select("station_code", "station_no", "district", "subdistrict").dtypes]
    whole = whole.select(*empty, "form_type", F.col("path").alias("source_pdf"), F.when(F.col("path").isNotNull(), "constituency").otherwise("missing").alias("source_kind"))
    return rows.select(*names).unionByName(whole)


def source_list(manifest: DataFrame, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct files in path order, of one kind if asked."""
    out = manifest.where("source_pdf IS NOT NULL")
    out = (out.where(F.col("source_kind") == kind) if kind else out).select("source_pdf").distinct().orderBy("source_pdf")
    return out.limit(limit) if limit is not None else out
