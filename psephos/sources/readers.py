"""Sources: CSV, Parquet, JSON checkpoints, nested reference JSON, GeoJSON, page texts and files, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.operators.forms import CHECKPOINT

STATIONS = "province string, constituency_no long, form_type string, station_code string, station_no long, district string, subdistrict string, eligible_voters long, voters_present long, ballots_received long, ballots_used long, ballots_good long, ballots_spoiled long, ballots_no_vote long, source_pdf string, source_pages string, ocr_status string, validation_flags string"
VOTES = "province string, constituency_no long, form_type string, station_code string, station_no long, district string, subdistrict string, entity_kind string, entity_no long, entity_name string, party_name string, votes long, votes_thai_word string, needs_review boolean"
STATIONS_REF = "station_code string, station_no string, station_name string, district string, subdistrict string"
NESTED_STATIONS = "provinces array<struct<name: string, areas array<struct<area: int, stations: array<struct<code: string, name: string, district: string, subdistrict: string>>>>>>".replace("areas array", "areas: array")
ROSTER = "results array<struct<number: int, name: string, party: string, votes: long>>"

#: Paths of one join side that may be broadcast.
BROADCAST_PATHS = 10_000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, which any of Spark's file systems may hold, is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file or folder with a heading; a byte-order mark is passed over, empty fields are null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file's rows, or none of the same columns where there is no file."""
    return csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def first_of(spark: SparkSession, paths: list[tuple[str, object]], schema: str) -> DataFrame:
    """What the first path that is there gives: pairs of a path and a function of (spark, path); else an empty table."""
    for path, read in paths:
        if exists(spark, path):
            return read(spark, path)
    return spark.createDataFrame([], schema)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """All checkpoint files of a folder; malformed ones are left out."""
    return spark.read.schema(CHECKPOINT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def nested_stations(spark: SparkSession, path: str, province: str, area: int) -> DataFrame:
    """Stations of one province and area of the nested reference file; the number is what follows the code's last dash."""
    raw = spark.read.schema(NESTED_STATIONS).option("multiLine", True).json(path)
    p = raw.select(F.explode("provinces").alias("p")).where(F.col("p.name") == province)
    s = p.select(F.explode("p.areas").alias("a")).where(F.col("a.area") == area).select(F.inline("a.stations"))
    number = F.element_at(F.split("code", "-"), -1)
    return s.select(F.col("code").alias("station_code"), number.alias("station_no"), F.col("name").alias("station_name"), "district", "subdistrict")


def roster(spark: SparkSession, path: str) -> DataFrame:
    """(number, name, party, votes) of a reference roster file."""
    return spark.read.schema(ROSTER).option("multiLine", True).json(path).select(F.inline("results"))


def reference_totals(spark: SparkSession, path: str) -> DataFrame:
    """The official totals of the reference bundle: one row (candidate_total, party_total)."""
    schema = "constituency struct<total_candidate_votes: long>, party_list struct<total_party_votes: long>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.col("constituency.total_candidate_votes").alias("candidate_total"), F.col("party_list.total_party_votes").alias("party_total"))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature: its properties as a map, its geometry as text."""
    raw = spark.read.schema("features array<string>").option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f"))
    return f.select(F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("properties"), F.get_json_object("f", "$.geometry").alias("geometry"))


def geo_areas(features: DataFrame, level: str) -> DataFrame:
    """(area_key, district, subdistrict) of the features; an own area_key goes first, empty names count as none."""
    some = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("properties", F.lit(n)), F.lit("")) for n in names])
    out = features.select(some("area_key").alias("_k"), some("district", "NAME2", "AMPHOE_T").alias("district"), some("subdistrict", "NAME3").alias("subdistrict"), "geometry")
    own: Column = F.col("district") if level == "District" else F.concat("district", F.lit("||"), "subdistrict")
    return out.withColumn("area_key", F.coalesce("_k", own)).drop("_k")


def geo_filter(areas: DataFrame, keys: DataFrame) -> DataFrame:
    """The areas whose key is among keys.area_key."""
    return areas.join(keys.select("area_key").distinct(), "area_key", "left_semi")


def files(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]", content: bool = True) -> DataFrame:
    """(path, length[, content]) of all matching files below a folder, once for each path whatever its case.

    Paths that differ from an earlier one in case only are found in the listing; contents
    are read afterwards, and not shuffled unless there are very many such paths.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    again = rows.select("path", F.row_number().over(Window.partitionBy(F.lower("path")).orderBy("path")).alias("_r")).where("_r > 1").select("path")
    side = F.broadcast(again) if again.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS else again
    return rows.select("path", "length", *(["content"] if content else [])).join(side, "path", "left_anti")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the text files of read pages, one row a file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def ocr_payload(payload: Column) -> Column:
    """struct (text, error) of an OCR service's answer: the message's content, else text, else the first choice."""
    get = lambda p: F.nullif(F.get_json_object(payload, p), F.lit(""))
    failed = F.coalesce(get("$.results[0].success"), get("$.success")) == "false"
    content = F.coalesce(get("$.results[0].message.choices[0].message.content"), get("$.text"), get("$.choices[0].message.content"))
    text = content
    error = F.when(failed, F.coalesce(get("$.results[0].error"), get("$.error"), F.lit("failed"))).when(text.isNull(), "no text in answer")
    return F.struct(F.when(~F.coalesce(failed, F.lit(False)), text).alias("text"), error.alias("error"))
