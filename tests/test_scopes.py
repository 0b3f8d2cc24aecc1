"""Versions and scopes of the totals, tables to show, and sources and sinks of files."""

from pathlib import Path

from psephos.operators import areas, forms, totals
from psephos.sources import readers, sinks

from .conftest import rows


def test_past_totals_follow_the_scope(spark):
    area = spark.createDataFrame([("D", "S", "a", "P", 3), ("D", "T", "a", "P", 4), ("E", "S", "b", "Q", 5), ("D", "S", "c", None, 6)], "district string, subdistrict string, candidate_name string, party_name string, votes long")
    official = spark.createDataFrame([("a", "P", 100)], "candidate_name string, party_name string, official_candidate_total long")
    assert rows(totals.past_candidate_totals(area, official)) == [("a", "P", 100)]
    assert rows(totals.past_candidate_totals(area, official, "D")) == [("a", "P", 7)]
    assert rows(totals.past_candidate_totals(area, official, "D", "T")) == [("a", "P", 4)]
    assert rows(totals.past_candidate_totals(area, official, "none")) == []
    assert rows(totals.past_candidate_totals(area.limit(0), official, "D")) == [("a", "P", 100)]
    whole = spark.createDataFrame([("P", 50)], "party_name string, votes long")
    assert rows(totals.scoped_party_totals(area, whole)) == [("P", 50)]
    assert rows(totals.scoped_party_totals(area, whole, "E")) == [("Q", 5)]
    assert rows(totals.scoped_party_totals(area.limit(0), whole, "E")) == [("P", 50)]


def test_versions(spark):
    votes = spark.createDataFrame([("a", "P", 3), ("a", "P", 4), ("b", None, 1)], "entity_name string, party_name string, votes long")
    assert rows(totals.candidate_totals(votes), "candidate_name") == [("a", "P", 7), ("b", None, 1)]
    assert rows(totals.candidate_totals(votes, "V3"), "votes_2026") == [("b", None, 1), ("a", "P", 3), ("a", "P", 4)]
    frames = {"V1": (votes, votes), "V3": (votes.limit(1), votes)}
    assert totals.votes_of("V3", frames)[0] is frames["V3"][0] and totals.votes_of("V9", frames) is frames["V1"]


def test_display_table_rounds_and_hides(spark):
    df = spark.createDataFrame([("D", "S", 2.5, 1.005, None)], "district string, subdistrict string, votes double, share double, rate double")
    names = {"district": "District", "subdistrict": "Sub-district", "votes": "Votes", "share": "Share %", "rate": "Rate %"}
    shown = areas.display_table(df, names, ["votes"], ["share", "rate"], "District")
    assert shown.columns == ["District", "Votes", "Share %", "Rate %"]
    assert rows(shown) == [("D", 2, 1.0, None)]
    assert "Sub-district" in areas.display_table(df, names, ["votes"], ["share"]).columns


def test_ordered_list_and_feature_summary(spark):
    df = spark.createDataFrame([("D", 2, "x"), ("D", 1, "y"), ("D", 1, "a"), ("E", 5, "z")], "d string, n long, c string")
    assert rows(areas.ordered_list(df, ["d"], "n", "c", "codes"), "d") == [("D", ["a", "y", "x"]), ("E", ["z"])]
    assert rows(totals.feature_summary(df, ["n"])) == [("n", 1.5, 5.0)]


def test_report_without_rows(spark):
    stations = spark.createDataFrame([], "form_type string, ocr_status string, validation_flags string")
    votes = spark.createDataFrame([], "form_type string, votes long")
    reference = spark.createDataFrame([("5_18", 10)], "form_type string, total long")
    got = rows(forms.qa_report(stations, votes, reference, ["ok", "needs_review"]), "section")
    assert got == [("coverage", "5_18", None, 0, 10, 0.0), ("needs_review", None, None, 0, None, None)]


def test_csv_begins_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("ก", 1)], "name string, n long")
    for mark in (True, False):
        sinks.csv(df.coalesce(1), f"{tmp_path}/{mark}", mark)
        part = next(Path(f"{tmp_path}/{mark}").glob("*.csv")).read_bytes()
        assert part == (b"\xef\xbb\xbf" if mark else b"") + "name,n\nก,1\n".encode()
        assert rows(readers.csv(spark, f"{tmp_path}/{mark}", "name string, n long")) == [("ก", 1)]
        assert spark.read.option("header", True).csv(f"{tmp_path}/{mark}").columns == ["name", "n"]


def test_files_of_any_case_come_once(spark, tmp_path):
    for name in ("a.pdf", "A.PDF", "b.Pdf", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    got = readers.files(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], bytes(r.content)) for r in got.collect()) == [("A.PDF", b"A.PDF"), ("b.Pdf", b"b.Pdf")]
    assert readers.files(spark, str(tmp_path), content=False).columns == ["path", "length"]


def test_checkpoints_count_what_they_write(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "key string, n long")
    path = f"{tmp_path}/k"
    assert [sinks.checkpoints(df.limit(1), path), sinks.checkpoints(df, path), sinks.checkpoints(df, path), sinks.checkpoints(df, path, force=True)] == [1, 1, 0, 2]
    assert rows(spark.read.parquet(path), "key") == [("x", 1), ("y", 2)]
