"""Operators on small hand-made tables: nulls, ties, empty inputs, text."""

import pytest
from pyspark.sql import functions as F

from psephos.functions import pdsem, thai
from psephos.operators import areas, clean, election2023, forms, manifest, totals
from psephos.sources import readers, sinks
from psephos.streaming import incremental

from .conftest import rows

VOTES = "station_code string, district string, subdistrict string, entity_no int, form_type string, entity_name string, party_name string, votes long"


def test_flags_split_on_both_separators(spark):
    df = spark.createDataFrame([("alpha;bravo|charlie:1",), ("",), (None,)], "validation_flags string")
    assert [r[0] for r in forms.split_flags(df).collect()] == ["alpha", "bravo", "charlie:1"]


@pytest.mark.parametrize(
    ("text", "number"),
    [("๑๒๓", 123), ("1,234 คน", 1234), ("๑,๐๐๐", 1000), ("no digits", None), (None, None)],
)
def test_thai_to_int(spark, text, number):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(thai.to_int(F.col("s"))).first()[0] == number


@pytest.mark.parametrize(
    ("word", "number"),
    [("หนึ่งร้อยยี่สิบเอ็ด", 121), ("สิบ", 10), ("สองพันห้าร้อยถ้วน", 2500), ("หนึ่งล้านสองแสน", 1_200_000), ("ศูนย์", 0), ("คำ", None), ("", None), (None, None)],
)
def test_number_words(word, number):
    assert thai.parse_number_word(word) == number


def test_form_types_and_headers(spark):
    texts = ["ส.ส. 5/18 (บช)", "ส.ส. ๕/๑๘", "ส.ส. 5/16 บัญชีรายชื่อ", "ส.ส.5/17", "none", "หน่วยเลือกตั้งที่ ๑๒ ตำบล กะฮาด อำเภอ เนินสง่า - ๒ -"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows(df.select("i", thai.page_header(F.col("t")).alias("h")).select("i", "h.*"), "i")
    assert [g[1] for g in got] == ["5_18_party", "5_18", "5_16_party", "5_17", None, None]
    assert got[5][2:] == (12, "กะฮาด", "เนินสง่า", 2, True)


def test_file_names(spark):
    names = ["กะฮาด-001-แบ่งเขต.PDF", "ต.กุดน้ำใส-แบ่งเขต_บัญชีรายชื่อ.pdf", "ทต.จัตุรัส ทต.บ้านกอก-แบ่งเขต_บัญชีรายชื่อ.pdf", "02-แบบ ส.ส.5_16-บัญชีรายชื่อ-นอกเขต.pdf", "ต.ลุ่มลำชี แบ่งเขต.PDF", "ต.ลุ่มน้ำชี-บัญชีรายชื่อ.pdf", "x.pdf"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [tuple(r) for r in df.orderBy("i").select(thai.classify_file(F.col("n")).alias("c")).select("c.*").collect()]
    assert got == [
        ("station", "5_18", "กะฮาด", False), ("station", "mixed", "กุดน้ำใส", False), ("station", "mixed", None, True), ("constituency", "5_16_party", None, False),
        ("station", "5_18", "ลุ่มลำชี", False), ("station", "5_18_party", "ลุ่มลำชี", False), ("unknown", None, None, False),
    ]


FORM = """ส.ส. 5/18 หน่วยเลือกตั้งที่ 1 ตำบล กะฮาด อำเภอ เนินสง่า
บัตรดี 30 บัตร (สามสิบ) บัตรเสีย 2 บัตร (สอง) บัตรไม่เลือกผู้สมัครผู้ใด 1 บัตร (หนึ่ง) บัตรเลือกตั้งที่ใช้ 33 บัตร (สามสิบสาม)
<table><tr><th>no</th><th>n</th></tr><tr><td>๑</td><td>นาย ก</td><td>10</td><td>(สิบ)</td></tr><tr><td>2</td><td>พรรค ข</td><td>20<td>ยี่สิบเอ็ด</tr><tr><td>2</td><td>5</td></tr><tr><td>9</td><td>7</td></tr></table>"""


def test_form_pipeline(spark):
    pages = forms.pages(spark.createDataFrame([("อำเภอเนินสง่า/ต.กะฮาด-แบ่งเขต.pdf", 0, "cover"), ("อำเภอเนินสง่า/ต.กะฮาด-แบ่งเขต.pdf", 1, FORM), ("อำเภอเนินสง่า/ต.กะฮาด-แบ่งเขต.pdf", 2, "more"), ("b.pdf", 0, "หน่วยเลือกตั้งที่ 3")], "pdf string, page_idx int, text string"))
    chunks = forms.chunk_pages(pages)
    assert [(r.pdf[-3:], r.chunk, r.page_indices) for r in chunks.orderBy("pdf").collect()] == [("pdf", 1, [0]), ("pdf", 1, [1, 2])]
    roster = spark.createDataFrame([("candidate", 1, "A", "P"), ("candidate", 2, "B", "Q")], "kind string, entity_no long, entity_name string, party_name string")
    stations = spark.createDataFrame([("S-1", "1", "เนินสง่า", "กะฮาด", 0), ("S-2", "1", "เนินสง่า", "อื่น", 1)], "station_code string, station_no string, district string, subdistrict string, seq int")
    out = forms.process(chunks, roster, stations, "p", 2)
    got = {r.error: r for r in out.collect()}
    assert got["form_type_unknown"].station is None
    good = got[None]
    assert (good.station.station_code, good.station.district, good.station.ballots_good, good.station.source_pages) == ("S-1", "เนินสง่า", 30, "1,2")
    assert [(v.entity_no, v.entity_name, v.votes, v.needs_review) for v in good.votes] == [(1, "A", 10, False), (2, "B", 20, True)]
    assert good.station.ocr_status == "ok" and good.station.validation_flags == ""
    s, v = forms.flatten(out)
    assert s.count() == 1 and v.count() == 2


def test_impossible_and_duplicate_votes(spark):
    snapshot = spark.createDataFrame([("a", 10), ("a", 20), ("b", None)], "station_code string, ballots_good long")
    votes = spark.createDataFrame([("a", "d", "s", 1, "5_18", "x", None, 25), ("a", "d", "s", 1, "5_18", "x", None, 5), ("b", "d", "s", 1, "5_18", "x", None, 99), (None, "d", "s", 1, "5_18", "x", None, 1)], VOTES)
    got = rows(clean.clean_votes(votes, clean.most_good(snapshot)).select("station_code", "votes"), "station_code")
    assert got == [("a", 5), ("b", 99)]


def test_heal_in_order(spark):
    s = spark.createDataFrame([("a", "5_18", None, None, None, None, None, None, None)], "station_code string, form_type string, eligible_voters long, voters_present long, ballots_used long, ballots_good long, ballots_spoiled long, ballots_no_vote long, validation_flags string")
    v = spark.createDataFrame([("a", "d", "s", 1, "5_18", "x", None, 7), ("a", "d", "s", 1, "5_18_party", "x", None, 3)], VOTES)
    r = clean.estimate_eligible(clean.heal(s, v)).first()
    assert (r.ballots_good, r.ballots_used, r.voters_present, r.eligible_voters) == (10, 10, 10, 14)
    assert r.validation_flags == "|Recovered_Good_from_Votes|Calculated_Used_via_Sum|Estimated_Present_from_Used|ESTIMATED_ELIGIBLE_71.00%_TURNOUT"


def test_winner_tie_single_and_empty(spark):
    v = spark.createDataFrame([("a", "d", "s", 1, "5_18", "B", None, 5), ("a", "d", "s", 1, "5_18", "A", "P", 5), ("b", "e", "t", 1, "5_18", "A", "P", None), ("b", None, "t", 1, "5_18", "Z", "P", 9)], VOTES)
    got = {r.area_key: r for r in areas.vote_map(v, "Sub-district").collect()}
    assert set(got) == {"d||s", "e||t"}
    assert (got["d||s"].winner, got["d||s"].runner_up, got["d||s"].margin_votes, got["d||s"].margin_pct) == ("A (P)", "B", 0, 0.0)
    assert (got["e||t"].winner_votes, got["e||t"].runner_up, got["e||t"].margin_pct) == (0, "No runner-up", None)
    assert areas.vote_map(v.limit(0), "District").columns == areas.vote_map(v, "District").columns
    assert areas.vote_map(v.limit(0), "District").count() == 0


def test_terciles_by_rank(spark):
    for n in (3, 5, 8, 50):
        df = spark.createDataFrame([(i, i % 4) for i in range(n)] + [(99, None)], "seq int, x int")
        got = {r.seq: r.station_size for r in pdsem.tercile_by_rank(df, "x", "seq").collect()}
        order = sorted(range(n), key=lambda i: (i % 4, i))
        want = {s: "Small" if r * 3 < n - 1 else "Medium" if r * 3 < 2 * (n - 1) else "Large" for r, s in enumerate(order)}
        assert got == want | {99: None}


def test_robust_z_fallbacks(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (1.0, 5.0, None), (9.0, 5.0, None)], "a double, b double, c double")
    got = rows(pdsem.robust_z(df, ["a", "b", "c"]).select("z_a", "z_b", "z_c"))
    assert [g[1:] for g in got] == [(0.0, 0.0)] * 3 and got[2][0] > 2


def test_wide_to_long(spark):
    names = {k: 1 for k in election2023.IDS}
    df = spark.createDataFrame([(1, 2, "d", "p", 2, "D", "S", None, 5, 10, None, 3, 7)], "id int, index_no int, document string, province string, province_number int, district string, subdistrict string, registrar string, station_number int, `เขต_X` int, `บช_X` int, `บช_Y` int, `บช_บัตรเสีย` int")
    wide = election2023.add_area(df, spark.createDataFrame([("D", "S")], "district string, subdistrict string"))
    assert rows(election2023.party_votes(wide).select("party_name", "votes", "area_scope"), "party_name") == [("X", 0, "project_area"), ("Y", 3, "project_area")]
    roster = spark.createDataFrame([(1, "c1", "X"), (2, "c2", "none")], "candidate_no int, candidate_name string, party_name string")
    assert rows(election2023.candidate_votes(wide, roster).select("candidate_name", "votes")) == [("c1", 10)]
    assert names


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", None, 1), ('q"x', "t", None)], "s string, t string, n long")
    sinks.csv(df, f"{tmp_path}/c")
    assert rows(readers.csv(spark, f"{tmp_path}/c", "s string, t string, n long"), "s") == rows(df, "s")
    assert readers.optional_csv(spark, f"{tmp_path}/none", "s string").count() == 0
    assert not sinks.report(df.limit(0), f"{tmp_path}/r")
    keyed = df.select(F.col("s").alias("key"), "n")
    assert sinks.checkpoints(keyed, f"{tmp_path}/k") == 2 and sinks.checkpoints(keyed, f"{tmp_path}/k") == 0
    (tmp_path / "g.json").write_text('{"type":"x","features":[{"properties":{"NAME2":"D","subdistrict":"S"},"geometry":{"type":"Point"}},{"properties":{"area_key":"K","district":""},"geometry":null}]}')
    assert rows(readers.geo_areas(readers.geojson(spark, f"{tmp_path}/g.json"), "Sub-district").select("area_key"), "area_key") == [("D||S",), ("K",)]
    (tmp_path / "s.json").write_text('{"provinces":[{"name":"P","areas":[{"area":2,"stations":[{"code":"36-1","name":"n","district":"D","subdistrict":"S"}]},{"area":1,"stations":[]}]}]}')
    assert rows(readers.nested_stations(spark, f"{tmp_path}/s.json", "P", 2)) == [("36-1", "1", "n", "D", "S")]
    ok = '{"results":[{"success":true,"message":{"choices":[{"message":{"content":"T"}}]}}]}'
    bad = '{"results":[{"success":false,"error":"E"}]}'
    answers = spark.createDataFrame([(1, ok), (2, bad), (3, "{}")], "i int, p string")
    assert rows(answers.select("i", readers.ocr_payload(F.col("p")).alias("x")).select("i", "x.*"), "i") == [(1, "T", None), (2, None, "E"), (3, None, "no text in answer")]


def test_incremental_run_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    df.write.parquet(f"{tmp_path}/in")
    go = lambda: incremental.run_available(spark, f"{tmp_path}/in", "x int", lambda b: b, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert go() >= 1 and go() == 0
    df.write.mode("append").parquet(f"{tmp_path}/in")
    assert go() >= 1
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_failed_pages_do_not_stop_the_rest(spark):
    def read(path, content):
        if path == "bad":
            raise ValueError("x")
        yield 0, content.decode()

    got = rows(forms.render_and_read(spark.createDataFrame([("a", b"t"), ("bad", b"")], "path string, content binary"), read), "pdf")
    assert got == [("a", 0, "t", None), ("bad", None, None, "ValueError: x")]


def test_versions_and_margin(spark):
    v = spark.createDataFrame([("a", "d", "s", 1, "5_18", "A", "P", 10), ("a", "d", "s", 1, "5_18", "B", "Q", 5), ("a", "d", "s", 1, "5_18", "C", "Q", None)], VOTES)
    ref = spark.createDataFrame([("A", 20), ("B", 10), ("D", 0)], "entity_name string, votes long")
    got = {r.entity_name: (r.v1, r.v2, r.v3, r.v1_accuracy_pct) for r in totals.compare_versions(v, ref, v).collect()}
    assert got == {"A": (10, 20, 20, 50.0), "B": (5, 10, 10, 50.0), "C": (0, 0, None, None), "D": (None, None, 0, None)}
    audit = spark.createDataFrame([("f/a.pdf", "1", 10), ("f/A.PDF", "1", 10), ("f/b.pdf", "2", 10), ("f/B.pdf", "3", 10)], "path string, digest string, length long")
    assert [r[0] for r in rows(manifest.file_audit(audit), "path")] == ["KEEP", "REVIEW", "WOULD_DELETE", "REVIEW"]
