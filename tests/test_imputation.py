"""Imputed votes of whole forms against a brute-force search."""

from pathlib import Path

import pytest

from psephos.operators import clean
from psephos.plans import registry
from psephos.plans.fixture import Tables

DATA = "/root/testdata/sf0.001"


def brute(votes, stats, k=10):
    """{(station, entity): votes} of (station, entity, votes, key) rows, every target held against every donor."""
    donors = [v for v in votes if v[2] is not None]
    out = {}
    for station, entity, n, _ in votes:
        if n is None:
            far = []
            for s, e, m, key in donors:
                pairs = [(a, b) for a, b in zip((entity, *stats.get(station, (None, None))), (e, *stats.get(s, (None, None)))) if a is not None and b is not None]
                if pairs:
                    far.append(((4 / len(pairs) * sum((a - b) ** 2 for a, b in pairs)) ** 0.5, key, m))
            near = sorted(far)[:k] or [(0, 0, m) for *_, m, _ in donors]
            n = round(sum(x[2] for x in near) / len(near))
        out[station, entity] = n
    return out


def test_imputation_of_a_small_table(spark):
    votes = [("a", 1, None, 1), ("a", 2, 7, 2), ("b", 1, 4, 3), ("b", 2, 9, 4), ("c", 1, 5, 5), ("c", 2, None, 6), ("d", None, 8, 7), ("d", 3, None, 8), ("e", None, None, 9)]
    stats = {"a": (10, 3), "b": (12, 3), "c": (None, 4), "d": (40, None)}
    got = clean.knn_impute(spark.createDataFrame(votes, "station_code string, entity_no int, votes long, seq long"), spark.createDataFrame([(s, *v) for s, v in stats.items()], "station_code string, eligible_voters long, ballots_good long"), "seq", 2)
    assert {(r.station_code, r.entity_no): r.votes for r in got.collect()} == brute(votes, stats, 2)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
@pytest.mark.parametrize("form", ["party", "candidate"])
def test_all_votes_of_a_form_are_imputed(spark, form):
    t = Tables(spark, DATA)
    votes: dict = {}
    for r in getattr(t, form).collect():
        n, key = votes.get((r.station_code, r.entity_no), (None, r.seq))
        votes[r.station_code, r.entity_no] = max((x for x in (n, r.votes) if x is not None), default=None), min(key, r.seq)
    rows = [(s, e, n if int(s) % 7 else None, key) for (s, e), (n, key) in votes.items()]
    want = brute(rows, {r.station_code: (r.eligible_voters, r.ballots_good) for r in t.cstations.collect()})
    got = registry.queries()[f"q05_knn_impute_{form}"](spark, DATA).collect()
    assert len(got) == len(votes) and {(r.station_code, r.entity_no): r.votes for r in got} == want


def test_imputation_over_many_boxes(spark, monkeypatch):
    from psephos.operators import nearest

    monkeypatch.setattr(nearest, "LEAF", 40)
    monkeypatch.setattr(nearest, "LEAST", 4)
    stats = {str(s): (None if s % 19 == 0 else s * 37 % 211, None if s % 11 == 0 else s * s % 97) for s in range(160)}
    votes = [(str(s), None if (s + e) % 23 == 0 else e, None if s % 7 == 0 else s * e % 101, (s * 5 + e) * 7919 % 10007) for s in range(160) for e in range(1, 6)]
    votes = [v for i, v in enumerate(votes) if v[1] is not None or v[0] not in [w[0] for w in votes[:i] if w[1] is None]]
    got = clean.knn_impute(spark.createDataFrame(votes, "station_code string, entity_no int, votes long, seq long"), spark.createDataFrame([(s, *v) for s, v in stats.items()], "station_code string, eligible_voters long, ballots_good long"), "seq", 3)
    assert {(r.station_code, r.entity_no): r.votes for r in got.collect()} == brute(votes, stats, 3)


@pytest.mark.parametrize("known", [[], [5]])
def test_imputation_without_donors_or_targets(spark, known):
    votes = spark.createDataFrame([("a", 1, n, 1) for n in known] or [("a", 1, None, 1), ("b", 2, None, 2)], "station_code string, entity_no int, votes long, seq long")
    got = clean.knn_impute(votes, spark.createDataFrame([("a", 3, 4)], "station_code string, eligible_voters long, ballots_good long"), "seq")
    assert sorted((r.station_code, r.votes) for r in got.collect()) == ([("a", 5)] if known else [("a", None), ("b", None)])


def test_imputation_of_many_rows_does_not_pair_them_all(spark):
    """3,000 targets and 18,000 donors, all at different places: minutes if each pair is made."""
    import time

    votes = spark.range(21_000).selectExpr("cast(id as string) AS station_code", "cast(id % 5 as int) AS entity_no", "CASE WHEN id % 7 <> 0 THEN id % 1000 END AS votes", "id AS seq")
    stations = spark.range(21_000).selectExpr("cast(id as string) AS station_code", "id * 7919 % 20011 AS eligible_voters", "id * 104729 % 19997 AS ballots_good")
    began = time.monotonic()
    got = {int(r.station_code): r.votes for r in clean.knn_impute(votes, stations, "seq").collect()}
    assert time.monotonic() - began < 60
    at = [(i % 5, i * 7919 % 20011, i * 104729 % 19997) for i in range(21_000)]
    for target in range(0, 21_000, 1_400):
        near = sorted((((4 / 3 * sum((a - b) ** 2 for a, b in zip(at[target], at[i]))) ** 0.5), i) for i in range(21_000) if i % 7)[:10]
        assert got[target] == round(sum(i % 1000 for _, i in near) / 10)
