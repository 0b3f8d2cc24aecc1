"""Analytic queries by id, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions import pdsem
from psephos.operators import areas, clean, totals
from psephos.plans.fixture import Tables, oracle

Query = Callable[[Tables], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

SUB, DIS = "Sub-district", "District"
KEY = "concat(district, '||', subdistrict)"
SELECTED = "PROMO"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        REGISTRY[name] = (f, None if sql is None else oracle(sql))
        return f

    return put


def _winners(votes: str, key: str, constituency: bool, name: str) -> str:
    """CTEs of the votes by key and name, and of the winners by key."""
    fields = "entity_name, party_name" if constituency else "entity_name"
    order = "votes DESC, entity_name NULLS LAST" + (", party_name NULLS LAST" if constituency else "")
    label = "CASE WHEN party_name IS NOT NULL THEN concat(entity_name, ' (', party_name, ')') ELSE entity_name END" if constituency else "entity_name"
    party = "coalesce(party_name, entity_name)" if constituency else "entity_name"
    return f"""
    {name}_g AS (SELECT {key} AS area_key, {fields}, CAST(coalesce(sum(votes), 0) AS BIGINT) AS votes FROM {votes} WHERE {key} IS NOT NULL GROUP BY ALL),
    {name}_r AS (SELECT *, {label} AS lab, {party} AS par, row_number() OVER (PARTITION BY area_key ORDER BY {order}) AS r FROM {name}_g),
    {name} AS (SELECT area_key, CAST(sum(votes) AS BIGINT) AS total_votes, max(CASE WHEN r = 1 THEN lab END) AS winner, max(CASE WHEN r = 1 THEN par END) AS winner_party, max(CASE WHEN r = 1 THEN votes END) AS winner_votes,
      coalesce(max(CASE WHEN r = 2 THEN lab END), 'No runner-up') AS runner_up, coalesce(max(CASE WHEN r = 2 THEN votes END), 0) AS runner_up_votes,
      max(CASE WHEN r = 1 THEN votes END) - coalesce(max(CASE WHEN r = 2 THEN votes END), 0) AS margin_votes,
      CASE WHEN sum(votes) > 0 THEN (max(CASE WHEN r = 1 THEN votes END) - coalesce(max(CASE WHEN r = 2 THEN votes END), 0)) / sum(votes) * 100 END AS margin_pct
      FROM {name}_r GROUP BY area_key)"""


STATION_MAP = "SELECT {key} AS area_key, count(DISTINCT station_code) AS stations, CAST(coalesce(sum(eligible_voters), 0) AS BIGINT) AS eligible_voters, CAST(coalesce(sum(voters_present), 0) AS BIGINT) AS voters_present, CASE WHEN sum(eligible_voters) > 0 THEN coalesce(sum(voters_present), 0) / sum(eligible_voters) * 100 END AS turnout_pct FROM sc WHERE {key} IS NOT NULL GROUP BY 1"

BOTH = """
  ca AS (SELECT {keys}, party_name, CAST(coalesce(sum(votes), 0) AS BIGINT) AS candidate_votes FROM vc WHERE party_name IS NOT NULL GROUP BY ALL),
  pa AS (SELECT {keys}, entity_name AS party_name, CAST(coalesce(sum(votes), 0) AS BIGINT) AS party_list_votes FROM vp GROUP BY ALL),
  bo AS (SELECT {names}, party_name, coalesce(candidate_votes, 0) AS candidate_votes, coalesce(party_list_votes, 0) AS party_list_votes FROM ca FULL JOIN pa USING ({names}, party_name)),
  bt AS (SELECT *, sum(candidate_votes) OVER (PARTITION BY {by}) AS ct, sum(party_list_votes) OVER (PARTITION BY {by}) AS pt FROM bo),
  ix AS (SELECT *, CASE WHEN ct > 0 THEN candidate_votes / ct * 100 ELSE 0.0 END AS candidate_share_pct, CASE WHEN pt > 0 THEN party_list_votes / pt * 100 ELSE 0.0 END AS party_list_share_pct FROM bt)"""
BY_SUB = BOTH.format(keys=f"{KEY} AS area_key, district, subdistrict", names="area_key, district, subdistrict", by="area_key")
BY_DIS = BOTH.format(keys="district AS area_key, district", names="area_key, district", by="area_key")
BY_STATION = BOTH.format(keys="station_code", names="station_code", by="station_code")
SPLIT = BY_STATION + """,
  sg AS (SELECT station_code, party_name AS split_party, candidate_share_pct, party_list_share_pct, candidate_share_pct - party_list_share_pct AS split_gap_pp, abs(candidate_share_pct - party_list_share_pct) AS split_abs_gap_pp,
    row_number() OVER (PARTITION BY station_code ORDER BY abs(candidate_share_pct - party_list_share_pct) DESC, party_name) AS r FROM ix)"""
INDEX = "candidate_votes, party_list_votes, candidate_share_pct, party_list_share_pct, candidate_share_pct - party_list_share_pct AS personal_vote_index_pp, abs(candidate_share_pct - party_list_share_pct) AS abs_personal_vote_index_pp, candidate_votes - party_list_votes AS gap_votes"

STRENGTH = """
  st_g AS (SELECT station_code, entity_name, party_name, CAST(coalesce(sum(votes), 0) AS BIGINT) AS votes FROM vc GROUP BY ALL),
  st_r AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY votes DESC, entity_name NULLS LAST, party_name NULLS LAST) AS r FROM st_g),
  st AS (SELECT station_code, max(CASE WHEN r = 1 THEN entity_name END) AS winner_candidate, max(CASE WHEN r = 1 THEN party_name END) AS winner_party, max(CASE WHEN r = 1 THEN votes END) AS winner_votes,
    coalesce(max(CASE WHEN r = 2 THEN entity_name END), 'No runner-up') AS runner_up_candidate, coalesce(max(CASE WHEN r = 2 THEN votes END), 0) AS runner_up_votes, CAST(sum(votes) AS BIGINT) AS candidate_total_votes,
    CASE WHEN sum(votes) > 0 THEN max(CASE WHEN r = 1 THEN votes END) / sum(votes) * 100 END AS winner_share_pct,
    CASE WHEN sum(votes) > 0 THEN (max(CASE WHEN r = 1 THEN votes END) - coalesce(max(CASE WHEN r = 2 THEN votes END), 0)) / sum(votes) * 100 END AS margin_pct FROM st_r GROUP BY station_code)"""
BASE = """
  ba AS (SELECT station_code, min(station_no) AS station_no, min(district) AS district, min(subdistrict) AS subdistrict, CAST(coalesce(sum(eligible_voters), 0) AS BIGINT) AS eligible_voters, CAST(coalesce(sum(voters_present), 0) AS BIGINT) AS voters_present,
    CAST(coalesce(sum(ballots_used), 0) AS BIGINT) AS ballots_used, CAST(coalesce(sum(ballots_spoiled), 0) AS BIGINT) AS ballots_spoiled, CAST(coalesce(sum(ballots_no_vote), 0) AS BIGINT) AS ballots_no_vote, coalesce(string_agg(DISTINCT validation_flags, '; ' ORDER BY validation_flags), '') AS validation_flags,
    CASE WHEN sum(eligible_voters) > 0 THEN coalesce(sum(voters_present), 0) / sum(eligible_voters) * 100 END AS turnout_pct, CASE WHEN sum(ballots_used) > 0 THEN coalesce(sum(ballots_spoiled), 0) / sum(ballots_used) * 100 END AS spoiled_pct,
    CASE WHEN sum(ballots_used) > 0 THEN coalesce(sum(ballots_no_vote), 0) / sum(ballots_used) * 100 END AS no_vote_pct FROM sc GROUP BY station_code)"""
_Z = list(areas.REVIEW)
ANOMALY = f"""{STRENGTH.lstrip()},{SPLIT},{BASE},
  an AS (SELECT ba.station_code, district, subdistrict, turnout_pct, spoiled_pct, no_vote_pct, coalesce(winner_share_pct, 0.0) AS winner_share_pct, coalesce(margin_pct, 0.0) AS margin_pct, coalesce(split_abs_gap_pp, 0.0) AS split_abs_gap_pp FROM ba LEFT JOIN st USING (station_code) LEFT JOIN (SELECT * FROM sg WHERE r = 1) q USING (station_code)),
  me AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in _Z)} FROM an),
  md AS (SELECT {", ".join(f"median(abs({c} - m_{c})) AS d_{c}, stddev_pop({c}) AS s_{c}" for c in _Z)} FROM an, me),
  zz AS (SELECT station_code, district, subdistrict, {", ".join(f"least(abs(coalesce(CASE WHEN d_{c} > 0 THEN CAST(0.6745 AS DOUBLE) * ({c} - m_{c}) / d_{c} WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END, 0.0)), 4.0) AS z_{c}" for c in _Z)} FROM an, me, md),
  sr AS (SELECT *, least(greatest(({" + ".join(["CAST(0.0 AS DOUBLE)", *[f"z_{c} * CAST({areas.REVIEW[c][0]} AS DOUBLE)" for c in _Z]])}) / 4 * 100, 0.0), 100.0) AS review_score FROM zz),
  rv AS (SELECT *, CASE WHEN review_score <= 35 THEN 'Normal' WHEN review_score <= 55 THEN 'Watch' WHEN review_score <= 75 THEN 'Review' ELSE 'High' END AS review_level,
    coalesce(nullif(concat_ws(', ', {", ".join(f"CASE WHEN z_{c} >= 2 THEN '{areas.REVIEW[c][1]}' END" for c in _Z)}), ''), 'overall pattern') AS review_reason FROM sr)"""
SUM = "CAST(coalesce(sum(votes), 0) AS BIGINT)"
NOW = "(SELECT * FROM {t} WHERE NOT past)"
PAST = "(SELECT * FROM {t} WHERE past)"


@query("q06_overview", "SELECT count(*) AS stations, CAST(sum(eligible_voters) AS BIGINT) AS eligible_voters, CAST(sum(voters_present) AS BIGINT) AS voters_present, CAST(sum(ballots_used) AS BIGINT) AS ballots_used, CAST(sum(ballots_spoiled) AS BIGINT) AS ballots_spoiled, CAST(sum(ballots_no_vote) AS BIGINT) AS ballots_no_vote, sum(voters_present) / sum(eligible_voters) * 100 AS turnout_pct, sum(ballots_spoiled) / sum(ballots_used) * 100 AS spoiled_pct, sum(ballots_no_vote) / sum(ballots_used) * 100 AS no_vote_pct FROM sc")
def q06(t: Tables) -> DataFrame:
    return totals.overview(t.cstations)


@query("q07_turnout_by_subdistrict", "SELECT subdistrict, CAST(coalesce(sum(eligible_voters), 0) AS BIGINT) AS eligible_voters, CAST(coalesce(sum(voters_present), 0) AS BIGINT) AS voters_present, coalesce(sum(voters_present), 0) / nullif(sum(eligible_voters), 0) * 100 AS turnout_pct FROM sc GROUP BY subdistrict")
def q07(t: Tables) -> DataFrame:
    return totals.turnout_by(t.cstations)


@query("q08_candidate_totals", f"SELECT entity_name, {SUM} AS votes, {SUM} / (SELECT sum(votes) FROM vc) * 100 AS share_pct FROM vc GROUP BY entity_name")
def q08(t: Tables) -> DataFrame:
    return totals.totals(t.candidate)


@query("q08_party_top3", f"SELECT entity_name, {SUM} AS votes, {SUM} / (SELECT sum(votes) FROM vp) * 100 AS share_pct FROM vp GROUP BY entity_name ORDER BY votes DESC, entity_name LIMIT 3")
def q08p(t: Tables) -> DataFrame:
    return totals.top(totals.totals(t.party), 3, "votes", "entity_name")


@query("q09_winning_margin", f"+ g AS (SELECT entity_name, {SUM} AS votes FROM vc GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY votes DESC, entity_name) AS r FROM g) SELECT a.entity_name AS winner, a.votes AS winner_votes, b.entity_name AS runner_up, b.votes AS runner_up_votes, a.votes - b.votes AS margin_votes, (a.votes - b.votes) / (SELECT sum(voters_present) FROM sc) * 100 AS margin_pct, (a.votes - b.votes) / (SELECT sum(voters_present) FROM sc) * 100 < 5.0 AS narrow FROM r a, r b WHERE a.r = 1 AND b.r = 2")
def q09(t: Tables) -> DataFrame:
    return totals.winning_margin(t.candidate, t.cstations)


@query("q09b_margin_by_version", f"+ g AS (SELECT 'V1' AS version, entity_name, {SUM} AS votes FROM vc GROUP BY 2 UNION ALL SELECT 'V3', entity_name, {SUM} FROM (SELECT * FROM vc WHERE NOT past) x GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY votes DESC, entity_name) AS r FROM g) SELECT version, CAST(sum(votes) AS BIGINT) AS total_votes, max(CASE WHEN r = 1 THEN entity_name END) AS winner, max(CASE WHEN r = 1 THEN votes END) AS winner_votes, max(CASE WHEN r = 2 THEN votes END) AS runner_up_votes, max(CASE WHEN r = 1 THEN votes END) - max(CASE WHEN r = 2 THEN votes END) AS margin_votes, (max(CASE WHEN r = 1 THEN votes END) - max(CASE WHEN r = 2 THEN votes END)) / sum(votes) * 100 AS margin_pct FROM r GROUP BY version")
def q09b(t: Tables) -> DataFrame:
    return totals.margin_by_version({"V1": t.candidate, "V3": t.now_candidate})


@query("q10_split_ticket", f"+ a AS (SELECT party_name AS party, {SUM} AS candidate_votes FROM vc WHERE party_name IS NOT NULL GROUP BY 1), b AS (SELECT entity_name AS party, {SUM} AS party_list_votes FROM vp GROUP BY 1) SELECT party, coalesce(candidate_votes, 0) AS candidate_votes, coalesce(party_list_votes, 0) AS party_list_votes, coalesce(candidate_votes, 0) - coalesce(party_list_votes, 0) AS vote_gap, coalesce(candidate_votes, 0) + coalesce(party_list_votes, 0) AS total_combined FROM a FULL JOIN b USING (party)")
def q10(t: Tables) -> DataFrame:
    return totals.split_ticket(t.candidate, t.party)


_TOP = "tp AS (SELECT entity_name FROM vp GROUP BY 1 ORDER BY coalesce(sum(votes), 0) DESC, entity_name LIMIT {n})"
_SIZED = " SELECT station_size, entity_name, " + SUM + " AS votes FROM vp JOIN tp USING (entity_name) JOIN sz USING (station_code) WHERE station_size IS NOT NULL GROUP BY ALL"


@query("q11_size_by_rank", "+ " + _TOP.format(n=5) + ", rk AS (SELECT station_code, row_number() OVER (ORDER BY eligible_voters, station_no) - 1 AS r, count(*) OVER () AS n FROM sc WHERE eligible_voters IS NOT NULL), sz AS (SELECT station_code, CASE WHEN r * 3 < n - 1 THEN 'Small' WHEN r * 3 < 2 * (n - 1) THEN 'Medium' ELSE 'Large' END AS station_size FROM rk)" + _SIZED)
def q11(t: Tables) -> DataFrame:
    return totals.size_preference(t.cstations, t.party, 5, True)


@query("q11_size_by_value", "+ " + _TOP.format(n=3) + ", e AS (SELECT quantile_cont(eligible_voters, 1/3) AS a, quantile_cont(eligible_voters, 2/3) AS b FROM sc), sz AS (SELECT station_code, CASE WHEN eligible_voters <= a THEN 'Small' WHEN eligible_voters <= b THEN 'Medium' WHEN eligible_voters IS NOT NULL THEN 'Large' END AS station_size FROM sc, e)" + _SIZED)
def q11b(t: Tables) -> DataFrame:
    return totals.size_preference(t.cstations, t.party, 3, False)


@query("q12_missing_stations", "SELECT CAST(s_suppkey AS STRING) AS station_code, s_name AS station_name FROM supplier WHERE s_suppkey NOT IN (SELECT station_no FROM sc WHERE eligible_voters IS NOT NULL)")
def q12(t: Tables) -> DataFrame:
    spark = t.votes.sparkSession
    reference = spark.read.parquet(f"{t.sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("station_code"), F.col("s_name").alias("station_name"))
    marked = t.cstations.where("eligible_voters IS NOT NULL").withColumn("station_code", F.concat("station_code", F.when(F.col("station_no") % 2 == 0, "?").otherwise("")))
    return totals.missing_stations(reference, marked)


_V3 = "(SELECT entity_name, CAST(sum(3 * votes) AS BIGINT) AS v3 FROM vc GROUP BY 1)"


@query("q13_version_comparison", f"+ a AS (SELECT entity_name, {SUM} AS v1 FROM vc GROUP BY 1), b AS {_V3}, c AS (SELECT entity_name, {SUM} AS v4 FROM vc WHERE past GROUP BY 1), o AS (SELECT (SELECT sum(v3) FROM b) / (SELECT sum(v1) FROM a) AS f), j AS (SELECT entity_name, v1, CAST(round_even(v1 * f, 0) AS BIGINT) AS v2, v3, v4 FROM a, o JOIN b ON true LEFT JOIN c USING (entity_name) WHERE a.entity_name = b.entity_name) SELECT *, round_even(v1 / v3 * 100, 1) AS v1_accuracy_pct, round_even(v2 / v3 * 100, 1) AS v2_accuracy_pct, round_even(v4 / v3 * 100, 1) AS v4_accuracy_pct FROM j")
def q13(t: Tables) -> DataFrame:
    v3 = t.candidate.groupBy("entity_name").agg(F.sum(3 * F.col("votes")).alias("votes"))
    return totals.compare_versions(t.candidate, v3, t.past_candidate)


@query("q14b_scaled_rows", "SELECT seq, CAST(round_even(votes * ((SELECT sum(3 * votes) FROM vc) / (SELECT sum(votes) FROM vc)), 0) AS BIGINT) AS votes FROM vc")
def q14b(t: Tables) -> DataFrame:
    return totals.scaled_rows(t.candidate, t.candidate.agg((3 * F.sum("votes")).alias("total"))).select("seq", "votes")


@query("q15_kpi", "SELECT (SELECT count(*) FROM sc) AS stations, (SELECT CAST(sum(eligible_voters) AS BIGINT) FROM sc) AS eligible_voters, (SELECT CAST(sum(voters_present) AS BIGINT) FROM sc) AS voters_present, (SELECT sum(voters_present) / sum(eligible_voters) * 100 FROM sc) AS turnout_pct, (SELECT CAST(sum(votes) AS BIGINT) FROM vc) AS candidate_votes, (SELECT CAST(sum(votes) AS BIGINT) FROM vp) AS party_votes")
def q15(t: Tables) -> DataFrame:
    return totals.kpi(t.cstations, t.candidate, t.party)


@query("q16_station_map", STATION_MAP.format(key=KEY))
def q16(t: Tables) -> DataFrame:
    return areas.station_map(t.cstations, SUB)


@query("q17_winner_by_area", "+ " + _winners("vc", KEY, True, "w") + " SELECT * FROM w")
def q17(t: Tables) -> DataFrame:
    return areas.vote_map(t.candidate, SUB)


@query("q17_party_winner_by_district", "+ " + _winners("vp", "district", False, "w") + " SELECT * FROM w")
def q17p(t: Tables) -> DataFrame:
    return areas.vote_map(t.party, DIS, False)


@query("q18_map_data", "+ " + _winners("vc", KEY, True, "w") + f", m AS ({STATION_MAP.format(key=KEY)}), g AS (SELECT DISTINCT concat(r_name, '||', n_name) AS area_key FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT area_key, coalesce(stations, 0) AS stations, coalesce(eligible_voters, 0) AS eligible_voters, coalesce(voters_present, 0) AS voters_present, turnout_pct, coalesce(total_votes, 0) AS total_votes, coalesce(winner, 'No vote rows in current scope') AS winner, coalesce(winner_party, 'No data') AS winner_party, coalesce(winner_votes, 0) AS winner_votes, coalesce(runner_up, 'No vote rows') AS runner_up, coalesce(runner_up_votes, 0) AS runner_up_votes, coalesce(margin_votes, 0) AS margin_votes, margin_pct, coalesce(total_votes, 0) > 0 AS has_votes FROM g LEFT JOIN m USING (area_key) LEFT JOIN w USING (area_key)")
def q18(t: Tables) -> DataFrame:
    spark = t.votes.sparkSession
    n, r = (spark.read.parquet(f"{t.sf_dir}/{x}.parquet") for x in ("nation", "region"))
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.concat("r_name", F.lit("||"), "n_name").alias("area_key")).distinct()
    return areas.map_data(geo, t.cstations, t.candidate, SUB)


@query("q19_station_base", "+ " + BASE + " SELECT * FROM ba")
def q19(t: Tables) -> DataFrame:
    return areas.station_base(t.cstations)


@query("w04_station_strength", "+ " + STRENGTH + " SELECT * FROM st")
def w04(t: Tables) -> DataFrame:
    return areas.station_strength(t.candidate)


@query("q20_split_gap", "+ " + SPLIT + " SELECT station_code, split_party, candidate_share_pct, party_list_share_pct, split_gap_pp, split_abs_gap_pp FROM sg WHERE r = 1")
def q20(t: Tables) -> DataFrame:
    return areas.split_gap(t.candidate, t.party)


@query("q21_station_anomaly", "+ " + ANOMALY + " SELECT station_code, round(review_score, 6) AS review_score, review_level, review_reason FROM rv")
def q21(t: Tables) -> DataFrame:
    return areas.station_anomaly(t.cstations, t.candidate, t.party).select("station_code", F.round("review_score", 6).alias("review_score"), "review_level", "review_reason")


@query("q22_anomaly_area", "+ " + ANOMALY + f" SELECT {KEY} AS area_key, min(district) AS district, min(subdistrict) AS subdistrict, count(DISTINCT station_code) AS stations, count(*) FILTER (WHERE review_score >= 55) AS flagged_stations, round(max(review_score), 6) AS max_review_score, round(avg(review_score), 6) AS avg_review_score FROM rv GROUP BY 1")
def q22(t: Tables) -> DataFrame:
    out = areas.anomaly_area(areas.station_anomaly(t.cstations, t.candidate, t.party), SUB)
    return out.withColumn("max_review_score", F.round("max_review_score", 6)).withColumn("avg_review_score", F.round("avg_review_score", 6))


@query("q23_party_area_index", "+ " + BY_SUB + f" SELECT area_key, district, subdistrict, party_name, {INDEX} FROM ix")
def q23(t: Tables) -> DataFrame:
    return areas.party_area_index(t.candidate, t.party, SUB)


@query("q23_party_district_index", "+ " + BY_DIS + f" SELECT area_key, district, 'All' AS subdistrict, party_name, {INDEX} FROM ix")
def q23d(t: Tables) -> DataFrame:
    return areas.party_area_index(t.candidate, t.party, DIS)


@query("q24_party_index_overall", f"+ a AS (SELECT party_name, {SUM} AS candidate_votes FROM vc WHERE party_name IS NOT NULL GROUP BY 1), b AS (SELECT entity_name AS party_name, {SUM} AS party_list_votes FROM vp GROUP BY 1), ix AS (SELECT party_name, coalesce(candidate_votes, 0) AS candidate_votes, coalesce(party_list_votes, 0) AS party_list_votes, coalesce(candidate_votes, 0) / (SELECT sum(candidate_votes) FROM a) * 100 AS candidate_share_pct, coalesce(party_list_votes, 0) / (SELECT sum(party_list_votes) FROM b) * 100 AS party_list_share_pct FROM a FULL JOIN b USING (party_name)) SELECT party_name, {INDEX} FROM ix")
def q24(t: Tables) -> DataFrame:
    return areas.party_index_overall(t.candidate, t.party)


@query("q25_hotspots", "+ " + _winners("vc", "district", True, "w") + f", m AS ({STATION_MAP.format(key='district')}), p AS (SELECT district AS area_key, {SUM} AS party_total_votes, CAST(coalesce(sum(CASE WHEN entity_name = '{SELECTED}' THEN votes END), 0) AS BIGINT) AS selected_party_votes FROM vp GROUP BY 1) SELECT m.*, w.* EXCLUDE (area_key), coalesce(party_total_votes, 0) AS party_total_votes, coalesce(selected_party_votes, 0) AS selected_party_votes, CASE WHEN party_total_votes > 0 THEN selected_party_votes / party_total_votes * 100 ELSE 0.0 END AS selected_party_share_pct FROM m FULL JOIN w ON m.area_key = w.area_key LEFT JOIN p ON m.area_key = p.area_key")
def q25(t: Tables) -> DataFrame:
    return areas.hotspots(t.cstations, t.candidate, t.party, DIS, SELECTED)


_SWING = """+ a AS (SELECT {key} AS area_key, district, {sub} AS subdistrict, trim(entity_name) AS compare_party, CAST(coalesce(sum(votes), 0) AS BIGINT) AS votes_2023 FROM vp WHERE past GROUP BY ALL),
  b AS (SELECT {key} AS area_key, district, {sub} AS subdistrict, trim(entity_name) AS compare_party, CAST(coalesce(sum(votes), 0) AS BIGINT) AS votes_2026 FROM vp WHERE NOT past GROUP BY ALL),
  x AS (SELECT *, CASE WHEN sum(votes_2023) OVER (PARTITION BY area_key) > 0 THEN votes_2023 / sum(votes_2023) OVER (PARTITION BY area_key) * 100 ELSE 0.0 END AS share_2023 FROM a),
  y AS (SELECT *, CASE WHEN sum(votes_2026) OVER (PARTITION BY area_key) > 0 THEN votes_2026 / sum(votes_2026) OVER (PARTITION BY area_key) * 100 ELSE 0.0 END AS share_2026 FROM b)
  SELECT area_key, district, subdistrict, compare_party, coalesce(votes_2023, 0) AS votes_2023, coalesce(share_2023, 0.0) AS share_2023, coalesce(votes_2026, 0) AS votes_2026, coalesce(share_2026, 0.0) AS share_2026, coalesce(share_2026, 0.0) - coalesce(share_2023, 0.0) AS swing_pp FROM x FULL JOIN y USING (area_key, district, subdistrict, compare_party)"""


def _past(df: DataFrame) -> DataFrame:
    return df.withColumn("party_name", F.col("entity_name"))


@query("q26_party_swing", _SWING.format(key=KEY, sub="subdistrict"))
def q26(t: Tables) -> DataFrame:
    return areas.party_swing(t.now_party, _past(t.past_party), SUB)


@query("q26_party_swing_district", _SWING.format(key="district", sub="'All'"))
def q26d(t: Tables) -> DataFrame:
    return areas.party_swing(t.now_party, _past(t.past_party), DIS)


_PARTIES = f"+ a AS (SELECT trim(entity_name) AS compare_party, {SUM} AS votes_2023 FROM vp WHERE past GROUP BY 1), b AS (SELECT trim(entity_name) AS compare_party, {SUM} AS votes_2026 FROM vp WHERE NOT past GROUP BY 1), j AS (SELECT compare_party, coalesce(votes_2023, 0) AS votes_2023, coalesce(votes_2026, 0) AS votes_2026 FROM a FULL JOIN b USING (compare_party)), h AS (SELECT *, votes_2023 / (SELECT sum(votes_2023) FROM j) * 100 AS share_2023, votes_2026 / (SELECT sum(votes_2026) FROM j) * 100 AS share_2026 FROM j)"


@query("q27_swing_summary", _PARTIES + " SELECT *, share_2026 - share_2023 AS swing_pp, compare_party AS party FROM h")
def q27(t: Tables) -> DataFrame:
    return totals.compare_parties(totals.past_party_totals(_past(t.past_party)), totals.party_totals(t.now_party))


@query("q30_party_comparison_long", _PARTIES + " SELECT compare_party, '2023' AS \"Year\", share_2023 AS share FROM h UNION ALL SELECT compare_party, '2026', share_2026 FROM h")
def q30(t: Tables) -> DataFrame:
    return totals.years_long(totals.compare_parties(totals.past_party_totals(_past(t.past_party)), totals.party_totals(t.now_party)), ["compare_party"], "share", "share")


@query("q28_vote_mismatch", "+ " + _winners("vc", KEY, True, "w") + "," + _winners("vp", KEY, False, "x") + "," + BY_SUB + ", mx AS (SELECT area_key, party_name AS gap_party, abs(candidate_share_pct - party_list_share_pct) AS max_gap_pp, row_number() OVER (PARTITION BY area_key ORDER BY abs(candidate_share_pct - party_list_share_pct) DESC, party_name) AS r FROM ix) SELECT area_key, w.winner AS constituency_winner, w.winner_party AS constituency_winner_party, coalesce(w.total_votes, 0) AS constituency_votes, x.winner AS party_list_winner, coalesce(x.total_votes, 0) AS party_list_votes, gap_party, coalesce(max_gap_pp, 0.0) AS max_gap_pp, w.winner_party IS NOT NULL AND x.winner IS NOT NULL AS comparable, coalesce(w.winner_party <> x.winner, false) AS winner_mismatch, CASE WHEN w.winner_party IS NOT NULL AND x.winner IS NOT NULL THEN coalesce(max_gap_pp, 0.0) + CASE WHEN w.winner_party <> x.winner THEN 15.0 ELSE 0.0 END ELSE 0.0 END AS mismatch_score, CASE WHEN w.winner_party IS NULL OR x.winner IS NULL THEN 'No data' WHEN w.winner_party <> x.winner THEN 'Yes' ELSE 'No' END AS mismatch_label FROM w FULL JOIN x USING (area_key) LEFT JOIN (SELECT * FROM mx WHERE r = 1) q USING (area_key)")
def q28(t: Tables) -> DataFrame:
    return areas.vote_mismatch(t.candidate, t.party, SUB)


@query("q29_same_candidate", f"+ a AS (SELECT entity_name AS candidate_name, max(party_name) AS party_name_2023, {SUM} AS votes_2023 FROM vc WHERE past GROUP BY 1), b AS (SELECT entity_name AS candidate_name, party_name AS party_name_2026, {SUM} AS votes_2026 FROM vc WHERE NOT past GROUP BY 1, 2) SELECT *, votes_2026 - votes_2023 AS change, votes_2023 / (SELECT sum(votes_2023) FROM a) * 100 AS share_2023, votes_2026 / (SELECT sum(votes_2026) FROM b) * 100 AS share_2026 FROM a JOIN b USING (candidate_name)")
def q29(t: Tables) -> DataFrame:
    past = t.past_candidate.groupBy(F.col("entity_name").alias("candidate_name")).agg(F.max("party_name").alias("party_name_2023"), pdsem.sum0("votes").alias("votes_2023"))
    return totals.same_candidate(past, totals.candidate_totals(t.now_candidate))


@query("q31_turnout_change", "+ a AS (SELECT district, subdistrict, sum(voters_present) / nullif(sum(eligible_voters), 0) * 100 AS turnout_2023 FROM sp GROUP BY 1, 2), b AS (SELECT district, subdistrict, CAST(coalesce(sum(eligible_voters), 0) AS BIGINT) AS eligible, CAST(coalesce(sum(voters_present), 0) AS BIGINT) AS present, CASE WHEN sum(eligible_voters) > 0 THEN coalesce(sum(voters_present), 0) / sum(eligible_voters) * 100 END AS turnout_2026 FROM sc GROUP BY 1, 2) SELECT *, turnout_2026 - turnout_2023 AS change FROM a JOIN b USING (district, subdistrict) WHERE turnout_2023 IS NOT NULL AND turnout_2026 IS NOT NULL ORDER BY abs(turnout_2026 - turnout_2023) DESC, district, subdistrict LIMIT 12")
def q31(t: Tables) -> DataFrame:
    past = t.pstations.groupBy("district", "subdistrict").agg(F.sum("voters_present").alias("p"), F.sum("eligible_voters").alias("e")).select("district", "subdistrict", pdsem.share(F.col("p"), F.col("e")).alias("turnout_2023"))
    return totals.turnout_change(past, t.cstations)


_HEAL = """+ k AS (SELECT station_code, CAST(coalesce(sum(votes), 0) AS BIGINT) AS c FROM v GROUP BY 1),
  h1 AS (SELECT s.* REPLACE (coalesce(ballots_no_vote, 0) AS ballots_no_vote, coalesce(ballots_spoiled, 0) AS ballots_spoiled), c, ballots_good IS NULL AS m1, coalesce(ballots_good, c) AS good FROM s LEFT JOIN k USING (station_code)),
  h2 AS (SELECT *, ballots_used IS NULL AS m2, coalesce(ballots_used, good + ballots_spoiled + ballots_no_vote) AS used FROM h1),
  h3 AS (SELECT *, voters_present IS NULL AS m3, coalesce(voters_present, used) AS present FROM h2),
  he AS (SELECT station_code, form_type, eligible_voters, present AS voters_present, used AS ballots_used, good AS ballots_good, ballots_spoiled, ballots_no_vote,
    CASE WHEN m1 OR m2 OR m3 THEN concat(coalesce(validation_flags, ''), CASE WHEN m1 THEN '|Recovered_Good_from_Votes' ELSE '' END, CASE WHEN m2 THEN '|Calculated_Used_via_Sum' ELSE '' END, CASE WHEN m3 THEN '|Estimated_Present_from_Used' ELSE '' END) ELSE validation_flags END AS validation_flags FROM h3)"""


@query("q01_heal", _HEAL + " SELECT * FROM he")
def q01(t: Tables) -> DataFrame:
    return clean.heal(t.stations, t.votes).select("station_code", "form_type", "eligible_voters", "voters_present", "ballots_used", "ballots_good", "ballots_spoiled", "ballots_no_vote", "validation_flags")


@query("q02_estimate_eligible", _HEAL + ", rt AS (SELECT coalesce(avg(voters_present / nullif(eligible_voters, 0)), 0.71) AS rate FROM he) SELECT station_code, form_type, coalesce(eligible_voters, CAST(round_even(voters_present / rate, 0) AS BIGINT)) AS eligible_voters, CASE WHEN eligible_voters IS NULL THEN concat(coalesce(validation_flags, ''), '|ESTIMATED_ELIGIBLE_', printf('%.2f%%', rate * 100), '_TURNOUT') ELSE validation_flags END AS validation_flags FROM he, rt")
def q02(t: Tables) -> DataFrame:
    return clean.estimate_eligible(clean.heal(t.stations, t.votes)).select("station_code", "form_type", "eligible_voters", "validation_flags")


_CAP = "cp AS (SELECT station_code, max(ballots_good) // 100 AS cap FROM s GROUP BY 1), im AS (SELECT v.* REPLACE (CASE WHEN votes > cap THEN NULL ELSE votes END AS votes) FROM v LEFT JOIN cp USING (station_code))"


def _capped(t: Tables) -> DataFrame:
    snapshot = clean.most_good(t.stations).withColumn("ballots_good", F.floor(F.col("ballots_good") / 100))
    return clean.drop_impossible(t.votes, snapshot)


@query("q03_impossible_votes", "+ " + _CAP + " SELECT seq, votes FROM im")
def q03(t: Tables) -> DataFrame:
    return _capped(t).select("seq", "votes")


@query("q04_dedupe_votes", "+ " + _CAP + " SELECT station_code, entity_no, form_type, max(votes) AS votes FROM im GROUP BY 1, 2, 3")
def q04(t: Tables) -> DataFrame:
    return clean.dedupe_votes(_capped(t)).select("station_code", "entity_no", "form_type", "votes")


_KNN = """+ e AS (SELECT station_code, min(eligible_voters) AS e, min(ballots_good) AS g FROM {stations} GROUP BY 1),
  w AS (SELECT station_code, entity_no, CASE WHEN station_no % 7 <> 0 THEN max(votes) END AS votes, min(seq) AS seq FROM {votes} GROUP BY station_code, station_no, entity_no), d AS (SELECT * FROM w LEFT JOIN e USING (station_code)),
  p AS (SELECT a.seq, b.votes AS bv, row_number() OVER (PARTITION BY a.seq ORDER BY sqrt(4 / n * q), b.seq) AS r FROM (SELECT a.seq AS s1, b.seq AS s2, CAST(1 + (a.e IS NOT NULL AND b.e IS NOT NULL)::INT + (a.g IS NOT NULL AND b.g IS NOT NULL)::INT AS DOUBLE) AS n, pow(a.entity_no - b.entity_no, 2) + coalesce(pow(a.e - b.e, 2), 0.0) + coalesce(pow(a.g - b.g, 2), 0.0) AS q FROM d a, d b WHERE a.votes IS NULL AND b.votes IS NOT NULL) x JOIN d a ON a.seq = s1 JOIN d b ON b.seq = s2)
  SELECT station_code, entity_no, CAST(coalesce(d.votes, f) AS BIGINT) AS votes FROM d LEFT JOIN (SELECT seq, round_even(avg(bv), 0) AS f FROM p WHERE r <= 10 GROUP BY 1) y USING (seq)"""


def _imputed(votes: DataFrame, stations: DataFrame) -> DataFrame:
    """All of a form's counts, those of every seventh station missing, filled."""
    base = votes.groupBy("station_code", "station_no", "entity_no").agg(F.max("votes").alias("votes"), F.min("seq").alias("seq"))
    base = base.withColumn("votes", F.when(F.col("station_no") % 7 != 0, F.col("votes"))).drop("station_no")
    stats = stations.groupBy("station_code").agg(F.min("eligible_voters").alias("eligible_voters"), F.min("ballots_good").alias("ballots_good"))
    return clean.knn_impute(base, stats, "seq").select("station_code", "entity_no", "votes")


@query("q05_knn_impute", _KNN.format(votes="vp", stations="sp"))
def q05(t: Tables) -> DataFrame:
    return _imputed(t.party, t.pstations)


@query("q05_knn_impute_party", _KNN.format(votes="vp", stations="sc"))
def q05p(t: Tables) -> DataFrame:
    return _imputed(t.party, t.cstations)


@query("q05_knn_impute_candidate", _KNN.format(votes="vc", stations="sc"))
def q05c(t: Tables) -> DataFrame:
    return _imputed(t.candidate, t.cstations)


@query("p12_geo_filter", "+ z AS (SELECT * FROM s WHERE district = 'ASIA') SELECT seq, votes FROM v WHERE station_code IN (SELECT station_code FROM z)")
def p12(t: Tables) -> DataFrame:
    return areas.geo_filter(t.stations, [t.votes], "ASIA")[1][0].select("seq", "votes")


@query("p21_options", "SELECT DISTINCT subdistrict FROM s WHERE subdistrict IS NOT NULL")
def p21(t: Tables) -> DataFrame:
    return areas.options(t.stations, "subdistrict")


@query("a20_coverage", "SELECT CAST(sum(votes) AS BIGINT) AS votes, (SELECT CAST(sum(3 * votes) AS BIGINT) FROM vc) AS reference, sum(votes) / (SELECT sum(3 * votes) FROM vc) * 100 AS coverage_pct FROM vc")
def a20(t: Tables) -> DataFrame:
    return totals.coverage(t.candidate, t.candidate.agg((3 * F.sum("votes")).alias("total")))


@query("a23_ballot_composition", "SELECT 'Good' AS ballot, CAST(sum(ballots_good) AS BIGINT) AS ballots FROM sc UNION ALL SELECT 'Spoiled', CAST(sum(ballots_spoiled) AS BIGINT) FROM sc UNION ALL SELECT 'No vote', CAST(sum(ballots_no_vote) AS BIGINT) FROM sc")
def a23(t: Tables) -> DataFrame:
    return totals.ballot_composition(t.cstations)


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        return REGISTRY[name][0](Tables(spark, sf_dir))

    return go
