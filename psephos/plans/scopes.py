"""Queries for versions of the totals, both elections' totals by scope, tables to show and the report on what was read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.functions.pdsem import share
from psephos.operators import areas, forms, totals
from psephos.plans.analytics import KEY, SUB, SUM, _winners, query
from psephos.plans.extras import _FLAGS, _STATUS, _with_status
from psephos.plans.fixture import Tables

_VERSIONS = "+ u AS (SELECT unnest(['V1', 'V2', 'V3', 'V4', 'none']) AS version)"
_IN = "version IN ('V1', 'none') OR (version = 'V2' AND past) OR (version = 'V3' AND NOT past) OR (version = 'V4' AND district = 'ASIA')"


@query("p14_version_dispatch", f"{_VERSIONS} SELECT version, form_type, {SUM} AS votes FROM v JOIN u ON {_IN} GROUP BY 1, 2")
def p14(t: Tables) -> DataFrame:
    frames = {
        "V1": (t.candidate, t.party), "V2": (t.past_candidate, t.past_party), "V3": (t.now_candidate, t.now_party),
        "V4": (areas.scope(t.candidate, "ASIA"), areas.scope(t.party, "ASIA")),
    }
    chosen = [df.withColumn("version", F.lit(v)) for v in ("V1", "V2", "V3", "V4", "none") for df in totals.votes_of(v, frames)]
    return reduce(DataFrame.unionByName, chosen).groupBy("version", "form_type").agg(F.coalesce(F.sum("votes"), F.lit(0)).alias("votes"))


_HEADINGS = {"area_key": "Area", "winner": "Winner", "winner_votes": "Winner Votes", "margin_votes": "Margin", "margin_pct": "Margin %", "total_votes": "Total Votes"}


@query("p22_display_table", "+ " + _winners("vc", KEY, True, "w") + ' SELECT area_key AS "Area", winner AS "Winner", CAST(winner_votes AS BIGINT) AS "Winner Votes", CAST(margin_votes AS BIGINT) AS "Margin", round_even(margin_pct, 2) AS "Margin %", CAST(total_votes AS BIGINT) AS "Total Votes" FROM w')
def p22(t: Tables) -> DataFrame:
    return areas.display_table(areas.vote_map(t.candidate, SUB), _HEADINGS, ["winner_votes", "margin_votes", "total_votes"], ["margin_pct"])


_REPORT = f"""{_FLAGS}, x AS (SELECT *, {_STATUS} AS ocr_status FROM s), r AS (SELECT form_type, CAST(sum(votes) AS BIGINT) AS n, CAST(sum(votes) + 12345 AS BIGINT) AS reference FROM v GROUP BY 1),
top AS (SELECT split_part(flag, ':', 1) AS flag, count(*) AS n FROM f WHERE flag <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15)
SELECT 'status' AS section, ocr_status AS item, CAST(NULL AS STRING) AS detail, count(*) AS n, CAST(NULL AS BIGINT) AS reference, CAST(NULL AS DOUBLE) AS pct FROM x GROUP BY 2
UNION ALL SELECT 'form_status', form_type, k, count(*) FILTER (WHERE ocr_status = k), NULL, NULL FROM x, (SELECT unnest(['ok', 'needs_review']) AS k) GROUP BY 2, 3
UNION ALL SELECT 'flag', flag, NULL, n, NULL, NULL FROM top
UNION ALL SELECT 'coverage', form_type, NULL, n, reference, n / reference * 100 FROM r
UNION ALL SELECT 'needs_review', NULL, NULL, count(*), NULL, NULL FROM x WHERE ocr_status <> 'ok'"""


@query("q33_qa_report", _REPORT)
def q33(t: Tables) -> DataFrame:
    reference = t.votes.groupBy("form_type").agg((F.sum("votes") + 12345).alias("total"))
    return forms.qa_report(_with_status(t), t.votes, reference, ["ok", "needs_review"])


def _past(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Rows of the previous election by area, and official totals that are one vote higher, so that they can be told apart."""
    rows = t.past_candidate.withColumn("candidate_name", F.col("entity_name"))
    official = rows.groupBy("candidate_name").agg(F.max("party_name").alias("party_name"), (F.sum("votes") + 1).alias("official_candidate_total"))
    return rows, official


@query("q37_past_candidates_in_scope", f"SELECT entity_name AS candidate_name, party_name AS party_name_2023, {SUM} AS votes_2023 FROM vc WHERE past AND district = 'ASIA' AND party_name IS NOT NULL GROUP BY 1, 2")
def q37a(t: Tables) -> DataFrame:
    return totals.past_candidate_totals(*_past(t), "ASIA")


@query("q37_past_candidates_official", "SELECT entity_name AS candidate_name, max(party_name) AS party_name_2023, CAST(sum(votes) + 1 AS BIGINT) AS votes_2023 FROM vc WHERE past GROUP BY 1")
def q37b(t: Tables) -> DataFrame:
    return totals.past_candidate_totals(*_past(t))


@query("q37_past_parties_official", "SELECT trim(entity_name) AS compare_party, CAST(sum(votes) + 1 AS BIGINT) AS votes_2023 FROM vp WHERE past GROUP BY 1")
def q37c(t: Tables) -> DataFrame:
    rows = t.past_party.withColumn("party_name", F.col("entity_name"))
    return totals.scoped_party_totals(rows, rows.groupBy("party_name").agg((F.sum("votes") + 1).alias("votes")))


@query("q37_past_turnout", "SELECT district, subdistrict, sum(voters_present) / sum(eligible_voters) * 100 AS turnout_2023, count(*) AS station_count FROM sc WHERE district = 'ASIA' GROUP BY 1, 2")
def q37d(t: Tables) -> DataFrame:
    summary = t.cstations.groupBy("district", "subdistrict").agg(share(F.sum("voters_present"), F.sum("eligible_voters")).alias("turnout_pct"), F.count("*").alias("station_count"))
    return totals.past_turnout(summary, "ASIA")


@query("q38_current_candidates_official", "SELECT entity_name AS candidate_name, party_name AS party_name_2026, CAST(sum(3 * votes) AS BIGINT) AS votes_2026 FROM vc GROUP BY 1, 2")
def q38(t: Tables) -> DataFrame:
    official = t.candidate.groupBy("entity_name", "party_name").agg(F.sum(3 * F.col("votes")).alias("votes"))
    return totals.candidate_totals(official, "V3")
