"""Election-shaped views of the star-schema tables, in SQL that Spark and the oracle both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One row for each counted line of a form: candidates on 5_18, parties on 5_18_party; some counts unread.
VOTES = """
SELECT (l_orderkey * 1000 + l_linenumber) * 100000 + l_partkey AS seq,
  CASE WHEN l_linestatus = 'O' THEN '5_18' ELSE '5_18_party' END AS form_type,
  CAST(l_suppkey AS STRING) AS station_code, CAST(l_suppkey AS BIGINT) AS station_no, r_name AS district, n_name AS subdistrict,
  CASE WHEN l_linestatus = 'O' THEN 'candidate' ELSE 'party' END AS entity_kind,
  CASE WHEN l_linestatus = 'O' THEN CAST(substr(p_brand, 7) AS BIGINT) ELSE CAST(ascii(p_type) + length(p_type) AS BIGINT) END AS entity_no,
  CASE WHEN l_linestatus = 'O' THEN p_brand ELSE p_type END AS entity_name,
  CASE WHEN l_linestatus = 'O' AND l_partkey % 29 <> 0 THEN p_type END AS party_name,
  CASE WHEN l_orderkey % 13 <> 0 THEN CAST(l_quantity AS BIGINT) END AS votes,
  CAST(l_shipdate AS DATE) < DATE '1998-06-01' AS past
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
  JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

#: One row for each station and form, some counts unread and some flags set.
STATIONS = """
SELECT CAST(k AS STRING) AS station_code, k AS station_no, district, subdistrict, form_type,
  CASE WHEN k % 19 <> 0 THEN 2 * (g + b + n) + k % 7 END AS eligible_voters,
  CASE WHEN k % 17 <> 0 THEN g + b + n END AS voters_present, CASE WHEN k % 13 <> 0 THEN g + b + n END AS ballots_used,
  CASE WHEN k % 11 <> 0 THEN g END AS ballots_good, CASE WHEN k % 5 <> 0 THEN b END AS ballots_spoiled, n AS ballots_no_vote,
  CASE WHEN k % 3 = 0 THEN 'hdr_good:digit_missing;sum_used' WHEN k % 3 = 1 THEN 'old_flag|legacy' END AS validation_flags
FROM (SELECT CAST(l_suppkey AS BIGINT) AS k, r_name AS district, n_name AS subdistrict, CASE WHEN l_linestatus = 'O' THEN '5_18' ELSE '5_18_party' END AS form_type,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS g,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS b,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS n
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  GROUP BY l_suppkey, r_name, n_name, CASE WHEN l_linestatus = 'O' THEN '5_18' ELSE '5_18_party' END) t
"""

NAMES = ("lineitem", "part", "supplier", "nation", "region")


class Tables:
    """The views of one data folder: votes and stations, whole, by form, and by election."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.sf_dir = sf_dir
        tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES}
        self.votes: DataFrame = spark.sql(VOTES, **tables)
        self.stations: DataFrame = spark.sql(STATIONS, **{n: tables[n] for n in NAMES if n != "part"})
        self.candidate, self.party = (self.votes.where(f"form_type = '{f}'") for f in ("5_18", "5_18_party"))
        self.cstations, self.pstations = (self.stations.where(f"form_type = '{f}'") for f in ("5_18", "5_18_party"))
        self.past_candidate, self.past_party = self.candidate.where("past"), self.party.where("past")
        self.now_candidate, self.now_party = self.candidate.where("NOT past"), self.party.where("NOT past")


def oracle(body: str) -> str:
    """A query over v, s (all), vc, vp (candidate and party votes), sc, sp (stations of either form)."""
    names = {n: n for n in NAMES}
    head = f"WITH v AS ({VOTES.format(**names)}), s AS ({STATIONS.format(**names)}), vc AS (SELECT * FROM v WHERE form_type = '5_18'), vp AS (SELECT * FROM v WHERE form_type = '5_18_party'), sc AS (SELECT * FROM s WHERE form_type = '5_18'), sp AS (SELECT * FROM s WHERE form_type = '5_18_party')"
    return f"{head}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"
