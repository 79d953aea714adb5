"""Layout and annotation tables derived from the TPC-H style parquet files.

One SQL text per table, in the dialect Spark and DuckDB share, so every query and its
check start from the same rows. Page canvas: 512 x 800 pixels.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "boxes": """
SELECT l_partkey AS page_id,
 l_orderkey*100 + row_number() OVER (PARTITION BY l_partkey,l_orderkey ORDER BY l_linenumber,l_suppkey,l_extendedprice,l_quantity,l_shipdate,l_returnflag,l_linestatus,l_discount,l_tax) AS box_id,
 CAST(((l_orderkey*7+l_suppkey)%12)*40+(l_orderkey%9) AS INT) AS l,
 CAST(((l_orderkey*13+l_linenumber*5)%32)*24+(l_suppkey%7) AS INT) AS t,
 CAST(((l_orderkey*7+l_suppkey)%12)*40+(l_orderkey%9)+14+CAST(l_quantity AS INT)%22 AS INT) AS r,
 CAST(((l_orderkey*13+l_linenumber*5)%32)*24+(l_suppkey%7)+16+(CAST(l_quantity AS INT)*3)%20 AS INT) AS b,
 CAST((l_orderkey*31+l_suppkey*17+l_linenumber*7)%1000 AS INT) AS conf_m,
 CASE l_returnflag WHEN 'A' THEN 'BUBBLED' WHEN 'N' THEN 'ORPHAN' ELSE 'SFX' END AS category
FROM lineitem""",
    "lines": """
SELECT l_partkey AS page_id,
 l_orderkey*100 + row_number() OVER (PARTITION BY l_partkey,l_orderkey ORDER BY l_linenumber,l_suppkey,l_extendedprice,l_quantity,l_shipdate,l_returnflag,l_linestatus,l_discount,l_tax) AS line_id,
 CAST((l_orderkey*11+l_suppkey*5)%470 AS INT) AS l,
 CAST((l_orderkey*19+l_linenumber*37)%640 AS INT) AS t,
 CAST((l_orderkey*11+l_suppkey*5)%470+6+CAST(l_quantity AS INT)%36 AS INT) AS r,
 CAST((l_orderkey*19+l_linenumber*37)%640+12+(l_suppkey*7+CAST(l_quantity AS INT))%150 AS INT) AS b,
 CASE l_returnflag WHEN 'A' THEN 'BUBBLED' WHEN 'N' THEN 'ORPHAN' ELSE 'SFX' END AS category
FROM lineitem""",
    "regions": """
SELECT CAST(o_orderkey % (SELECT count(*) FROM part) AS BIGINT) AS page_id, o_orderkey AS region_id,
 CAST((o_custkey*11)%360 AS INT) AS l, CAST((o_orderkey*17+o_custkey)%560 AS INT) AS t,
 CAST((o_custkey*11)%360+90+o_custkey%130 AS INT) AS r,
 CAST((o_orderkey*17+o_custkey)%560+110+o_orderkey%190 AS INT) AS b
FROM orders""",
    "zones": """
SELECT c_custkey AS zone_id, CAST(c_custkey % (SELECT count(*) FROM part) AS BIGINT) AS page_id,
 CAST((c_custkey*37)%440 AS INT) AS l, CAST((c_custkey*53)%700 AS INT) AS t,
 CAST((c_custkey*37)%440+40+c_nationkey AS INT) AS r, CAST((c_custkey*53)%700+60+c_nationkey AS INT) AS b
FROM customer""",
    "manifest": """
SELECT o_orderkey AS crop_key, 'b' || lpad(CAST(o_orderkey AS STRING),7,'0') AS bubble_id,
 'batch_' || substr(o_orderpriority,1,1) AS batch,
 'c' || lpad(CAST(o_custkey%14+1 AS STRING),2,'0') || '_p' || CAST(o_orderkey%300+1 AS STRING) || '.webp' AS page_name,
 CAST(90+o_custkey%410 AS INT) AS crop_w, CAST(80+o_orderkey%420 AS INT) AS crop_h,
 CAST((o_custkey*11)%360 AS INT) AS l, CAST((o_orderkey*17+o_custkey)%560 AS INT) AS t,
 (o_orderkey%11 = 0) AS is_discarded,
 CASE WHEN o_orderstatus='F' THEN (o_orderkey%6 = 0) WHEN o_orderstatus='P' THEN (o_orderkey%2 = 0) END AS is_conjoined,
 CASE WHEN o_orderkey%11=0 THEN 'discarded' WHEN o_orderstatus='F' THEN 'verified' WHEN o_orderstatus='O' THEN 'unlabeled'
      WHEN o_orderkey%4=0 THEN 'conjoined' WHEN o_orderkey%4=1 THEN 'unverified' WHEN o_orderkey%4=2 THEN 'recheck' ELSE 'annotated' END AS status
FROM orders""",
    "points": """
SELECT o_orderkey AS crop_key,
 CAST((o_orderkey*7)%200 AS INT) AS x0, CAST((o_orderkey*13)%200 AS INT) AS y0,
 CAST((o_custkey*5)%200 AS INT) AS x1, CAST((o_custkey*19)%200 AS INT) AS y1,
 CAST((o_orderkey*7)%200+o_custkey%29 AS INT) AS px0, CAST((o_orderkey*13)%200+o_orderkey%29 AS INT) AS py0,
 CAST((o_custkey*5)%200+o_orderkey%23 AS INT) AS px1, CAST((o_custkey*19)%200+o_custkey%23 AS INT) AS py1,
 CAST((o_orderkey*37+o_custkey)%1000 AS INT) AS conf_conj_m, CAST((o_orderkey*41+o_custkey*3)%1000 AS INT) AS conf_single_m
FROM orders""",
    "candidates": """
SELECT l_orderkey AS crop_key,
 l_orderkey*0 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate,l_returnflag,l_linestatus,l_discount,l_tax) AS point_id,
 CAST((l_partkey*7+l_suppkey*3)%230 AS INT) AS x, CAST((l_partkey*3+l_suppkey*11)%230 AS INT) AS y,
 CAST(5+(l_partkey*13+l_linenumber)%40 AS INT) AS depth
FROM lineitem""",
    "actions": """
SELECT event_id AS seq, ts, 'batch_' || CAST(user_id AS STRING) AS batch,
 'x' || CAST(user_id AS STRING) || '_' || CAST(CAST(floor(value*100) AS BIGINT)%8 AS STRING) AS bubble_id,
 CASE event_type WHEN 'signup' THEN 'flag_conjoined' WHEN 'click' THEN CASE CAST(floor(value*10) AS BIGINT)%4 WHEN 0 THEN 'verify' WHEN 1 THEN 'reject' ELSE 'annotate_single' END
  WHEN 'purchase' THEN 'annotate_conjoined' WHEN 'error' THEN 'discard' ELSE 'undo' END AS action
FROM events""",
    "stage_times": """
SELECT l_partkey AS page_id, 'batch_' || CAST(l_partkey%4+1 AS STRING) AS batch, l_orderkey AS run_id,
 l_orderkey*100 + row_number() OVER (PARTITION BY l_partkey,l_orderkey ORDER BY l_linenumber,l_suppkey,l_extendedprice,l_quantity,l_shipdate,l_returnflag,l_linestatus,l_discount,l_tax) AS seq,
 CAST((l_orderkey*3+l_suppkey)%900 AS INT) AS detect_ms, CAST(CASE WHEN l_orderkey%3=0 THEN 0 ELSE l_suppkey%70 END AS INT) AS group_ms,
 CAST((l_orderkey+l_suppkey*11)%50 AS INT) AS render_ms
FROM lineitem""",
    "logs": """
SELECT event_id, ts, user_id, value,
 CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'SUCCESS' WHEN 'click' THEN 'AI_STEP' ELSE 'INFO' END AS level
FROM events""",
    "files": """
SELECT page_id AS file_id, url AS path FROM pages""",
    "dialogue": """
SELECT conv_id AS page_id, turn AS line_no, role, text FROM conversations""",
}

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Attribute access to base and derived tables: ``Tables(spark, dir).boxes``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in SQL:
            used = [t for t in BASE if re.search(rf"FROM {t}\b", SQL[name])]
            text = SQL[name]
            for t in used:
                text = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", text)
            tables = {t: base(self._spark, self._dir, t) for t in used}
            page = re.search(r"PARTITION BY (l_partkey),l_orderkey", text)
            if page:  # rows of a page meet once: for their numbers and for what follows by page
                tables["lineitem"] = tables["lineitem"].repartition(page.group(1))
            return self._spark.sql(text, **tables)
        if name in BASE:
            return base(self._spark, self._dir, name)
        raise AttributeError(name)


def with_clause(*names: str) -> str:
    return ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
