"""Views over the provided tables that have the shapes the operators work on.

The SQL is common to Spark and DuckDB.  ``view`` gives a view as a DataFrame over the Parquet files of
a folder; ``with_views`` prepends the same definitions to a DuckDB query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages")

VIEWS: dict[str, str] = {
    "events_dim": """SELECT * FROM (VALUES
 ('E1','endogenous',DATE '1995-10-01',DATE '1996-07-01',DATE '1996-08-12',DATE '1996-09-30',DATE '1997-06-30'),
 ('E2','external',  DATE '1997-01-01',DATE '1997-10-01',DATE '1997-10-27',DATE '1997-12-31',DATE '1998-06-30'),
 ('E3','endogenous',DATE '1998-01-01',DATE '1998-09-01',DATE '1998-09-23',DATE '1998-10-31',DATE '1999-06-30'),
 ('E4','external',  DATE '1999-06-01',DATE '2000-03-01',DATE '2000-04-14',DATE '2000-05-31',DATE '2001-03-31')
) AS t(event_key,origin,pre_start,acute_start,acute_peak,acute_end,post_end)""",
    "weekly_panel": """SELECT c_mktsegment AS series_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS date,
 SUM(CASE WHEN o_orderstatus='P' THEN o_totalprice END)/1e6 AS lending,
 SUM(CASE WHEN o_orderstatus='F' THEN o_totalprice END)/1e6 AS reserve,
 SUM(CASE WHEN o_orderstatus='O' THEN o_totalprice END)/1e6 AS deposits
FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2""",
    "daily_rate": """SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, rate FROM orders JOIN (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS mth, ROUND(100*AVG(l_discount),1) AS rate FROM lineitem GROUP BY 1) m
 ON CAST(date_trunc('month', o_orderdate) AS DATE)=mth""",
    "ledger": """SELECT CAST(l_shipdate AS DATE) AS date, s_name AS counterparty, r_name AS category, 100*l_discount AS rate,
 l_extendedprice AS value_brought, CASE WHEN l_returnflag='R' THEN l_extendedprice ELSE 0e0 END AS value_rejected,
 l_extendedprice*(1-l_discount) AS total_amount
FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "quotes": """SELECT l_partkey AS security_id, p_name AS name, p_type AS sector, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
 l_extendedprice/l_quantity AS price FROM lineitem JOIN part ON l_partkey=p_partkey""",
    "articles": """SELECT doc_id, DATE '1996-01-01' + CAST(doc_id % 730 AS INT) AS date, source AS title, lang AS location,
 CAST(floor(n_chars/6) AS INT) AS word_count, 0.5e0 + CAST(doc_id % 50 AS DOUBLE)/100e0 AS ocr_quality_mean, text FROM documents""",
    "annual_panel": """SELECT r_name AS country, CAST(year(o_orderdate) AS INT) AS year, SUM(o_totalprice) AS gdp, AVG(o_totalprice) AS stir
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1,2""",
    "membership": """SELECT DISTINCT s_name AS institution, CAST(100*year(l_shipdate)+month(l_shipdate) AS INT) AS period FROM lineitem JOIN supplier ON l_suppkey=s_suppkey""",
    "raw_names": """SELECT p_partkey AS name_id, CASE p_partkey % 4 WHEN 0 THEN concat(p_name,' ',p_brand) WHEN 1 THEN concat(upper(p_name),' ',p_brand,' & Co')
 WHEN 2 THEN concat('Messrs. ',p_name,' ',p_brand) ELSE concat(p_name,' ',p_brand,' Limited') END AS name_raw, concat(p_name,' ',p_brand) AS truth FROM part""",
    "observed": """SELECT CAST(o_orderdate AS DATE) AS date, SUM(o_totalprice) AS anchor_value, SUM(o_totalprice)*(1e0 + CASE WHEN day(o_orderdate)%7=0 THEN 0.03e0 WHEN day(o_orderdate)%11=0 THEN 0.08e0 ELSE 0.001e0 END) AS model_value
FROM orders GROUP BY CAST(o_orderdate AS DATE), day(o_orderdate)""",
}

_TABLE = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_TABLE.sub(lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", VIEWS[name]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """DuckDB SQL with the definitions of the views that it names."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        recursive = body.upper().startswith("WITH RECURSIVE ")
        return f"WITH {'RECURSIVE ' if recursive else ''}{heads + ', ' if heads else ''}{body[15 if recursive else 5:]}"
    return f"WITH {heads} {body}" if heads else body
