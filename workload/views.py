"""Dirtied views over the given tables, in SQL both engines read the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIRTY_ORDERS = """
SELECT o_orderkey AS order_id,
       o_custkey + CASE WHEN o_orderkey % 50 = 7 THEN 1000000 ELSE 0 END AS customer_id,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 97 = 1 THEN -o_totalprice
            WHEN o_orderkey % 211 = 2 THEN o_totalprice * 100 ELSE o_totalprice END AS total_price,
       CASE o_orderkey % 40 WHEN 0 THEN 'n/a' WHEN 1 THEN ' ' || o_orderpriority || ' '
            WHEN 2 THEN lower(o_orderpriority) WHEN 3 THEN 'test'
            WHEN 4 THEN replace(o_orderpriority, '-', '_') ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey = 5 THEN 'odd' ELSE o_orderstatus END AS status,
       o_orderdate AS ordered_at,
       CASE o_orderkey % 25 WHEN 0 THEN '2024-02-30' WHEN 1 THEN 'not-a-date'
            WHEN 2 THEN '31/12/1997' WHEN 3 THEN NULL
            ELSE substring(CAST(o_orderdate AS STRING), 1, 10) END AS order_date,
       CAST(o_orderkey % 30 AS INT) AS min_qty,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 37 AS INT) END AS max_qty
FROM {orders}
"""

# The same columns without the dirt: the earlier version of the dataset in comparisons.
CLEAN_ORDERS = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total_price,
       o_orderpriority AS priority, o_orderstatus AS status, o_orderdate AS ordered_at,
       substring(CAST(o_orderdate AS STRING), 1, 10) AS order_date,
       CAST(0 AS INT) AS min_qty, CAST(o_orderkey % 37 AS INT) AS max_qty
FROM {orders}
"""

DIRTY_CUSTOMER = """
SELECT c_custkey AS customer_id,
       CASE WHEN c_custkey % 20 = 0 THEN upper(c_name) WHEN c_custkey % 20 = 1 THEN c_name || '  x'
            ELSE c_name END AS name,
       CASE WHEN c_custkey % 12 = 0 THEN 'not-an-email' WHEN c_custkey % 12 = 1 THEN NULL
            ELSE 'user' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
       CASE WHEN c_custkey % 15 = 0 THEN '12345'
            ELSE '+86 138-' || CAST(10000000 + c_custkey AS STRING) END AS phone,
       CASE WHEN c_custkey % 18 = 0 THEN 'example'
            ELSE 'https://example.org/' || CAST(c_custkey AS STRING) END AS website,
       CASE WHEN c_custkey % 21 = 0 THEN '999.1.1.1'
            ELSE '10.0.' || CAST(c_custkey % 256 AS STRING) || '.7' END AS ip_address,
       CASE WHEN c_custkey % 16 = 0 THEN 'abc years'
            ELSE CAST(18 + c_custkey % 60 AS STRING) END AS age_text,
       CASE c_custkey % 30 WHEN 0 THEN 'bad' || chr(1) || 'char' WHEN 1 THEN 'full１'
            WHEN 2 THEN 'lost�' WHEN 3 THEN '=SUM(A1)' WHEN 4 THEN repeat('x', 1100)
            ELSE 'ok' END AS note,
       c_mktsegment AS segment,
       CASE WHEN c_mktsegment = 'FURNITURE' AND c_custkey % 3 > 0 THEN NULL ELSE c_acctbal END AS balance
FROM {customer}
"""

DIRTY_EVENTS = """
SELECT event_id, ts AS event_time, user_id, event_type,
       CASE WHEN substring(CAST(ts AS STRING), 1, 10) = '2024-01-05' AND event_id % 2 = 0 THEN NULL
            ELSE value END AS value
FROM {events}
"""

# A log of scan runs: one dataset per order priority, one run per order month, scored by
# the share of orders that are not pending.
RUN_LOG = """
SELECT o_orderpriority AS dataset_id,
       o_orderpriority || '/' || substring(CAST(o_orderdate AS STRING), 1, 7) AS scan_run_id,
       CASE WHEN count(*) % 11 = 0 THEN 'failed' ELSE 'completed' END AS status,
       max(o_orderdate) AS finished_at, min(o_orderdate) AS started_at, count(*) AS row_count,
       round(100 * sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END) / CAST(count(*) AS DOUBLE), 1)
           AS overall,
       sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS high,
       sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS low
FROM {orders}
GROUP BY o_orderpriority, substring(CAST(o_orderdate AS STRING), 1, 7)
"""

VIEWS = {
    "dirty_orders": DIRTY_ORDERS,
    "clean_orders": CLEAN_ORDERS,
    "dirty_customer": DIRTY_CUSTOMER,
    "dirty_events": DIRTY_EVENTS,
    "run_log": RUN_LOG,
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Column families of the tables examined, for the oracle statements.
COLUMNS = {
    "dirty_orders": {
        "order_id": "num",
        "customer_id": "num",
        "total_price": "num",
        "priority": "str",
        "status": "str",
        "ordered_at": "time",
        "order_date": "str",
        "min_qty": "num",
        "max_qty": "num",
    },
    "dirty_customer": {
        "customer_id": "num",
        "name": "str",
        "email": "str",
        "phone": "str",
        "website": "str",
        "ip_address": "str",
        "age_text": "str",
        "note": "str",
        "segment": "str",
        "balance": "num",
    },
    "dirty_events": {
        "event_id": "num",
        "event_time": "time",
        "user_id": "num",
        "event_type": "str",
        "value": "num",
    },
    "lineitem": {
        "l_orderkey": "num",
        "l_partkey": "num",
        "l_suppkey": "num",
        "l_linenumber": "num",
        "l_quantity": "num",
        "l_extendedprice": "num",
        "l_discount": "num",
        "l_tax": "num",
        "l_returnflag": "str",
        "l_linestatus": "str",
        "l_shipdate": "time",
    },
    "documents": {"doc_id": "num", "text": "str", "lang": "str", "source": "str", "n_chars": "num"},
    "pages": {"page_id": "num", "url": "str", "html": "str"},
    "customer": {
        "c_custkey": "num",
        "c_name": "str",
        "c_nationkey": "num",
        "c_acctbal": "num",
        "c_mktsegment": "str",
    },
    "orders": {
        "o_orderkey": "num",
        "o_custkey": "num",
        "o_orderstatus": "str",
        "o_totalprice": "num",
        "o_orderdate": "time",
        "o_orderpriority": "str",
    },
}
COLUMNS["clean_orders"] = COLUMNS["dirty_orders"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over one."""
    if name in VIEWS:
        text = VIEWS[name]
        base = text[text.index("{") + 1 : text.index("}")]
        return spark.sql(text, **{base: table(spark, sf_dir, base)})
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_views(sql: str) -> str:
    """An oracle statement with the views it names as common table expressions."""
    used = [v for v in VIEWS if v in sql]
    if not used:
        return sql
    ctes = ", ".join(
        f"{v} AS ({VIEWS[v].strip().replace('{', '').replace('}', '')})" for v in used
    )
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
