"""Named queries over a table folder and their DuckDB statements."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Building blocks of the statements. Short names: ch channel, mat material,
# cat category, yw week label, q quantity, pos week position.
CTES = {
    "obs_fine": """
        SELECT n.n_name AS ch, p.p_type || ',' || p.p_brand AS mat,
               CASE l.l_returnflag WHEN 'N' THEN 'Sell-in' WHEN 'A' THEN 'Cust. Sales'
                    ELSE 'Channel Inv.' END AS cat,
               CAST(isoyear(l.l_shipdate) * 100 + weekofyear(l.l_shipdate) AS INTEGER) AS yw,
               l.l_quantity AS q, l.l_linenumber AS line
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN part p ON l.l_partkey = p.p_partkey""",
    "obs_coarse": """
        SELECT c.c_mktsegment AS ch, p.p_brand AS mat,
               CASE l.l_returnflag WHEN 'N' THEN 'Sell-in' WHEN 'A' THEN 'Cust. Sales'
                    ELSE 'Channel Inv.' END AS cat,
               CAST(isoyear(l.l_shipdate) * 100 + weekofyear(l.l_shipdate) AS INTEGER) AS yw,
               l.l_quantity AS q, l.l_linenumber AS line
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN part p ON l.l_partkey = p.p_partkey""",
    "long_customer": """
        SELECT c.c_name AS ch, p.p_brand AS mat,
               CASE l.l_returnflag WHEN 'N' THEN 'Sell-in' WHEN 'A' THEN 'Cust. Sales'
                    ELSE 'Channel Inv.' END AS cat,
               CAST(isoyear(l.l_shipdate) * 100 + weekofyear(l.l_shipdate) AS INTEGER) AS yw,
               sum(l.l_quantity) AS q
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN part p ON l.l_partkey = p.p_partkey GROUP BY ALL""",
    "signed_fine": "SELECT ch, mat, cat, yw, CASE WHEN line = 7 THEN -q ELSE q END AS q FROM obs_fine",
    "long_fine": "SELECT ch, mat, cat, yw, sum(q) AS q FROM obs_fine GROUP BY ALL",
    "long_coarse": "SELECT ch, mat, cat, yw, sum(q) AS q FROM obs_coarse GROUP BY ALL",
    "weeks": """
        SELECT CAST(i AS INTEGER) AS pos, d, CAST(isoyear(d) * 100 + weekofyear(d) AS INTEGER) AS yw
        FROM (SELECT i, DATE '1995-01-02' + CAST(i * 7 AS INTEGER) AS d FROM range(365) t(i))""",
    "dense_fine": """
        SELECT k.ch, k.mat, k.cat, w.pos, w.yw, coalesce(l.q, 0.0) AS q
        FROM (SELECT DISTINCT ch, mat, cat FROM long_fine) k CROSS JOIN weeks w
        LEFT JOIN long_fine l ON l.ch = k.ch AND l.mat = k.mat AND l.cat = k.cat AND l.yw = w.yw""",
    "dense_coarse": """
        SELECT k.ch, k.mat, k.cat, w.pos, w.yw, coalesce(l.q, 0.0) AS q
        FROM (SELECT DISTINCT ch, mat, cat FROM long_coarse) k CROSS JOIN weeks w
        LEFT JOIN long_coarse l ON l.ch = k.ch AND l.mat = k.mat AND l.cat = k.cat AND l.yw = w.yw""",
    "si_fine": "SELECT ch, mat, pos, yw, q FROM dense_fine WHERE cat = 'Sell-in'",
    "si_coarse": "SELECT ch, mat, pos, yw, q FROM dense_coarse WHERE cat = 'Sell-in'",
    "folds": """
        SELECT * FROM (VALUES (1, 199952, 200001, 200013), (2, 200013, 200014, 200026),
          (3, 200026, 200027, 200039), (4, 200039, 200040, 200052), (5, 200052, 200101, 200113))
          t(fold, train_end, val_start, val_end)""",
}
KEY3 = 'ch AS "Channel", mat AS "Material Description", cat AS "Category"'
KEY2 = 'ch AS "Channel", mat AS "Material Description"'


def define(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    """Prefix a statement with the building blocks it names, inner ones first."""
    done: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in CTES:
            if name != own and name not in done and re.search(rf"\b{name}\b", text):
                visit(CTES[name], name)
                done.append(name)

    visit(sql)
    if not done:
        return sql
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTES[n]})" for n in done) + " " + sql


def query(name: str, sql: str | None = None):
    """Register a query function, with its statement where SQL can express it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    from stockweave.plans import (  # noqa: F401
        business_queries, dashboard_queries, evaluation_queries, feature_queries, model_queries,
        planning_queries, quality_queries, source_queries,
    )
