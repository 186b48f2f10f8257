"""Queries of taint tracing (R5), over programs that are spelled from the tables: suppliers are functions that call one another, customers are pages that call them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.rules import taint
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
add = registry.add

#: The programs' own rule, as tables: a supplier's function hands its parameter to that of a third of its key, unless made safe; some run a statement with it.
CALLS = """
    RECURSIVE f AS (SELECT s_suppkey AS k, s_suppkey // 3 AS next, s_suppkey % 5 = 0 AS safe, s_suppkey % 4 = 1 AS runs FROM supplier),
    r AS (SELECT k FROM f WHERE runs AND NOT safe UNION SELECT f.k FROM f JOIN r ON f.next = r.k WHERE NOT f.safe)
"""


def _programs(spark: SparkSession, root: str) -> DataFrame:
    """(name, family, text): one file a supplier with its function, one a customer with a page."""
    key, text = F.col("s_suppkey"), F.lit("\n")
    body = F.concat(
        F.format_string("def step_%d(kind, term):\n    # SELECT term\n    t = term.strip()\n", key),
        F.when(key % 5 == 0, "    t = int(t)\n").otherwise(""),
        F.when(key % 4 == 1, "    conn.execute('SELECT * FROM t WHERE d = ' +\n        t)\n").otherwise(""),
        F.when(key % 2 == 0, "    kind = 'x'\n").otherwise(""),
        F.format_string("    return step_%d('a', t)", F.floor(key / 3)),
        text,
    )
    functions = table(spark, root, "supplier").select(F.format_string("step_%d.py", key).alias("name"), F.lit("python").alias("family"), body.alias("text"))
    c = F.col("c_custkey")
    page = F.concat(
        F.format_string("def page_%d():\n    q = request.args.get('q')\n", c),
        F.when(c % 3 == 0, "    q = 'fixed'\n").otherwise(""),
        F.when(c % 7 == 0, "    os.system('ls ' + q)\n").otherwise(""),
        F.format_string("    return step_%d('b', q)\n", F.pmod(c, F.lit(40))),
    )
    pages = table(spark, root, "customer").select(F.format_string("page_%d.py", c).alias("name"), F.lit("python").alias("family"), page.alias("text"))
    return functions.unionByName(pages)


def _facts(spark: SparkSession, root: str) -> DataFrame:
    return taint.fixpoint(taint.reached(_programs(spark, root), "name"))[0]


@add("r5_taint_flows", "SELECT 'page_' || c_custkey || '.py' AS doc, 'SEC-CMD' AS rule, 'high' AS severity, 3::INTEGER AS n FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 3 <> 0")
def r5_flows(spark: SparkSession, root: str) -> DataFrame:
    return taint.flows(_facts(spark, root))


@add(
    "r5_taint_calls",
    f"WITH {CALLS} SELECT 'page_' || c_custkey || '.py' AS doc, (3 + (c_custkey % 7 = 0)::INTEGER)::INTEGER AS n, 'step_' || k AS callee, 1::INTEGER AS idx, 'SEC-SQLI' AS rule, 'step_' || k || '.py' AS def_doc FROM customer JOIN r ON k = c_custkey % 40 WHERE c_custkey % 3 <> 0",
)
def r5_calls(spark: SparkSession, root: str) -> DataFrame:
    return taint.unsafe_calls(_facts(spark, root))
