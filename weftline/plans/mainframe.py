"""Queries of mainframe sources (X3 to X5): programs, maps and jobs whose parts are the rows of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.rules import mainframe
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
add = registry.add


def _lines(of_row: Column, order: list[str]) -> Column:
    """The texts of a group's rows, in order, one after another."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, of_row.alias("said")))), lambda x: x["said"]), "\n")


def programs(spark: SparkSession, root: str) -> DataFrame:
    """One program a customer that has orders: a record, and for each order a paragraph that performs the first one, reads a table and calls a program."""
    orders, customer = table(spark, root, "orders"), table(spark, root, "customer")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    said = F.concat(F.format_string("       P-%d.\n           PERFORM P-%d\n           EXEC SQL SELECT A\n             FROM T", "o_orderkey", "first"), "o_orderstatus", F.lit(" END-EXEC\n           CALL 'PGM"), F.substring("o_orderpriority", 1, 1), F.lit("'."))
    body = orders.join(first, "o_custkey").groupBy("o_custkey").agg(_lines(said, ["o_orderkey"]).alias("body"))
    head = F.format_string(
        "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. C%d.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n           COPY B%d.\n       01  REC-%d.\n           05  FLD-%d PIC X(%d).\n      * CALL 'NONE'\n       PROCEDURE DIVISION.\n",
        "c_custkey", F.col("c_nationkey") % 5, "c_custkey", "c_nationkey", F.col("c_nationkey") + 1,
    )
    return customer.join(body, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("doc_id"), F.format_string("src/X%d.cbl", "c_custkey").alias("name"), F.concat(head, "body").alias("text"))


ORDERED = "o AS (SELECT *, 9 + 5 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS p0, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first, count(*) OVER (PARTITION BY o_custkey) AS k FROM orders JOIN customer ON c_custkey = o_custkey)"


@add(
    "x3_cobol_relations",
    f"""WITH {ORDERED} SELECT o_custkey::VARCHAR AS doc, 'calls' AS kind, 'P-' || o_orderkey AS source, 'P-' || first AS target, (p0 + 2)::INTEGER AS n, 'PERFORM' AS verb FROM o
    UNION ALL SELECT o_custkey::VARCHAR, 'reads', 'P-' || o_orderkey, 'table:T' || o_orderstatus, (p0 + 3)::INTEGER, 'SQL SELECT' FROM o
    UNION ALL SELECT o_custkey::VARCHAR, 'calls', 'P-' || o_orderkey, 'program:PGM' || o_orderpriority[1], (p0 + 5)::INTEGER, 'CALL' FROM o
    UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 'includes', 'C' || o_custkey, 'copybook:B' || (c_nationkey % 5), 5, NULL FROM o""",
)
def x3_relations(spark: SparkSession, root: str) -> DataFrame:
    _, relations = mainframe.cobol(programs(spark, root))
    return relations.select("doc", "kind", "source", "target", "n", F.col("attrs")["verb"].alias("verb"))


@add(
    "x3_cobol_entities",
    f"""WITH {ORDERED} SELECT DISTINCT o_custkey::VARCHAR AS doc, 'program' AS kind, 'C' || o_custkey AS name, NULL AS parent, 1 AS n, (9 + 5 * k)::INTEGER AS last_n FROM o
    UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 'field', 'REC-' || o_custkey, 'C' || o_custkey, 6, 6 FROM o
    UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 'field', 'FLD-' || c_nationkey, 'REC-' || o_custkey, 7, 7 FROM o
    UNION ALL SELECT o_custkey::VARCHAR, 'paragraph', 'P-' || o_orderkey, 'C' || o_custkey, (p0 + 1)::INTEGER, (p0 + 5)::INTEGER FROM o""",
)
def x3_entities(spark: SparkSession, root: str) -> DataFrame:
    entities, _ = mainframe.cobol(programs(spark, root))
    return entities.select("doc", "kind", "name", "parent", "n", "last_n")


@add("x3_included_fields", "SELECT DISTINCT c_custkey::VARCHAR AS doc, 'C' || c_custkey AS program, 'B' || b AS copybook, 'ITEM-' || b AS field FROM customer JOIN orders ON c_custkey = o_custkey, range(0, 5) t(b) WHERE b <= c_nationkey % 5")
def x3_included(spark: SparkSession, root: str) -> DataFrame:
    """Copybook B4 copies B3, that one B2, and so on: what comes into each program."""
    key = F.col("n_nationkey")
    text = F.concat(F.format_string("       01  ITEM-%d PIC X.\n", key), F.when(key > 0, F.format_string("           COPY B%d.\n", key - 1)).otherwise(""))
    books = table(spark, root, "nation").where("n_nationkey < 5").select(key.alias("doc_id"), F.format_string("B%d.cpy", key).alias("name"), text.alias("text"))
    _, relations = mainframe.cobol(programs(spark, root))
    return mainframe.included_fields(relations, *mainframe.copybooks(books))


@add(
    "x5_job_relations",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS i FROM lineitem)
    SELECT l_orderkey::VARCHAR AS doc, 'calls' AS kind, 'J' || l_orderkey AS source, 'program:P' || l_partkey AS target, (3 * i - 1)::INTEGER AS n, 'S' || l_linenumber AS step, NULL AS program FROM l
    UNION ALL SELECT l_orderkey::VARCHAR, CASE l_returnflag WHEN 'N' THEN 'writes' ELSE 'reads' END, 'J' || l_orderkey, 'data_store:A.S' || l_suppkey, (3 * i)::INTEGER, 'S' || l_linenumber, 'P' || l_partkey FROM l""",
)
def x5_jobs(spark: SparkSession, root: str) -> DataFrame:
    """One job an order, one step a line item: the program is the part, the data set the supplier."""
    said = F.concat(F.format_string("//S%d EXEC PGM=P%d\n//D1 DD DSN=A.S%d,\n//   DISP=", "l_linenumber", "l_partkey", "l_suppkey"), F.when(F.col("l_returnflag") == "N", "(NEW,CATLG)").otherwise("SHR"))
    body = table(spark, root, "lineitem").groupBy("l_orderkey").agg(_lines(said, ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]).alias("body"))
    docs = body.select(F.col("l_orderkey").alias("doc_id"), F.format_string("J%d.jcl", "l_orderkey").alias("name"), F.concat(F.format_string("//J%d JOB (X)\n", "l_orderkey"), "body").alias("text"))
    _, relations = mainframe.jcl(docs)
    return relations.select("doc", "kind", "source", "target", "n", F.col("attrs")["step"].alias("step"), F.col("attrs")["program"].alias("program"))


@add(
    "x5_map_elements",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
    SELECT DISTINCT o_custkey::VARCHAR AS doc, 'screen' AS kind, 'M' || o_custkey AS name, NULL AS parent, NULL AS pos FROM o
    UNION ALL SELECT o_custkey::VARCHAR, 'ui_element', 'O' || o_orderkey, 'M' || o_custkey, i || ',' || length(o_orderpriority) FROM o""",
)
def x5_maps(spark: SparkSession, root: str) -> DataFrame:
    """One map a customer, one field an order."""
    orders = table(spark, root, "orders")
    numbered = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.length("o_orderpriority").alias("w")))).alias("o"))
    body = F.array_join(F.transform("o", lambda x, i: F.concat(F.lit("O"), x["o_orderkey"].cast("string"), F.lit("  DFHMDF POS=("), (i + 1).cast("string"), F.lit(","), x["w"].cast("string"), F.lit(")"))), "\n")
    text = F.concat(F.format_string("S%d  DFHMSD TYPE=MAP\nM%d  DFHMDI SIZE=(24,80)\n", "o_custkey", "o_custkey"), body)
    docs = numbered.select(F.col("o_custkey").alias("doc_id"), F.format_string("S%d.bms", "o_custkey").alias("name"), text.alias("text"))
    return mainframe.bms(docs).select("doc", "kind", "name", "parent", F.col("attrs")["pos"].alias("pos"))
