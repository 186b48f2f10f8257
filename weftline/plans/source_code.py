"""Queries of source texts (F9, X1, X6, X7, X16, G9, G11): small programs spelled from `part`, in four languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.operators.rules import packs
from weftline.plans.registry import Registry
from weftline.sources.tables import table
from weftline.staging import dealt

registry = Registry()
add = registry.add

#: (pack, extension, text) by p_partkey % 4; {k} is the key and {s} the size of the part.
PROGRAMS = (
    ("python", "py", "import m{s}  # import none{s}\nx = '#'\ndef f{k}():\n    pass"),
    ("vb6", "frm", "Sub S{k}()\nCall S{s} ' Call None\nx = \"'\" ' rest\nEnd Sub"),
    ("plsql", "pls", "PROCEDURE p{k} IS BEGIN\nSELECT a FROM t{s}; -- FROM none\n/* FROM\nnone */ UPDATE w{s} SET a = 1;"),
    ("cl", "clp", "P{k}: PGM\n/* CALL PGM(NO)\n*/ CALL PGM(P{s})"),
)
#: The same without comments: blanks for blocks, nothing for line comments.
BARE = (
    "import m{s}  \nx = '#'\ndef f{k}():\n    pass",
    "Sub S{k}()\nCall S{s} \nx = \"'\" \nEnd Sub",
    "PROCEDURE p{k} IS BEGIN\nSELECT a FROM t{s}; \n       \n        UPDATE w{s} SET a = 1;",
    "P{k}: PGM\n               \n   CALL PGM(P{s})",
)


def _sql(text: str) -> str:
    quoted = "'" + text.replace("'", "''").replace("\n", "{n}") + "'"
    return f"replace(replace(replace({quoted}, '{{k}}', p_partkey::VARCHAR), '{{s}}', p_size::VARCHAR), '{{n}}', chr(10))"


def _texts(texts: tuple[str, ...]) -> str:
    return "CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN {_sql(t)}" for i, t in enumerate(texts)) + " END"


def sources(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, name, language, text of one program a part; every third name tells no language, and of these every second has a stated one."""
    k = F.col("p_partkey") % 4
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    text = F.replace(F.replace(pick([p[2] for p in PROGRAMS]), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))
    named = F.concat(F.lit("lib/src"), F.col("p_partkey").cast("string"), F.lit("."), F.when(F.col("p_partkey") % 3 == 0, "txt").otherwise(pick([p[1] for p in PROGRAMS])))
    language = F.when(F.col("p_partkey") % 6 == 0, pick(["Python", "Visual Basic 6", "PL/SQL", "CLLE"]))
    return table(spark, root, "part").select(F.col("p_partkey").alias("doc_id"), named.alias("name"), language.alias("language"), text.alias("text"))


def with_packs(spark: SparkSession, root: str) -> DataFrame:
    return packs.packed(dealt(sources(spark, root), "doc_id"))


@add("f9_without_comments", f"SELECT p_partkey AS doc_id, sha256({_texts(BARE)}) AS h FROM part")
def f9(spark: SparkSession, root: str) -> DataFrame:
    pack = F.element_at(F.array(*[F.lit(p[0]) for p in PROGRAMS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return packs.stripped_documents(sources(spark, root).withColumn("pack", pack)).select("doc_id", F.sha2("text", 256).alias("h"))


@add(
    "x7_chosen_packs",
    """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 <> 0 OR p_partkey % 6 = 0 THEN ['python', 'vb6', 'plsql', 'cl'][p_partkey % 4 + 1] END AS pack,
    CASE WHEN p_partkey % 3 <> 0 THEN 'extension' WHEN p_partkey % 6 = 0 THEN 'language' END AS "by" FROM part""",
)
def x7(spark: SparkSession, root: str) -> DataFrame:
    """Where neither extension nor language tells, these short programs show fewer than three signs and stay without a pack."""
    return packs.chosen(sources(spark, root))


@add("x1_dispatch", """SELECT CASE WHEN p_partkey % 3 <> 0 THEN 'extension' WHEN p_partkey % 6 = 0 THEN 'language' ELSE 'none' END AS "by", count(*) AS n FROM part GROUP BY 1""")
def x1(spark: SparkSession, root: str) -> DataFrame:
    """How many documents each step of the parser chain takes."""
    return packs.chosen(sources(spark, root)).groupBy(F.coalesce("by", F.lit("none")).alias("by")).agg(F.count("*").alias("n"))


RELATIONS = """r AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 4 AS l FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 6 = 0),
    u AS (SELECT k, s, 'includes' AS kind, 'program:SRC' || k AS a, 'module:M' || s AS b FROM r WHERE l = 0
    UNION ALL SELECT k, s, 'calls', 'function:SRC' || k || '.S' || k, CASE WHEN EXISTS (SELECT 1 FROM r o WHERE o.k = r.s AND o.l = 1) THEN 'function:SRC' || s || '.S' || s ELSE 'function:S' || s END FROM r WHERE l = 1 AND k <> s
    UNION ALL SELECT k, s, 'reads', 'function:SRC' || k || '.P' || k, 'table:T' || s FROM r WHERE l = 2
    UNION ALL SELECT k, s, 'writes', 'function:SRC' || k || '.P' || k, 'table:W' || s FROM r WHERE l = 2
    UNION ALL SELECT k, s, 'calls', 'paragraph:SRC' || k || '.P' || k, 'program:P' || s FROM r WHERE l = 3 AND k <> s)"""


@add("x6_units_and_calls", f"WITH {RELATIONS} SELECT k AS doc_id, kind, count(*) AS n FROM u GROUP BY ALL")
def x6(spark: SparkSession, root: str) -> DataFrame:
    return packs.extracted(with_packs(spark, root))[1].groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@add(
    "x16_structure",
    """WITH r AS (SELECT p_partkey AS k, p_partkey % 4 AS l FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 6 = 0) SELECT 'program:SRC' || k AS entity_key, 'program' AS kind, NULL AS parent_key, k AS doc FROM r
    UNION ALL SELECT ['function', 'function', 'function', 'paragraph'][l + 1] || ':SRC' || k || ['.F', '.S', '.P', '.P'][l + 1] || k, ['function', 'function', 'function', 'paragraph'][l + 1], 'program:SRC' || k, k FROM r""",
)
def x16(spark: SparkSession, root: str) -> DataFrame:
    return packs.structured(packs.extracted(with_packs(spark, root))[0]).select("entity_key", "kind", "parent_key", "doc")


def linked(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    entities, relations = packs.extracted(with_packs(spark, root))
    return packs.linked(packs.structured(entities), relations, entities)


@add("g11_linked_edges", f"WITH {RELATIONS} SELECT DISTINCT a AS from_node, b AS to_node, kind FROM u")
def g11(spark: SparkSession, root: str) -> DataFrame:
    return linked(spark, root)[1]


@add("g9_lineage_of_sources", f"WITH {RELATIONS} SELECT b AS store, count(DISTINCT a) FILTER (kind = 'writes') AS n_in, count(DISTINCT a) FILTER (kind = 'reads') AS n_out FROM u WHERE kind IN ('reads', 'writes') GROUP BY 1")
def g9(spark: SparkSession, root: str) -> DataFrame:
    """From texts to the lineage of their tables."""
    edges = linked(spark, root)[1].select(F.col("from_node").alias("from_id"), F.col("to_node").alias("to_id"), "kind")
    return graph.store_lineage(edges)
