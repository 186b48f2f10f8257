"""Queries of the scalar functions and decision tables (F*, V*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import decisions as dc
from weftline.functions import text as tx
from weftline.operators import joins, lines
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
add = registry.add


@add("f1_squeeze_outside_quotes")
def f1(spark: SparkSession, root: str) -> DataFrame:
    return lines.lines_of(table(spark, root, "documents")).select("doc_id", "n", tx.squeezed_outside_quotes("line").alias("norm"))


@add("f2_squeeze", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def f2(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.sha2(lines.squeezed(F.col("text")), 256).alias("h"))


@add("f3_short_name", "SELECT p_partkey, upper(regexp_extract(replace(p_name, ' ', '.') || ':' || p_brand, '[^.:]*$')) AS short FROM part")
def f3(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", tx.short_name(F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(":"), "p_brand")).alias("short"))


@add(
    "f4_concept_word",
    "WITH w AS (SELECT p_partkey, upper(coalesce(list_filter(regexp_split_to_array(p_name || '-' || p_size::VARCHAR, '[^A-Za-z0-9]+'), lambda p: p <> '' AND NOT regexp_full_match(p, '[0-9]+'))[-1], '')) AS w FROM part) SELECT p_partkey, CASE WHEN length(w) >= 4 AND w NOT IN ('RING') AND NOT regexp_full_match(w, '[A-Z][0-9]+') THEN w ELSE '' END AS word FROM w",
)
def f4(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", tx.concept_word(F.concat_ws("-", "p_name", F.col("p_size").cast("string")), ("RING",)).alias("word"))


@add("f5_personal_data_class")
def f5(spark: SparkSession, root: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("studentId", "WS-DOB-IN", "homeAddress", "order.email", "GRADE_LEVEL", "total", "ssn", "STU_NAME", "lastName", "IEP")])
    rows = table(spark, root, "customer").select("c_custkey", F.element_at(names, (F.col("c_custkey") % 10 + 1).cast("int")).alias("name"))
    return rows.withColumn("c", tx.personal_data_class(F.col("name"))).select("c_custkey", "name", "c.label", "c.severity")


@add("f6_masked_lines", r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:token|password|secret) = "[^"]{3,}"', 0)) AS hit FROM documents) SELECT doc_id, regexp_replace(hit, '"[^"]+"', '"****"') AS masked FROM l""")
def f6(spark: SparkSession, root: str) -> DataFrame:
    hits = table(spark, root, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('(?i)(?:token|password|secret) = "[^"]{3,}"'), F.lit(0))).alias("hit"))
    return hits.select("doc_id", tx.masked(F.col("hit")).alias("masked"))


@add("f7_redaction", r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '(?i)\bthe of\b', '[pair]', 'g'), '(?i)\bthe\b', '[the]', 'g')) AS n FROM documents")
def f7(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.length(tx.redacted(F.col("text"), {"the": "[the]", "the of": "[pair]"})).cast("long").alias("n"))


@add("f12_token_set", "SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) > 1)))::INTEGER AS n FROM documents")
def f12(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.size(joins.tokens(F.col("text"))).alias("n"))


@add("f13_head_tail_fit")
def f13(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", tx.fitted(F.col("text"), 600).alias("fitted"))


@add("f14_first_sentence")
def f14(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", tx.first_sentence(F.col("text"), 120).alias("short"))


@add("f15_slug_and_unique_name", "WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM s) SELECT p_partkey, CASE WHEN k = 1 THEN slug ELSE slug || ' (' || k || ')' END AS name FROM n")
def f15(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window as W

    named = table(spark, root, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"))
    k = F.row_number().over(W.partitionBy("slug").orderBy("p_partkey"))
    return named.withColumn("k", k).select("p_partkey", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).alias("name"))


@add("f16_number_words", "SELECT p_partkey, coalesce(CASE p_size WHEN 1 THEN 1 WHEN 7 THEN 7 END, try_cast(replace(format('{:,}', p_size * 1000), ',', '') AS INTEGER)) AS number FROM part")
def f16(spark: SparkSession, root: str) -> DataFrame:
    token = F.when(F.col("p_size") == 1, "One").when(F.col("p_size") == 7, "seven").otherwise(F.format_number(F.col("p_size") * 1000, 0))
    return table(spark, root, "part").select("p_partkey", tx.number_of(token).alias("number"))


@add("f18_similarity_ratio")
def f18(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of different part names that are alike."""
    return joins.alike_pairs(table(spark, root, "part").select("p_name").distinct(), "p_name", 0.6)


@add("h_hash_identity", "SELECT doc_id, sha256(text) AS sha, sha1('rule|' || doc_id || '|' || lower(lang))[:12] AS sig FROM documents")
def h1(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.sha1(F.concat_ws("|", F.lit("rule"), "doc_id", F.lower("lang"))), 1, 12).alias("sig"))


def _components(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, root, "customer").select(
        key,
        (key * 7 % 101).cast("int").alias("security"),
        (key * 13 % 101).cast("int").alias("supportability"),
        (key * 17 % 101).cast("int").alias("health"),
        (key * 29 % 101).cast("int").alias("tech_debt"),
        (key * 31 % 101).cast("int").alias("complexity"),
        (key * 37 % 101).cast("int").alias("coupling"),
        (key * 41 % 101).cast("int").alias("ux"),
    )


COMPONENTS = "SELECT c_custkey, (c_custkey * 7 % 101)::INTEGER AS security, (c_custkey * 13 % 101)::INTEGER AS supportability, (c_custkey * 17 % 101)::INTEGER AS health, (c_custkey * 29 % 101)::INTEGER AS tech_debt, (c_custkey * 31 % 101)::INTEGER AS complexity, (c_custkey * 37 % 101)::INTEGER AS coupling, (c_custkey * 41 % 101)::INTEGER AS ux FROM customer"


@add(
    "v1_dimension_deductions",
    """WITH f AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'security' WHEN 'O' THEN 'accessibility' ELSE 'usability' END AS category, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity FROM orders),
    d AS (SELECT o_custkey, CASE WHEN category IN ('accessibility', 'usability') THEN 'ux' ELSE 'security' END AS dim, category AS rule, CASE WHEN category = 'security' THEN CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 7 WHEN 'low' THEN 3 ELSE 0 END
    WHEN category = 'accessibility' THEN CASE severity WHEN 'high' THEN 15 WHEN 'medium' THEN 6 WHEN 'low' THEN 2 ELSE 0 END ELSE CASE severity WHEN 'high' THEN 12 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END END AS points FROM f)
    SELECT o_custkey, dim, greatest(0, 100 - sum(points))::BIGINT AS score FROM d GROUP BY ALL""",
)
def v1(spark: SparkSession, root: str) -> DataFrame:
    from weftline.operators.aggregates import capped_score

    category = F.when(F.col("o_orderstatus") == "F", "security").when(F.col("o_orderstatus") == "O", "accessibility").otherwise("usability")
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    findings = table(spark, root, "orders").select("o_custkey", category.alias("category"), severity.alias("severity"))
    return capped_score(dc.deductions(findings, "o_custkey", "category", "severity"), ["o_custkey", "dim"], "rule", "points", "cap")


@add("v2_grades", f"WITH c AS ({COMPONENTS}) SELECT c_custkey, CASE WHEN health >= 80 THEN 'good' WHEN health >= 60 THEN 'fair' WHEN health >= 40 THEN 'poor' ELSE 'critical' END AS grade, round_even(health * 0.15::DOUBLE + tech_debt * 0.18::DOUBLE + security * 0.24::DOUBLE + supportability * 0.18::DOUBLE + complexity * 0.08::DOUBLE + coupling * 0.07::DOUBLE + ux * 0.1::DOUBLE, 0)::DOUBLE AS overall FROM c")
def v2(spark: SparkSession, root: str) -> DataFrame:
    scores = {d: F.col(d) for d in dc.WEIGHTS}
    return _components(spark, root).select("c_custkey", dc.grade(F.col("health")).alias("grade"), dc.overall(scores).alias("overall"))


@add(
    "v3_v4_risk",
    f"""WITH c AS ({COMPONENTS}), l AS (SELECT *, least(security, supportability, health) AS worst FROM c), b AS (SELECT *, CASE WHEN worst < tech_debt + 15 THEN worst::DOUBLE ELSE (worst + tech_debt) / 2 END AS base FROM l),
    r AS (SELECT c_custkey, CASE WHEN base < 30 THEN 5 WHEN base < 50 THEN 4 WHEN base < 70 THEN 3 WHEN base < 85 THEN 2 ELSE 1 END AS likelihood, CASE WHEN c_custkey % 7 = 0 THEN 4 WHEN c_custkey % 3 = 0 THEN 4 WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END AS impact FROM b)
    SELECT c_custkey, likelihood, impact, CASE WHEN likelihood * impact >= 20 THEN 'critical' WHEN likelihood * impact >= 12 THEN 'high' WHEN likelihood * impact >= 6 THEN 'medium' ELSE 'low' END AS level FROM r""",
)
def v3(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("c_custkey")
    rated = _components(spark, root).select(key, dc.likelihood(*[F.col(c) for c in ("security", "supportability", "health", "tech_debt")]).alias("likelihood"), dc.impact(key % 7 == 0, key % 3 == 0, key % 2 == 0).alias("impact"))
    return rated.withColumn("level", dc.risk_level(F.col("likelihood") * F.col("impact")))


@add(
    "v5_dispositions",
    f"""WITH c AS (SELECT *, c_custkey % 97 = 0 AS retire, c_custkey % 89 = 0 AS cots, c_custkey % 5 = 0 AS no_path, (c_custkey % 11) / 10.0::DOUBLE AS nps, (c_custkey % 13) / 12.0::DOUBLE AS mf, (c_custkey % 17) / 16.0::DOUBLE AS eol, c_custkey % 4 AS comps, c_custkey % 3 AS high FROM ({COMPONENTS}))
    SELECT c_custkey, CASE WHEN retire THEN 'retire' WHEN cots THEN 'replace' WHEN no_path AND (nps >= 0.5 OR tech_debt < 45 OR health < 50) THEN 'rearchitect' WHEN supportability < 40 AND tech_debt < 40 THEN 'rearchitect'
    WHEN mf >= 0.5 AND supportability < 70 AND tech_debt >= 55 AND security >= 50 THEN 'rehost' WHEN eol >= 0.5 AND tech_debt >= 45 THEN 'replatform' WHEN supportability < 60 AND tech_debt >= 45 THEN 'replatform'
    WHEN greatest(eol, nps) >= 0.2 AND comps > 1 AND tech_debt >= 45 THEN 'replatform' WHEN security < 70 OR tech_debt < 60 OR health < 60 OR high > 0 THEN 'refactor' ELSE 'retain' END AS disposition FROM c""",
)
def v5(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("c_custkey")
    facts = {d: F.col(d) for d in ("security", "supportability", "health", "tech_debt")}
    facts |= {"retire": key % 97 == 0, "cots": key % 89 == 0, "no_path": key % 5 == 0, "no_path_share": (key % 11) / F.lit(10.0), "mainframe_share": (key % 13) / F.lit(12.0), "eol_share": (key % 17) / F.lit(16.0), "components": key % 4, "high_findings": key % 3}
    return _components(spark, root).select("c_custkey", dc.disposition(facts).alias("disposition"))


@add(
    "v6_confidence",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE (c_custkey % 101) / 100.0::DOUBLE END AS ratio, c_custkey % 30 AS files, c_custkey % 3 AS unc, c_custkey % 7 AS part, c_custkey % 11 AS failed FROM customer),
    a AS (SELECT *, CASE WHEN ratio IS NULL OR files < 5 OR ratio < 0.6 THEN 0 WHEN ratio < 0.85 THEN 1 ELSE 2 END AS r, greatest(2.0::DOUBLE, 0.2::DOUBLE * greatest(1, files)) AS many FROM c), b AS (SELECT *, CASE WHEN unc > 0 AND r = 2 THEN 1 ELSE r END AS r1 FROM a),
    p AS (SELECT *, CASE WHEN part > 0 THEN least(r1, CASE WHEN part >= many THEN 0 ELSE 1 END) ELSE r1 END AS r2 FROM b), f AS (SELECT *, CASE WHEN failed > 0 THEN least(r2, CASE WHEN failed >= many THEN 0 ELSE 1 END) ELSE r2 END AS r3 FROM p)
    SELECT c_custkey, ['low', 'medium', 'high'][r3 + 1] AS level FROM f""",
)
def v6(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("c_custkey")
    ratio = F.when(key % 19 == 0, F.lit(None)).otherwise((key % 101) / F.lit(100.0))
    return table(spark, root, "customer").select("c_custkey", dc.confidence(ratio, key % 30, key % 3, key % 7, key % 11).alias("level"))


@add("v7_severity_shift", "SELECT o_orderkey, ['info','low','medium','high','critical'][greatest(1, least(5, (o_orderkey % 5)::INTEGER + 1 + CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'P' THEN -1 ELSE 0 END))] AS severity FROM orders")
def v7(spark: SparkSession, root: str) -> DataFrame:
    scale = F.array(*[F.lit(x) for x in dc.SEVERITIES])
    shift = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", -1).otherwise(0)
    return table(spark, root, "orders").select("o_orderkey", dc.severity_shift(F.element_at(scale, (F.col("o_orderkey") % 5 + 1).cast("int")), shift).alias("severity"))


@add("v8_placeholder_class", "SELECT p_partkey, CASE WHEN p_type IN ('table', 'file') THEN 'external' WHEN starts_with(lower(p_name), 'small') OR starts_with(lower(p_name), 'hot') THEN 'library' ELSE 'missing_code' END AS class FROM part")
def v8(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", dc.placeholder_class(F.lower("p_type"), F.col("p_name"), ("small", "hot")).alias("class"))


@add("v9_line_state", "SELECT event_id, CASE WHEN value > 50 THEN 'conflict' WHEN event_type = 'error' THEN 'mismatch' WHEN event_type IN ('purchase', 'signup') THEN 'verified' ELSE 'unchecked' END AS state FROM events")
def v9(spark: SparkSession, root: str) -> DataFrame:
    state = F.when(F.col("value") > 50, "conflict").when(F.col("event_type") == "error", "mismatch").when(F.col("event_type").isin("purchase", "signup"), "verified").otherwise("unchecked")
    return table(spark, root, "events").select("event_id", state.alias("state"))


@add("v11_reference_join", "SELECT o_orderkey, r.cwe FROM orders JOIN (VALUES ('1-URGENT', 'CWE-89'), ('2-HIGH', 'CWE-79'), ('3-MEDIUM', 'CWE-798')) r(rule, cwe) ON r.rule = o_orderpriority")
def v11(spark: SparkSession, root: str) -> DataFrame:
    refs = spark.sql("SELECT * FROM VALUES ('1-URGENT', 'CWE-89'), ('2-HIGH', 'CWE-79'), ('3-MEDIUM', 'CWE-798') AS r(rule, cwe)")  # fixed values
    return table(spark, root, "orders").join(F.broadcast(refs), F.col("rule") == F.col("o_orderpriority")).select("o_orderkey", "cwe")


@add(
    "v_cost_with_cache_weights",
    "SELECT l_orderkey, l_linenumber, round_even((l_partkey + l_suppkey * 1.25::DOUBLE + l_linenumber * 2.0::DOUBLE + l_quantity * 0.1::DOUBLE) * 3.0::DOUBLE + l_orderkey * 15.0::DOUBLE, 0) / 1000000 AS cost FROM lineitem",
)
def v_cost(spark: SparkSession, root: str) -> DataFrame:
    c = F.col
    cost = dc.usage_cost(F.lit(3.0), F.lit(15.0), c("l_partkey"), c("l_orderkey"), c("l_suppkey"), c("l_linenumber"), c("l_quantity"))
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", cost.alias("cost"))


@add(
    "v_lifecycle_status",
    "SELECT o_orderkey, CASE WHEN e AND x > d THEN 'extended' WHEN e THEN 'eol' WHEN eol - d <= 365 THEN 'ending' ELSE 'supported' END AS status FROM (SELECT o_orderkey, DATE '1996-06-01' AS d, o_orderdate::DATE AS eol, o_orderdate::DATE + 400 AS x, o_orderdate::DATE <= DATE '1996-06-01' AS e FROM orders)",
)
def v_life(spark: SparkSession, root: str) -> DataFrame:
    eol = F.col("o_orderdate").cast("date")
    status = dc.lifecycle_status(F.lit("1996-06-01").cast("date"), eol, F.lit(None).cast("boolean"), F.date_add(eol, 400))
    return table(spark, root, "orders").select("o_orderkey", status.alias("status"))


@add("v_contrast_and_cvss")
def v_contrast(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("n_nationkey")
    colour = F.concat(F.lit("#"), F.lpad(F.lower(F.hex((key * 654321 % 16777215).cast("long"))), 6, "0"))
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(key / by) % len(values) + 1).cast("int"))
    score = dc.cvss_base(pick("NALP", 1), pick("LH", 2), pick("NLH", 3), pick("NR", 4), pick("UC", 5), pick("HLN", 1), pick("HLN", 3), pick("HLN", 2))
    return table(spark, root, "nation").select("n_nationkey", dc.contrast(colour, F.lit("#ffffff")).alias("contrast"), score.alias("cvss"))


@add("v_half_steps", "SELECT p_partkey, CASE WHEN p_retailprice >= 1 THEN round_even(p_retailprice / 100 * 2, 0) / 2 ELSE round_even(p_retailprice / 100, 1) END::DOUBLE AS weeks FROM part")
def v_half(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", dc.half_steps(F.col("p_retailprice") / 100).alias("weeks"))


@registry.add("f19_ratio_bound", "SELECT p_partkey, CASE WHEN length(p_name) + length(p_type) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * least(length(p_name), length(p_type)) / (length(p_name) + length(p_type)) END AS bound FROM part")
def f19(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", tx.ratio_bound(F.col("p_name"), F.col("p_type")).alias("bound"))
