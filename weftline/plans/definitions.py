"""Queries of API definitions, UI screens, capture quality and delivery (X13, X15, R20, N19), on texts spelled from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import reports
from weftline.operators.rules import definitions
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
add = registry.add

OPENAPI = """{"openapi": "3.0.%d", "basePath": "/v%d/",
 "servers": [{"url": "https://h%d.example.org:8443/a"}],
 "paths": {
  "/parts/%d": {"get": {"operationId": "read%d"},
    "delete": {"deprecated": true, "security": [{"key": []}]}, "parameters": []},
  "/v%d/ping": {"head": {"summary": "ping"}}}}"""
WSDL = """<?xml version="1.0"?>
<wsdl:definitions xmlns:wsdl="http://schemas.xmlsoap.org/wsdl/" xmlns:s="urn:s" name="D%d">
 <wsdl:portType name="P%d">
  <wsdl:operation name="Get%d"><wsdl:documentation> reads </wsdl:documentation></wsdl:operation>
  <wsdl:operation name="Put%d"/>
 </wsdl:portType>
 <wsdl:service name="S%d"><wsdl:port name="q">
  <s:address location="http://Soap%d.example.org/x"/></wsdl:port></wsdl:service>
</wsdl:definitions>"""


def api_texts(spark: SparkSession, root: str) -> DataFrame:
    """One definition a part: WSDL for every third, no definition for every seventh, OpenAPI for the rest."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 7 == 0, "no {definition}").when(k % 3 == 0, F.format_string(WSDL, k, s, k, k, s, s)).otherwise(F.format_string(OPENAPI, s, s, s, k, k, s))
    return table(spark, root, "part").select(k.alias("doc_id"), text.alias("text"))


@add(
    "x13_api_endpoints",
    """WITH p AS (SELECT p_partkey AS k, p_size::VARCHAR AS s FROM part WHERE p_partkey % 7 <> 0), o AS (SELECT * FROM p WHERE k % 3 <> 0), w AS (SELECT * FROM p WHERE k % 3 = 0)
    SELECT k AS doc_id, 'GET /v' || s || '/parts/' || k AS name, NULL AS port_type, 4 AS line, 'read' || k AS operation_id, NULL AS summary, NULL::BOOLEAN AS deprecated, NULL::BOOLEAN AS secured FROM o
    UNION ALL SELECT k, 'DELETE /v' || s || '/parts/' || k, NULL, 4, NULL, NULL, true, true FROM o
    UNION ALL SELECT k, 'HEAD /v' || s || '/ping', NULL, 6, NULL, 'ping', NULL, NULL FROM o
    UNION ALL SELECT k, 'SOAP S' || s || '/Get' || k, 'P' || s, 4, NULL, 'reads', NULL, NULL FROM w
    UNION ALL SELECT k, 'SOAP S' || s || '/Put' || k, 'P' || s, 5, NULL, NULL, NULL, NULL FROM w""",
)
def x13(spark: SparkSession, root: str) -> DataFrame:
    return definitions.api_endpoints(api_texts(spark, root)).drop("method", "path")


@add("x13_api_hosts", "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'soap' ELSE 'h' END || p_size || '.example.org' AS host, CASE WHEN p_partkey % 3 = 0 THEN 'soap' ELSE 'https' END AS protocol, count(*) AS n, CASE WHEN p_partkey % 3 = 0 THEN 8 ELSE 2 END AS line FROM part WHERE p_partkey % 7 <> 0 GROUP BY ALL")
def x13_hosts(spark: SparkSession, root: str) -> DataFrame:
    return definitions.api_hosts(api_texts(spark, root)).groupBy("host", "protocol", "line").agg(F.count("*").alias("n"))


@add(
    "x15_ui_elements",
    """WITH p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand FROM part WHERE p_partkey % 5 <> 0)
    SELECT k AS doc_id, name AS screen, brand AS name, 'text' AS kind, true AS input, false AS action FROM p
    UNION ALL SELECT k, name, brand || ' (2)', 'table', false, false FROM p
    UNION ALL SELECT k, name, 'field 3', NULL, true, false FROM p
    UNION ALL SELECT k, name, brand || ' (action)', 'button', false, true FROM p
    UNION ALL SELECT k, name, 'Save', 'link', false, true FROM p""",
)
def x15(spark: SparkSession, root: str) -> DataFrame:
    screen = """{"%s": "1", "title": " %s ", "fields": [{"label": "%s", "kind": "text"}, {"label": " %s", "kind": "table"}, {"label": ""}],
    "actions": [{"label": "%s"}, {"label": " "}, {"label": "Save", "kind": "link"}]}"""
    marker = F.when(F.col("p_partkey") % 5 == 0, "other").otherwise("ui_screen")
    text = F.format_string(screen, marker, "p_name", "p_brand", "p_brand", "p_brand")
    return definitions.ui_elements(table(spark, root, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")), "ui_screen").drop("label")


@add(
    "r20_capture_quality",
    """WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber::INTEGER AS line, CASE l_partkey % 6 WHEN 0 THEN 'wrapped' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'spacing' WHEN 3 THEN 'glyph' ELSE 'dup' END AS kind, l_returnflag = 'R' AS lit FROM lineitem),
    m AS (SELECT doc_id, line, CASE WHEN kind IN ('wrapped', 'mismatch') THEN CASE WHEN lit THEN 'prose' ELSE 'mismatch' END ELSE kind END AS kind FROM f UNION ALL SELECT l_orderkey, l_linenumber::INTEGER + 3, 'model' FROM lineitem WHERE l_discount > 0.09),
    r AS (SELECT doc_id, kind, line, line - row_number() OVER (PARTITION BY doc_id, kind ORDER BY line) AS g FROM (SELECT DISTINCT * FROM m)),
    i AS (SELECT doc_id, kind, g, min(line) AS lo, max(line) AS hi FROM r GROUP BY ALL),
    j AS (SELECT doc_id, kind || ':' || string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) AS said, kind FROM i GROUP BY doc_id, kind),
    k AS (SELECT doc_id, string_agg(said, ' ' ORDER BY kind) AS issues, bool_or(kind IN ('mismatch', 'model')) AS again FROM j GROUP BY 1),
    b AS (SELECT m.doc_id, count(DISTINCT line) AS n FROM m JOIN documents d ON d.doc_id = m.doc_id WHERE kind NOT IN ('glyph', 'prose') AND (kind <> 'model' OR line <= len(string_split(text, chr(10)))) GROUP BY 1)
    SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN 'good' WHEN k.again THEN 'rescan' WHEN d.doc_id % 3 = 0 THEN 'unchecked' ELSE 'good' END AS status,
    CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE coalesce(k.issues, '') END AS issues, CASE WHEN d.doc_id % 11 = 0 THEN 0 ELSE coalesce(b.n, 0) END::INTEGER AS n_bad FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN b USING (doc_id)""",
)
def r20(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "lineitem")
    mode = F.col("l_partkey") % 6
    kind = F.when(mode == 0, "wrapped").when(mode == 1, "mismatch").when(mode == 2, "spacing").when(mode == 3, "glyph").otherwise("dup")
    flags = items.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), kind.alias("kind"), (F.col("l_returnflag") == "R").alias("literal"))
    concerns = items.where("l_discount > 0.09").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") + 3).alias("line"))
    docs = table(spark, root, "documents").select("doc_id", "text", (F.col("doc_id") % 3 != 0).alias("verified"), (F.col("doc_id") % 11 == 0).alias("exact"))
    found = reports.capture_quality(docs, flags, concerns)
    issues = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["kind"], i["lines"])), " ")
    return found.select("doc_id", "status", issues.alias("issues"), F.size("bad_lines").alias("n_bad"))


@add(
    "n19_delivered_texts",
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(11) || chr(12), '  '), '[\x00-\x08\x0e-\x1f]', '', 'g'),
    '(^|[^A-Za-z])(?i:of the|of_the)', '\1ACME', 'g'), '(^|[^A-Za-z])the', '\1ACME', 'g'), '_+(\.[A-Za-z0-9]+\b)', '\1', 'g'), '__+', '_', 'g')) AS h FROM documents""",
)
def n19(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.sha2(tx.delivered(F.col("text"), ("the", "of the"), "ACME"), 256).alias("h"))
