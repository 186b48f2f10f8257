"""Facts in structured texts: API definitions (X13) and read UI screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.staging import dealt

# Fixed values.
METHODS = ("get", "post", "put", "delete", "patch", "head", "options")
NO_INPUT = ("display", "table", "button", "link", "menu", "tab")

OPENAPI = "openapi string, swagger string, basePath string, security string, servers array<struct<url: string>>, paths map<string, string>"
OPERATION = "operationId string, summary string, deprecated boolean, security string"
PORT_TYPE = "array<struct<_name: string, operation: array<struct<_name: string, documentation: string>>>>"
SERVICE = "array<struct<_name: string, port: array<struct<_name: string, address: struct<_location: string>>>>>"
#: The first element, behind declarations and comments of any length.
ROOT_DEFINITIONS = r"(?s)^\x{FEFF}?\s*(?:<[?].*?[?]>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*+<(?:[\w.-]+:)?definitions\b"
WSDL = f"_name string, portType {PORT_TYPE}, service {SERVICE}"


def line_of(text: Column, needle: Column) -> Column:
    """The line of the first occurrence, 1 where there is none. The needle has no line end."""
    before = F.call_function("substring_index", text, needle, F.lit(1))
    return F.when(F.contains(text, needle), F.size(F.split(before, "\n"))).otherwise(1)


def _stated(json: Column) -> Column:
    """A JSON value that is there and neither empty nor false."""
    return F.coalesce(~F.regexp_replace(json, r"\s", "").isin("", "[]", "{}", "false", "null"), F.lit(False))


def _openapi(docs: DataFrame, key: str, text: str) -> DataFrame:
    read = docs.select(key, F.col(text).alias("t"), F.from_json(text, OPENAPI).alias("d"))
    return read.where("d.paths IS NOT NULL AND (d.openapi IS NOT NULL OR d.swagger IS NOT NULL)")


def _wsdl(docs: DataFrame, key: str, text: str) -> DataFrame:
    like = F.col(text).rlike(ROOT_DEFINITIONS) & F.contains(F.lower(text), F.lit("wsdl"))
    return docs.where(like).select(key, F.col(text).alias("t"), F.from_xml(F.col(text), WSDL, {"ignoreNamespace": "true"}).alias("d"))


def api_endpoints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, name, method, path, port_type, line, operation_id, summary, deprecated, secured) of each operation.

    OpenAPI as JSON and WSDL. What is no definition, or cannot be read, gives no row; path items and
    operations that are no objects are left out. Flags are true or null. A text leaves the row before
    its paths are spelled out. Texts are dealt by key first: reading one takes far longer than its bytes tell.
    """
    docs = dealt(docs.select(key, text), key)
    base = F.coalesce(F.rtrim(F.col("d.basePath"), F.lit("/")), F.lit(""))
    quoted = lambda p: F.concat(F.lit('"'), p, F.lit('"'))
    paths = F.transform(F.map_entries("d.paths"), lambda e: F.struct(e["key"].alias("path"), F.from_json(e["value"], "map<string, string>").alias("ops"), line_of(F.col("t"), quoted(e["key"])).alias("line")))
    each = _openapi(docs, key, text).select(key, base.alias("base"), _stated(F.col("d.security")).alias("all_secured"), F.explode(paths).alias("p"))
    each = each.select(key, "base", "all_secured", "p.path", "p.line", F.explode("p.ops").alias("method", "body"))
    each = each.where(F.lower("method").isin(*METHODS) & F.startswith(F.ltrim("body"), F.lit("{"))).withColumn("op", F.from_json("body", OPERATION))
    full = F.when((F.col("base") != "") & ~F.startswith("path", F.col("base")), F.concat("base", "path")).otherwise(F.col("path"))
    true = lambda c: F.when(c, True)
    rest = each.select(
        key, F.concat(F.upper("method"), F.lit(" "), full).alias("name"), F.upper("method").alias("method"), full.alias("path"), F.lit(None).cast("string").alias("port_type"), "line",
        F.col("op.operationId").alias("operation_id"), F.col("op.summary").alias("summary"), true(F.col("op.deprecated")).alias("deprecated"), true(_stated(F.col("op.security")) | F.col("all_secured")).alias("secured"),
    )
    operations = F.flatten(F.transform("d.portType", lambda p: F.transform(p["operation"], lambda o: F.struct(p["_name"].alias("port_type"), o["_name"].alias("op"), o["documentation"].alias("doc"), line_of(F.col("t"), F.concat(F.lit('name="'), o["_name"], F.lit('"'))).alias("line")))))
    service = F.coalesce(F.element_at("d.service", 1)["_name"], F.col("d._name"))
    soap = _wsdl(docs, key, text).select(key, service.alias("service"), F.explode(F.filter(operations, lambda o: o["op"].isNotNull())).alias("o"))
    path = F.concat_ws("/", "service", "o.op")
    none = F.lit(None)
    soap = soap.select(
        key, F.concat(F.lit("SOAP "), path).alias("name"), F.lit("SOAP").alias("method"), path.alias("path"), "o.port_type", "o.line",
        none.cast("string").alias("operation_id"), F.nullif(F.trim("o.doc"), F.lit("")).alias("summary"), none.cast("boolean").alias("deprecated"), none.cast("boolean").alias("secured"),
    )
    return rest.unionByName(soap)


def api_hosts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, host, protocol, url, line) of the servers and service addresses that definitions state."""
    listed = lambda urls: F.transform(urls, lambda u: F.struct(u.alias("url"), line_of(F.col("t"), u).alias("line")))
    web = _openapi(docs, key, text).select(key, F.lit("https").alias("protocol"), F.lit(r"^https?://([^/:]+)").alias("form"), F.explode(listed(F.col("d.servers.url"))).alias("u"))
    addresses = F.flatten(F.transform("d.service", lambda s: F.transform(s["port"], lambda p: p["address"]["_location"])))
    soap = _wsdl(docs, key, text).select(key, F.lit("soap").alias("protocol"), F.lit(r"^\w+://([^/:]+)").alias("form"), F.explode(listed(addresses)).alias("u"))
    host = F.expr("regexp_extract(u.url, form, 1)")
    return web.unionByName(soap).select(key, F.lower(host).alias("host"), "protocol", "u.url", "u.line").where("host <> ''")


def ui_elements(docs: DataFrame, marker: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, screen, name, kind, label, input, action) of each field and action of a read screen.

    A screen is a JSON object with the member `marker`. Names are unique within a screen: a label that
    comes again gets its place, an action's label that stands already gets the word action.
    """
    schema = f"`{marker}` string, title string, fields array<struct<label: string, kind: string>>, actions array<struct<label: string, kind: string>>"
    read = docs.select(key, F.from_json(text, schema).alias("d")).where(F.col("d")[marker].isNotNull())
    title = F.trim(F.regexp_replace(F.coalesce("d.title", F.lit("")), r"\s+", " "))
    read = read.select(key, F.when(title == "", "screen").otherwise(title).alias("screen"), F.coalesce("d.fields", F.array()).alias("f"), F.coalesce("d.actions", F.array()).alias("a"))
    shown = F.trim
    stated = lambda label: F.nullif(label, F.lit(""))
    fields = F.transform("f", lambda x, i: F.struct(shown(F.coalesce(stated(x["label"]), F.concat(F.lit("field "), (i + 1).cast("string")))).alias("label"), x["kind"].alias("kind")))
    actions = F.filter(F.transform("a", lambda x: F.struct(shown(F.coalesce(x["label"], F.lit(""))).alias("label"), F.coalesce(stated(x["kind"]), F.lit("button")).alias("kind"))), lambda x: x["label"] != "")
    read = read.select(key, "screen", fields.alias("f"), actions.alias("a"))

    def with_name(suffix):
        return lambda seen, label: F.concat(seen, F.array(F.when(F.array_contains(seen, label), F.concat(label, suffix(seen))).otherwise(label)))

    place = lambda seen: F.concat(F.lit(" ("), (F.size(seen) + 1).cast("string"), F.lit(")"))
    read = read.withColumn("names", F.aggregate(F.col("f.label"), F.array().cast("array<string>"), with_name(place)))
    read = read.withColumn("names", F.aggregate(F.col("a.label"), F.col("names"), with_name(lambda seen: F.lit(" (action)"))))
    each = read.select(key, "screen", F.posexplode(F.arrays_zip(F.concat("f", "a").alias("e"), F.col("names").alias("name"))).alias("at", "x"), F.size("f").alias("n"))
    action = F.col("at") >= F.col("n")
    fills = ~action & ~F.coalesce(F.col("x.e.kind").isin(*NO_INPUT), F.lit(False))
    return each.select(key, "screen", F.col("x.name").alias("name"), F.col("x.e.kind").alias("kind"), F.col("x.e.label").alias("label"), fills.alias("input"), action.alias("action"))
