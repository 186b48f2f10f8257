"""Configuration files (X12): JSON and XML of any depth, and properties or INI files, as rows (doc, path, name, value, section, secret, n).

JSON is opened one level a round with VARIANT: what is an object or an array goes on to the next
round, the rest are values; rounds end with the deepest file. XML is cut in tags once; the depth of a tag is a
running sum, its parent the last tag opened one level up, and paths grow one level a round by a join on
the parent. A text that is not well formed gives no row. n is the first line that shows the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.brackets import counted, let, running_sums
from weftline.operators.lines import carried_down, split_lines_of
from weftline.operators.rules.facts import attrs, first_of, relation, united
from weftline.staging import stage

ITEM = ["doc", "path", "name", "value", "section", "secret", "n"]
# Names whose value is a secret, the secret inside a connection, and the forms of connections and addresses.
SECRET_NAME = r"(?i)(password|passwd|pwd|secret|token|apikey|api_key|accesskey|privatekey|credential)"
SECRET_INSIDE = r"(?i)\b((?:password|pwd)\s*=\s*)[^;\"'\s][^;\"']*"
CONNECTION = r"(?i)(Data Source|Server|Initial Catalog|Database|DSN|Provider)\s*=|jdbc:[a-z0-9]+:"
ADDRESS = r"(?i)^\s*(https?|net\.tcp|net\.pipe|ldap|ftp|sftp)://([^/:?#]+)"
TAG = r"<!--(?s:.*?)-->|<\?(?s:.*?)\?>|<!\[CDATA\[(?s:.*?)\]\]>|<!DOCTYPE[^>]*>|</[^>]*>|<[A-Za-z_][^<>]*>"
ATTRIBUTE = r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def _item(rows: DataFrame, path: Column, name: Column, value: Column, section: Column, n: Column, *more: Column) -> DataFrame:
    """Masked items; the plain value stays as `said` for links."""
    hidden = name.rlike(SECRET_NAME)
    inside = F.regexp_replace(value, SECRET_INSIDE, "$1****")
    masked = F.when(hidden & (value != ""), "****").otherwise(inside)
    return rows.select("doc", path.alias("path"), name.alias("name"), masked.alias("value"), section.alias("section"), F.coalesce(masked != value, F.lit(False)).alias("secret"), n.cast("int").alias("n"), value.alias("said"), *more)


def _line_of(text: Column, needle: Column) -> Column:
    """The first line that holds the needle; 1 without."""
    return F.when(F.contains(text, needle), counted(F.call_function("substring_index", text, needle, F.lit(1)), "\n") + 1).otherwise(1)


def _docs(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("string").alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL")


def json_items(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Items of JSON files: path by colons, section is its first part where it has several."""
    held = stage(_docs(docs, key, text), "json")
    level = held.select("doc", F.array().cast("array<string>").alias("path"), F.expr("to_json(try_parse_json(text))").alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        opened = level.withColumn("v", F.parse_json("v"))
        inner = opened.where(F.expr("schema_of_variant(v)").rlike("^(?:OBJECT|ARRAY)")).lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "k", "inner"))
        inner = stage(inner.select("doc", F.concat("path", F.array(F.coalesce("k", F.col("pos").cast("string")))).alias("path"), F.to_json("inner").alias("v"), F.expr("schema_of_variant(inner)").alias("kind")), "json_level")
        values = inner.where(~F.col("kind").rlike("^(?:OBJECT|ARRAY|VOID)")).select("doc", "path", F.expr("variant_get(parse_json(v), '$', 'string')").alias("value"))
        found = values if found is None else found.unionByName(values)
        level = inner.where(F.col("kind").rlike("^(?:OBJECT|ARRAY)")).select("doc", "path", "v")
        if level.isEmpty():
            break
    last = F.concat(F.lit('"'), F.element_at("path", -1), F.lit('"'))
    placed = found.join(held, "doc").withColumn("n", _line_of(F.col("text"), last))
    name = F.array_join("path", ":")
    return _item(placed, name, name, F.col("value"), F.when(F.size("path") > 1, F.get("path", 0)), F.col("n"))


def property_items(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Items of name=value and name: value lines; [section] lines begin a section; #, ; and ! begin comments."""
    rows = split_lines_of(_docs(docs, key, text), "doc").withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).where((F.col("line") != "") & ~F.col("line").rlike("^[#;!]"))
    rows = carried_down(rows, ["doc"], ["n"], F.when(F.col("line").rlike(r"^\[[^\]]+\]$"), F.regexp_extract("line", r"^\[([^\]]+)\]$", 1)), "section")
    form = r"^([^=:\s][^=:]*?)\s*[=:]\s*(.*)$"
    rows = rows.where(F.col("line").rlike(form) & ~F.col("line").rlike(r"^\[[^\]]+\]$"))
    name = F.trim(F.regexp_extract("line", form, 1))
    return _item(rows, F.concat_ws(":", "section", name), name, F.regexp_extract("line", form, 2), F.col("section"), F.col("n"))


def _plain(text: Column) -> Column:
    """Character references of XML as what they stand for."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def xml_elements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, pos, path (names from the root, by slashes), tag, parent (its pos), depth, attributes (a map), body (the text before the next tag), n, of well-formed files; names without namespaces."""
    held = _docs(docs, key, text)
    tags = F.regexp_extract_all("text", F.lit(TAG), F.lit(0))
    gaps = F.split("text", TAG, -1)
    lines = lambda t, g: let(running_sums(F.zip_with(t, g, lambda x, y: counted(F.coalesce(x, F.lit("")), "\n") + counted(F.coalesce(y, F.lit("")), "\n"))), lambda s: s)
    cut = held.withColumns({"t": tags, "g": gaps}).where("size(t) > 0").withColumn("after", lines(F.col("t"), F.col("g")))
    each = cut.select("doc", F.trim(F.get("g", 0)).alias("ahead"), F.posexplode(F.arrays_zip(F.col("t").alias("t"), F.slice("g", F.lit(2), F.size("g")).alias("body"), F.col("after").alias("after"))).alias("pos", "x"))
    each = each.select("doc", "ahead", "pos", F.col("x.t").alias("t"), F.coalesce("x.body", F.lit("")).alias("body"), (F.col("x.after") - counted(F.col("x.t"), "\n") + 1).alias("n")).where(~F.col("t").rlike(r"^<(?:\?|!--|!DOCTYPE)"))
    opens, closes = F.col("t").rlike(r"^<[A-Za-z_]"), F.startswith("t", F.lit("</"))
    alone = opens & F.endswith("t", F.lit("/>"))
    each = each.withColumns({"opens": opens, "closes": closes, "alone": alone, "tag": F.regexp_replace(F.regexp_extract("t", r"^</?([^\s/>]+)", 1), r"^[^:]*:", "")})
    order = W.partitionBy("doc").orderBy("pos")
    step = F.when(F.col("opens") & ~F.col("alone"), 1).when(F.col("closes"), -1).otherwise(0)
    each = each.withColumn("sum", F.sum(step).over(order)).withColumn("depth", F.when(F.col("opens") & ~F.col("alone"), F.col("sum")).otherwise(F.col("sum") + 1))
    each = stage(each, "tags")
    # a closing tag must have the name of the tag last opened on its level; the text holds one root and nothing beside it
    level = W.partitionBy("doc", "depth").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("opens") & ~F.col("alone"), F.col("tag")), ignorenulls=True).over(level)
    checked = each.withColumn("fits", ~F.col("closes") | F.coalesce(opened == F.col("tag"), F.lit(False)))
    stray = F.col("sum").isin(0) & (F.trim(F.regexp_replace("body", r"\s", "")) != "")
    facts = checked.groupBy("doc").agg(F.min("sum").alias("low"), F.max_by("sum", "pos").alias("end"), F.bool_and("fits").alias("fit"), F.count_if(F.col("opens") & (F.col("depth") == 1)).alias("roots"), F.bool_or(stray | F.contains("body", F.lit("<"))).alias("stray"))
    sound = facts.where("low >= 0 AND end = 0 AND fit AND roots = 1 AND NOT stray").select("doc")
    rows = each.join(sound, "doc")
    # the parent is the last tag opened one level up
    own = rows.where("opens").select("doc", "pos", "depth", "tag", "t", "body", "n", F.lit(True).alias("asks"))
    asked = own.select("doc", "pos", (F.col("depth") - 1).alias("level"), F.lit(None).cast("int").alias("is"), F.lit(True).alias("asks"))
    held_at = rows.where("opens AND NOT alone").select("doc", "pos", F.col("depth").alias("level"), F.col("pos").alias("is"), F.lit(False).alias("asks"))
    before = W.partitionBy("doc", "level").orderBy("pos", "asks").rowsBetween(W.unboundedPreceding, -1)
    parents = asked.unionByName(held_at).withColumn("parent", F.last("is", ignorenulls=True).over(before)).where("asks").select("doc", "pos", "parent")
    values = F.transform(F.arrays_zip(*[F.regexp_extract_all("t", F.lit(ATTRIBUTE), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)]), lambda a: F.struct(F.regexp_replace(a["g1"], r"^[^:]*:", "").alias("key"), _plain(F.concat(a["g2"], a["g3"])).alias("value")))
    first = F.filter(values, lambda v, i: ~F.exists(F.slice(values, F.lit(1), i), lambda u: u["key"] == v["key"]))
    own = stage(own.join(parents, ["doc", "pos"]).select("doc", "pos", "parent", "depth", "tag", F.map_from_entries(first).alias("attributes"), F.trim(_plain(F.col("body")), F.lit(" \t\r\n")).alias("body"), "n"), "elements")
    done = front = own.where("parent IS NULL").withColumn("path", F.col("tag"))
    while True:
        front = stage(own.alias("c").join(front.select("doc", F.col("pos").alias("parent"), F.col("path").alias("above")), ["doc", "parent"]).select("doc", "pos", "parent", "depth", "tag", "attributes", "body", "n", F.concat_ws("/", "above", "tag").alias("path")), "paths")
        if front.isEmpty():
            return done
        done = done.unionByName(front)


def xml_items(elements: DataFrame) -> DataFrame:
    """Items of XML configuration: connection strings, settings of key and value, endpoints, and parameters with their name and value in elements."""
    a = lambda name: F.try_element_at("attributes", F.lit(name))
    add = F.col("tag") == "add"
    cases = [
        (add & a("connectionString").isNotNull(), F.coalesce(a("name"), F.lit("connection")), a("connectionString"), F.lit("connectionStrings")),
        (add & a("key").isNotNull() & a("value").isNotNull(), a("key"), a("value"), F.lit("appSettings")),
        ((F.col("tag") == "endpoint") & a("address").isNotNull(), F.coalesce(a("name"), a("contract"), a("address")), a("address"), F.lit("serviceModel")),
    ]
    found = [_item(elements.where(when), F.concat_ws("/", "path", name), name, value, section, F.col("n")) for when, name, value, section in cases]
    params = elements.where(F.col("tag").isin("context-param", "init-param")).select("doc", F.col("pos").alias("parent"), "path", F.col("tag").alias("section"))
    part = lambda tag, column: elements.where(F.col("tag") == tag).groupBy("doc", "parent").agg(F.min_by(F.struct("body", "n"), "pos").alias(column))
    named = params.join(part("param-name", "name_of"), ["doc", "parent"]).join(part("param-value", "value_of"), ["doc", "parent"], "left").where("name_of.body <> ''")
    found.append(_item(named, F.concat_ws("/", "path", "name_of.body"), F.col("name_of.body"), F.coalesce("value_of.body", F.lit("")), F.col("section"), F.col("name_of.n")))
    return united(found)


def servlet_routes(elements: DataFrame) -> DataFrame:
    """Relations of web.xml: each url-pattern calls the class of its servlet."""
    of = lambda tag, inner: elements.where(F.col("tag") == inner).select("doc", "parent", F.col("body").alias(inner.replace("-", "_")), "n").join(elements.where(F.col("tag") == tag).select("doc", F.col("pos").alias("parent")), ["doc", "parent"])
    classes = of("servlet", "servlet-name").drop("n").join(of("servlet", "servlet-class").drop("n"), ["doc", "parent"]).drop("parent")
    routes = of("servlet-mapping", "servlet-name").drop("n").join(of("servlet-mapping", "url-pattern"), ["doc", "parent"]).drop("parent")
    met = routes.join(classes, ["doc", "servlet_name"])
    return relation(met, "calls", F.concat(F.lit("ANY "), "url_pattern"), F.concat(F.lit("class:"), F.regexp_extract("servlet_class", r"([^.]*)$", 1)), attrs(servlet_class=F.col("servlet_class")))


def first_items(items: DataFrame) -> DataFrame:
    """ITEM and said: of items with one section and name in a file, the first."""
    nth = F.row_number().over(W.partitionBy("doc", "section", "name").orderBy("n", "path", "value"))
    return items.withColumn("nth", nth).where("nth = 1").select(*ITEM, "said")


def item_links(items: DataFrame) -> DataFrame:
    """Relations connects_to of items whose value is a connection (data_store) or an address (external_system); connections are masked."""
    jdbc = F.regexp_extract("said", r"(?i)(jdbc:[^\s\"']+)", 1)
    named = F.nullif(F.regexp_extract(jdbc, r"(?i)(?:databaseName|database|dbname)=([^;&]+)", 1), F.lit(""))
    tail = F.element_at(F.split(F.regexp_replace(F.get(F.split(F.get(F.split(jdbc, r"\?"), 0), ";"), 0), "/+$", ""), "[/:@]"), -1)
    stated = [F.nullif(F.trim(F.regexp_extract("said", rf"(?i){k}\s*=\s*([^;\"']+)", 1)), F.lit("")) for k in ("Initial Catalog", "Database", "DSN", "Data Source", "Server")]
    target = F.when(jdbc != "", F.coalesce(named, F.when(~tail.rlike(r"^\d*$"), tail))).otherwise(F.coalesce(*stated))
    stores = items.where(F.col("said").rlike(CONNECTION)).withColumn("to", target).where("to IS NOT NULL")
    hosts = items.where(F.col("said").rlike(ADDRESS)).withColumn("to", F.lower(F.regexp_extract("said", ADDRESS, 2)))
    return first_of(
        united(
            [
                relation(stores, "connects_to", "name", F.concat(F.lit("data_store:"), F.upper("to")), attrs(store_type=F.lit("database"), connection=F.col("value"))),
                relation(hosts, "connects_to", "name", F.concat(F.lit("external_system:"), "to"), attrs(url=F.trim("said"), protocol=F.lower(F.regexp_extract("said", ADDRESS, 1)))),
            ]
        )
    )
