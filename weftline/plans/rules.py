"""Queries of the rules and extractors (R*, X*, S10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import lines
from weftline.operators.rules import checks, configs, ddl, line_rules
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
add = registry.add


@add("r1_line_rules", """SELECT p_partkey, 1 AS n, CASE p_partkey % 3 WHEN 0 THEN 'SEC-CRED' ELSE 'SEC-CMD' END AS rule, CASE p_partkey % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS severity, CASE p_partkey % 3 WHEN 0 THEN 'password = "****"' ELSE 'os.system(command)' END AS snippet FROM part WHERE p_partkey % 3 < 2""")
def r1(spark: SparkSession, root: str) -> DataFrame:
    """One line of a script per part: a credential literal, a shell call, or nothing of note."""
    kind = F.col("p_partkey") % 3
    line = F.when(kind == 0, F.concat(F.lit('password = "'), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit('"'))).when(kind == 1, "os.system(command)").otherwise("print(total)")
    return line_rules.scan(table(spark, root, "part").select("p_partkey", F.lit(1).alias("n"), line.alias("line"), F.lit("python").alias("family")), "p_partkey")


@add(
    "r1_rules_on_code",
    """SELECT p_partkey, 2 AS n, CASE p_partkey % 3 WHEN 0 THEN 'SEC-CRED' WHEN 1 THEN 'SEC-CMD' ELSE 'SEC-SQLI' END AS rule, CASE p_partkey % 3 WHEN 1 THEN 'medium' ELSE 'high' END AS severity, CASE p_partkey % 3 WHEN 0 THEN 'password = "****"  # password = "****"' WHEN 1 THEN 'os.system(command) # x' ELSE 'sql = "SELECT a FROM t WHERE k = " + ' || split_part(p_name, ' ', 1) END AS snippet FROM part
    WHERE p_size % 2 = 0""",
)
def r1_code(spark: SparkSession, root: str) -> DataFrame:
    """Scripts of three lines; what stands in comments, as all of it does where the part's size is odd, is no finding."""
    kind = F.col("p_partkey") % 3
    code = F.when(kind == 0, F.concat(F.lit('password = "'), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit('"  # password = "no"'))).when(kind == 1, "os.system(command) # x").otherwise(F.concat(F.lit('sql = "SELECT a FROM t WHERE k = " + '), F.split_part("p_name", F.lit(" "), F.lit(1))))
    text = F.concat(F.lit('# password = "abcdef1"\n'), F.when(F.col("p_size") % 2 == 0, code).otherwise(F.concat(F.lit("#"), code)), F.lit("\n# eval(x)"))
    return line_rules.scan_documents(table(spark, root, "part").select("p_partkey", text.alias("text"), F.lit("python").alias("family")), "p_partkey")


@add("r3_missing_guard", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), g AS (SELECT *, max(CASE WHEN contains(line, ' and ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS g FROM l) SELECT doc_id, n::INTEGER AS n FROM g WHERE contains(line, 'the') AND g = 0""")
def r3(spark: SparkSession, root: str) -> DataFrame:
    return checks.missing_before(lines.lines_of(table(spark, root, "documents")), "doc_id", "the", " and ")


@add("r4_personal_data_spread")
def r4(spark: SparkSession, root: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("studentId", "homeAddress", "total", "amount", "lineNo", "dob")])
    fields = table(spark, root, "part").select((F.col("p_partkey") % 100).alias("owner"), F.element_at(names, (F.col("p_size") % 6 + 1)).alias("name"))
    links = table(spark, root, "lineitem").select((F.col("l_partkey") % 100 + 100).alias("from_owner"), (F.col("l_partkey") % 100).alias("to_owner")).distinct()
    return checks.personal_data_spread(fields, links)[1]


@add("r8_repeated_secrets", r"""WITH h AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?i)(?:password|secret|token|api_?key)\s*[:=]\s*["'']([^"'']{6,})["'']', 1))) AS v FROM documents) SELECT sha256(v) AS digest, count(DISTINCT doc_id) AS holders, min(doc_id) AS first FROM h GROUP BY v HAVING count(DISTINCT doc_id) >= 2""")
def r8(spark: SparkSession, root: str) -> DataFrame:
    return checks.repeated_secrets(table(spark, root, "documents"))


@add("r10_unread_settings", r"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.-]*'))) AS word FROM documents), s AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT 'the') SELECT name FROM s WHERE lower(name) NOT IN (SELECT word FROM w)""")
def r10(spark: SparkSession, root: str) -> DataFrame:
    named = table(spark, root, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).unionAll(spark.range(1).select(F.lit("the"))).distinct()
    return checks.unread_settings(named, table(spark, root, "documents"))


@add("r13_first_of_two", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, min(CASE WHEN contains(line, 'token') THEN n END)::INTEGER AS a, min(CASE WHEN contains(line, '.') THEN n END)::INTEGER AS b FROM l GROUP BY 1 HAVING min(CASE WHEN contains(line, 'token') THEN n END) IS NOT NULL AND min(CASE WHEN contains(line, '.') THEN n END) IS NOT NULL")
def r13(spark: SparkSession, root: str) -> DataFrame:
    return checks.first_of_two(lines.lines_of(table(spark, root, "documents")), "doc_id", "token", "[.]")


@add("r14_page_checks")
def r14(spark: SparkSession, root: str) -> DataFrame:
    return checks.page_checks(table(spark, root, "pages"))


@add("r17_stated_counts")
def r17(spark: SparkSession, root: str) -> DataFrame:
    actual = spark.sql("SELECT * FROM VALUES ('version', 1), ('parts', 5) AS a(noun, actual)")
    return checks.stated_counts(table(spark, root, "documents"), actual)


@add("r18_contradictions", r"""WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents), n AS (SELECT doc_id - 1 AS doc_id, split_part(text, chr(10), 1) AS next FROM d),
    p AS (SELECT doc_id, body, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS x, trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN split_part(text, chr(10), 3) ELSE next END, '\s+', ' ', 'g')) AS y FROM d LEFT JOIN n USING (doc_id))
    SELECT DISTINCT doc_id, least(x, y) AS "left", greatest(x, y) AS "right" FROM p WHERE x <> '' AND y <> '' AND x <> y AND contains(body, x) AND contains(body, y)""")
def r18(spark: SparkSession, root: str) -> DataFrame:
    """A document's first line against its third (even ids), or against the next document's first line."""
    docs = table(spark, root, "documents")
    line = lambda n: F.split_part("text", F.lit("\n"), F.lit(n))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), line(1).alias("next"))
    pairs = docs.join(after, "doc_id", "left").select("doc_id", line(1).alias("left"), F.when(F.col("doc_id") % 2 == 0, line(3)).otherwise(F.col("next")).alias("right"))
    return checks.contradictions(pairs, docs)


@add("x2_sql_references")
def x2(spark: SparkSession, root: str) -> DataFrame:
    statement = F.format_string("SELECT a FROM %s JOIN t%d ON 1 = 1; -- FROM nothing\nUPDATE w%d SET a = 'from x'", F.lower("p_type"), F.col("p_size"), F.col("p_size"))
    return checks.sql_references(table(spark, root, "part").select("p_partkey", statement.alias("text")), "p_partkey")


ORDERS_AS_DDL = "o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, c_nationkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS k FROM orders JOIN customer ON c_custkey = o_custkey)"


def _scripts(spark: SparkSession, root: str) -> DataFrame:
    """One script a customer that has orders: a table with a column an order, some of them keys to other tables, and a view."""
    joined = table(spark, root, "orders").join(table(spark, root, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    column = F.concat(F.format_string("  C%d DECIMAL(%d, 2)", "o_orderkey", F.length("o_orderpriority")), F.when(F.col("o_orderstatus") == "F", " NOT NULL").when(F.col("o_orderstatus") == "P", F.concat(F.lit(" REFERENCES N"), "c_nationkey", F.lit(" (ID)"))).otherwise(""))
    columns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", column.alias("said")))), lambda x: x["said"]), ",\n")
    held = joined.groupBy("o_custkey").agg(columns.alias("columns"), F.min("o_orderkey").alias("first"), F.min("c_nationkey").alias("nation"))
    text = F.concat(F.format_string("-- CREATE TABLE NONE (A INT)\nCREATE TABLE T%d (\n", "o_custkey"), "columns", F.format_string(",\n  PRIMARY KEY (C%d)\n);\nCREATE VIEW V%d AS SELECT ', FROM X' FROM T%d JOIN N%d;\n", "first", "o_custkey", "o_custkey", "nation"))
    return held.select(F.col("o_custkey").alias("doc_id"), F.format_string("s%d.sql", "o_custkey").alias("name"), text.alias("text"))


@add(
    "x2_sql_columns",
    f"WITH {ORDERS_AS_DDL} SELECT o_custkey::VARCHAR AS doc, 'T' || o_custkey AS parent, 'C' || o_orderkey AS name, (i + 2)::INTEGER AS n, 'DECIMAL(' || length(o_orderpriority) || ', 2)' AS type, CASE WHEN o_orderstatus = 'F' OR i = 1 THEN 'false' ELSE 'true' END AS nullable, CASE WHEN i = 1 THEN 'true' END AS primary_key FROM o",
)
def x2_columns(spark: SparkSession, root: str) -> DataFrame:
    entities, _ = ddl.sql_structure(_scripts(spark, root))
    told = lambda name: F.col("attrs")[name].alias(name)
    return entities.where("kind = 'column'").select("doc", "parent", "name", "n", told("type"), told("nullable"), told("primary_key"))


@add(
    "x2_sql_relations",
    f"""WITH {ORDERS_AS_DDL} SELECT o_custkey::VARCHAR AS doc, 'depends_on' AS kind, 'T' || o_custkey AS source, 'table:N' || c_nationkey AS target, (i + 2)::INTEGER AS n, 'C' || o_orderkey AS foreign_key FROM o WHERE o_orderstatus = 'P'
    UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 'reads', 'V' || o_custkey, 'table:' || t, (k + 5)::INTEGER, NULL FROM o, LATERAL (SELECT unnest(['T' || o_custkey, 'N' || c_nationkey]) AS t)""",
)
def x2_relations(spark: SparkSession, root: str) -> DataFrame:
    _, relations = ddl.sql_structure(_scripts(spark, root))
    return relations.select("doc", "kind", "source", "target", "n", F.col("attrs")["foreign_key"].alias("foreign_key"))


@add("x8_block_balance", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), d AS (SELECT *, sum(len(regexp_extract_all(line, '[(]')) - len(regexp_extract_all(line, '[)]'))) OVER (PARTITION BY doc_id ORDER BY n) AS depth FROM l) SELECT doc_id, min(CASE WHEN depth < 0 THEN n END)::INTEGER AS first_bad, arg_max(depth, n)::BIGINT AS left_open FROM d GROUP BY 1""")
def x8(spark: SparkSession, root: str) -> DataFrame:
    return checks.block_balance(lines.lines_of(table(spark, root, "documents")), "doc_id", "[(]", "[)]")


@add("x12_properties")
def x12(spark: SparkSession, root: str) -> DataFrame:
    body = F.format_string("# comment\nname=%s\npassword=%d\nsize : %d", "p_name", F.col("p_partkey"), F.col("p_size"))
    return checks.properties(table(spark, root, "part").select("p_partkey", body.alias("text")), "p_partkey")


@add(
    "x12_json_items",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
    SELECT o_custkey::VARCHAR AS doc, 'orders:' || i || ':status:code' AS name, o_orderstatus AS value, 'orders' AS section, false AS secret FROM o
    UNION ALL SELECT o_custkey::VARCHAR, 'orders:' || i || ':token', '****', 'orders', true FROM o
    UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 'id', o_custkey::VARCHAR, NULL, false FROM o""",
)
def x12_json(spark: SparkSession, root: str) -> DataFrame:
    """One nested file a customer: its orders, each with a status below it and a token."""
    order = F.struct("o_orderkey", F.struct(F.col("o_orderstatus").alias("code")).alias("status"), F.col("o_orderpriority").alias("token"))
    held = table(spark, root, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x["status"].alias("status"), x["token"].alias("token"))).alias("orders"))
    texts = held.select(F.col("o_custkey").alias("doc_id"), F.to_json(F.struct(F.col("o_custkey").alias("id"), "orders")).alias("text"))
    return configs.first_items(configs.json_items(texts)).select("doc", "name", "value", "section", "secret")


@add(
    "x12_xml_items",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS k FROM orders)
    SELECT o_custkey::VARCHAR AS doc, 'K' || o_orderkey AS name, o_orderpriority AS value, 'appSettings' AS section, (i + 2)::INTEGER AS n FROM o WHERE o_custkey % 5 <> 0
    UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 'C' || o_custkey, 'Database=D' || o_custkey || ';Pwd=****', 'connectionStrings', (k + 4)::INTEGER FROM o WHERE o_custkey % 5 <> 0""",
)
def x12_xml(spark: SparkSession, root: str) -> DataFrame:
    """One file a customer, a setting an order; every fifth file is not well formed."""
    setting = F.concat(F.format_string('<add key="K%d" value="', "o_orderkey"), "o_orderpriority", F.lit('"/>'))
    held = table(spark, root, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", setting.alias("s")))), lambda x: x["s"]), "\n").alias("body"))
    close = F.when(F.col("o_custkey") % 5 == 0, "</configuratio>").otherwise("</configuration>")
    text = F.concat(F.lit("<configuration>\n<appSettings>\n"), "body", F.format_string('\n</appSettings>\n<add name="C%d" connectionString="Database=D%d;Pwd=x"/>\n', "o_custkey", "o_custkey"), close)
    items = configs.first_items(configs.xml_items(configs.xml_elements(held.select(F.col("o_custkey").alias("doc_id"), text.alias("text")))))
    return items.select("doc", "name", "value", "section", "n")


@add("x14_page_links", r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, list_sort(list_distinct(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"'']+)["'']', 1))) AS links FROM pages""")
def x14(spark: SparkSession, root: str) -> DataFrame:
    return checks.page_links(table(spark, root, "pages"))


@add("x17_url_hosts", r"""SELECT lower(host) AS host, count(*) AS n FROM (SELECT unnest(regexp_extract_all(url, '(?i)\bhttps?://([a-z0-9.-]+)', 1)) AS host FROM pages) GROUP BY 1""")
def x17(spark: SparkSession, root: str) -> DataFrame:
    return checks.url_hosts(table(spark, root, "pages"), "url")


@add("s10_crawl")
def s10(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "pages")
    start = pages.agg(F.min("url")).first()[0]
    return checks.crawl(pages, start)


CODE = ("if (day == \"SATURDAY\") {", "if (day == \"SATURDAY\" || day == \"SUNDAY\") {", "write(a + \",\" + b)", "INSERT INTO t VALUES (1)", "try { x(); } catch (Exception e) {}")


@add("r9_logic_findings", "SELECT p_partkey, 2 AS n, ['weekend-by-one-day', 'csv-formula', 'unsafe-rerun', 'swallowed'][[1, NULL, 2, 3, 4][p_partkey % 5 + 1]] AS rule FROM part WHERE p_partkey % 5 <> 1 AND NOT (p_partkey % 5 = 3 AND p_size % 2 = 0) AND NOT (p_partkey % 5 = 2 AND p_size % 3 = 0)")
def r9(spark: SparkSession, root: str) -> DataFrame:
    """One doubtful line a part, some with what makes it sound on the line before."""
    k = (F.col("p_partkey") % 5 + 1).cast("int")
    guard = F.when((k == 4) & (F.col("p_size") % 2 == 0), "DELETE FROM t").when((k == 3) & (F.col("p_size") % 3 == 0), "a = escapeCsv(a)").otherwise("start()")
    text = F.concat(guard, F.lit("\n"), F.element_at(F.array(*[F.lit(c) for c in CODE]), k))
    return checks.logic_findings(lines.lines_of(table(spark, root, "part").select("p_partkey", text.alias("text")), "p_partkey"), "p_partkey")


@add(
    "r9_never_set",
    "WITH u AS (SELECT o_custkey AS owner, o_orderpriority AS value, o_orderkey % 3 = 0 AS made FROM orders) SELECT DISTINCT owner, value FROM u WHERE NOT made EXCEPT SELECT owner, value FROM u WHERE made",
)
def r9_never_set(spark: SparkSession, root: str) -> DataFrame:
    uses = table(spark, root, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("value"), (F.col("o_orderkey") % 3 == 0).alias("set"))
    return checks.never_set(uses.select("owner", "value").distinct(), uses)


@add(
    "r11_truncations",
    "WITH w AS (SELECT p_size % 20 AS field, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY 1) SELECT p_partkey AS id, p_size % 20 AS source, p_partkey % 20 AS target, (a.most - b.least)::INTEGER AS lost FROM part JOIN w a ON a.field = p_size % 20 JOIN w b ON b.field = p_partkey % 20 WHERE a.most > b.least",
)
def r11(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part")
    moves = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 20).alias("source"), (F.col("p_partkey") % 20).alias("target"))
    return checks.truncations(moves, part.select((F.col("p_size") % 20).alias("field"), F.col("p_size").alias("width")))


@add(
    "r6_lifecycle_inventory",
    """WITH c(cycle, eol, flag, extended) AS (VALUES ('1', DATE '2020-01-01', NULL, DATE '2027-01-01'), ('2.0', DATE '2026-06-01', NULL, NULL), ('2', NULL, true, NULL), ('3', DATE '2030-01-01', NULL, NULL)),
    u AS (SELECT p_partkey AS file, p_brand AS product, CASE WHEN p_partkey % 11 > 0 THEN (p_size % 5) || '.' || (p_size % 3) END AS version, p_partkey % 4 = 0 AS confirmed FROM part),
    p AS (SELECT u.*, CASE WHEN version IS NULL THEN NULL WHEN version IN (SELECT cycle FROM c) THEN version ELSE (SELECT cycle FROM c WHERE cycle = split_part(version, '.', 1)) END AS cycle FROM u),
    g AS (SELECT product, cycle, bool_or(confirmed) AS confirmed, count(DISTINCT file) FILTER (confirmed) AS sure, count(DISTINCT file) AS n FROM p GROUP BY ALL)
    SELECT product, g.cycle, CASE g.cycle WHEN '1' THEN 'extended' WHEN '2.0' THEN 'ending' WHEN '2' THEN 'eol' WHEN '3' THEN 'supported' ELSE 'unknown' END AS status, confirmed, CASE WHEN confirmed THEN sure ELSE n END AS files FROM g""",
)
def r6(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part")
    version = F.when(F.col("p_partkey") % 11 > 0, F.concat_ws(".", (F.col("p_size") % 5).cast("string"), (F.col("p_size") % 3).cast("string")))
    uses = part.select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("product"), version.alias("version"), (F.col("p_partkey") % 4 == 0).alias("confirmed"))
    dates = spark.sql("SELECT * FROM VALUES ('1', DATE'2020-01-01', NULL, DATE'2027-01-01'), ('2.0', DATE'2026-06-01', NULL, NULL), ('2', NULL, true, NULL), ('3', DATE'2030-01-01', NULL, NULL) AS c(cycle, eol, eol_flag, extended)")
    rows = dates.agg(F.collect_list(F.struct("*")).alias("c"))  # four rows, spelled out for each product
    cycles = part.select(F.col("p_brand").alias("product"), F.lit(1).alias("one")).distinct().join(rows.withColumn("one", F.lit(1)), "one").select("product", F.explode("c").alias("c")).select("product", "c.*")
    return checks.lifecycle_inventory(uses, cycles, F.lit("2026-01-01").cast("date"))
