"""SQL texts (X2): tables with their columns, types and keys, views, routines and triggers with what they read, write and call.

Comments and the insides of strings are blanked, line by line, and the text is cut once at the heads of
statements; a table's body is split at its commas outside brackets (`brackets`). From there on every
column, constraint, key and reference is a row, and keys stated apart (a constraint, an ALTER) come to
their columns by a join. Names are in capitals without quotes, with their schema as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.brackets import bracketed_parts, counted, let, running_sums, sections
from weftline.operators.rules.facts import ENTITY, attrs, first_of, relation, united
from weftline.staging import stage

IDENT = r"(?:\[[^\]]+\]|\"[^\"]+\"|`[^`]+`|[A-Za-z_#@$][\w#@$]*)"
QNAME = rf"{IDENT}(?:\s*\.\s*{IDENT}){{0,2}}"
SQLNAME = r"[A-Z0-9_][A-Z0-9_$#@-]*"
TABLE = rf"(?i)^\s*CREATE\s+(?:GLOBAL\s+TEMPORARY\s+|TEMPORARY\s+|TEMP\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({QNAME})\s*\("
VIEW = rf"(?i)^\s*CREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:MATERIALIZED\s+)?VIEW\s+({QNAME})(?:\s*\([^)]*\))?\s+AS\b"
ROUTINE = rf"CREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(PROCEDURE|PROC|FUNCTION|TRIGGER)\s+({QNAME})"
INDEX = rf"(?i)^\s*CREATE\s+(UNIQUE\s+)?(?:CLUSTERED\s+|NONCLUSTERED\s+)?INDEX\s+({QNAME})\s+ON\s+({QNAME})\s*\(([^)]*)\)"
ALTER = rf"(?i)^\s*ALTER\s+TABLE\s+({QNAME})\s+ADD\s+(?:CONSTRAINT\s+{IDENT}\s+)?"
FOREIGN = rf"(?i)FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+({QNAME})\s*(?:\(([^)]*)\))?"
PRIMARY = r"(?i)PRIMARY\s+KEY\s*(?:CLUSTERED\s*|NONCLUSTERED\s*)?\(([^)]*)\)"
REFERENCES = rf"(?i)\bREFERENCES\s+({QNAME})\s*(?:\(([^)]*)\))?"
READ = rf"(?i)\b(?:FROM|JOIN)\s+({SQLNAME}(?:\.{SQLNAME})?)"
WRITTEN = rf"(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+({SQLNAME}(?:\.{SQLNAME})?)"
CALLED = rf"(?i)\b(?:EXEC(?:UTE)?|CALL)\s+(?!IMMEDIATE\b)({QNAME})(?![\w\]`])(?!\s*\.\.)"
STATEMENT_HEAD = r"(?i)\b(?:CREATE|ALTER)\s+"
# Words that no table is called, and the shapes of a table's constraints (a column may have such a word as its name; then a type follows).
RESERVED = ("AS", "SET", "WHERE", "VALUES", "SELECT", "FROM", "ON", "OF", "INTO", "TABLE", "BEGIN", "END", "OR", "AND", "NEW", "OLD", "EACH", "ROW", "FOR")
CONSTRAINT = (
    r"(?i)^[\[\"`]?(?:CONSTRAINT\b|(?:PRIMARY|FOREIGN)\s+KEY\b|(?:UNIQUE|CHECK)\s*(?:\(|(?:KEY|INDEX)\b)|(?:KEY|INDEX)\s*(?:\(|[\w\[\]\"`]+\s*\(\s*[A-Za-z_\[\"`])"
    r"|(?:UNIQUE|FULLTEXT|SPATIAL)\s+(?:KEY|INDEX)\b|PERIOD\s+FOR\b|LIKE\s+[\w.\[\]\"`]+\s*(?:\w+\s+\w+\s*)*$)"
)
TYPE = r"(?i)^([A-Za-z_]\w*(?:\s+(?:VARYING|PRECISION|LARGE\s+OBJECT))?)\s*(\([^)]*\))?"


def plain_text(sql: Column) -> Column:
    """Comments as blanks and strings as blanks in quotes, both with their line ends."""
    tokens = F.regexp_extract_all(sql, F.lit(r"'[^']*+'?(?:'[^']*+')*+|--[^\n]*|/\*(?s:.*?)(?:\*/|\z)|[^'/-]+|[/-]"), F.lit(0))
    blank = lambda t: F.regexp_replace(t, r"[^\n]", " ")
    quoted = lambda t: F.concat(F.lit("'"), blank(F.substring(t, F.lit(2), F.length(t) - 2)), F.lit("'"))
    told = lambda t: F.when(F.startswith(t, F.lit("'")), quoted(t)).when(F.startswith(t, F.lit("--")) | F.startswith(t, F.lit("/*")), blank(t)).otherwise(t)
    return F.array_join(F.transform(tokens, told), "")


def _name(quoted: Column) -> Column:
    return F.upper(F.regexp_replace(quoted, r"[\[\]\"`\s]", ""))


def _last(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.]*)$", 1)


def _columns(listed: Column) -> Column:
    return F.transform(F.filter(F.split(listed, ","), lambda c: F.trim(c) != ""), lambda c: _last(_name(F.regexp_replace(c, r"(?i)\s+(?:ASC|DESC)\s*$", ""))))


def _tables(body: Column, pattern: str) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), F.upper), lambda t: ~_last(t).isin(*RESERVED)))


def _keys(rows: DataFrame, own: Column, other: Column, theirs: Column, source: Column) -> DataFrame:
    """Foreign keys as depends_on."""
    return relation(rows, "depends_on", source, F.concat(F.lit("table:"), _name(other)), attrs(foreign_key=F.array_join(own, ","), references=F.array_join(theirs, ",")))


def sql_structure(docs: DataFrame, key: str = "doc_id", name: str = "name", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of SQL scripts; see `facts`. A script that defines nothing is a job that reads and writes tables."""
    clean = stage(docs.select(F.col(key).cast("string").alias("doc"), F.coalesce(F.regexp_extract(F.col(name), r"([^/]*)$", 1), F.lit("script.sql")).alias("file"), plain_text(F.coalesce(F.col(text), F.lit(""))).alias("sql")), "sql")
    parts = clean.select("doc", F.explode(sections(F.col("sql"), STATEMENT_HEAD)).alias("s")).select("doc", "s.n", "s.text")
    # tables: the body's parts with their lines
    tables = parts.where(F.col("text").rlike(TABLE)).withColumn("name", _name(F.regexp_extract("text", TABLE, 1)))
    head = F.regexp_extract("text", TABLE, 0)
    body = bracketed_parts(F.substring(F.col("text"), F.length(head) + 1, F.length("text")), trim=False)
    tables = stage(tables.select("doc", "n", "name", counted(head, "\n").alias("above"), body.alias("body")), "tables")
    heights = F.transform("body", lambda p: counted(p, "\n"))
    last_n = F.col("n") + F.col("above") + F.aggregate(heights, F.lit(0), lambda a, x: a + x)
    schema = lambda c: F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.[^.]*$", ""))
    made = tables.select("doc", "n", "name", last_n.alias("last_n"), F.lit(None).cast("string").alias("view"))
    placed = let(running_sums(heights), lambda after: F.zip_with("body", F.zip_with(after, heights, lambda a, b: a - b), lambda p, above: F.struct(p.alias("p"), (above + counted(F.regexp_extract(p, r"^\s*", 0), "\n")).alias("down"))))
    pieces = tables.select("doc", "name", (F.col("n") + F.col("above")).alias("from_n"), F.explode(placed).alias("x"))
    pieces = pieces.select("doc", "name", (F.col("from_n") + F.col("x.down")).alias("n"), F.trim(F.regexp_replace("x.p", r"\s+", " ")).alias("piece")).where("piece <> ''")
    pieces = stage(pieces.withColumn("is_constraint", F.col("piece").rlike(CONSTRAINT)), "pieces")
    constraints = pieces.where("is_constraint")
    columns = pieces.where(~F.col("is_constraint") & F.col("piece").rlike(rf"^{IDENT}\s+\S"))
    rest = F.regexp_replace("piece", rf"^{IDENT}\s+", "")
    columns = columns.select("doc", "name", "n", _last(_name(F.regexp_extract("piece", rf"^({IDENT})", 1))).alias("column"), rest.alias("rest"))
    stated = F.when(F.col("rest").rlike(TYPE), F.concat(F.regexp_extract("rest", TYPE, 1), F.regexp_extract("rest", TYPE, 2))).otherwise(F.regexp_extract("rest", r"^(\S*)", 1))
    type_ = F.regexp_replace(F.upper(stated), r"\s+(NOT|NULL|DEFAULT|PRIMARY|REFERENCES|CONSTRAINT|WITH|GENERATED|IDENTITY|UNIQUE|CHECK|FOR)\b.*$", "")
    columns = columns.withColumns({"type": type_, "inline": F.upper("rest").contains("PRIMARY KEY"), "not_null": F.upper("rest").contains("NOT NULL")})
    altered = parts.where(F.col("text").rlike(ALTER)).withColumn("name", _name(F.regexp_extract("text", ALTER, 1))).withColumn("piece", F.regexp_replace("text", ALTER, ""))
    apart = united([c.where(F.col("piece").rlike("(?i)^.*PRIMARY\\s+KEY")).select("doc", "name", F.explode(_columns(F.regexp_extract("piece", PRIMARY, 1))).alias("column"), strict.alias("strict")) for c, strict in ((constraints, F.lit(True)), (altered.where(F.col("piece").rlike("(?i)^PRIMARY")), F.lit(False)))])
    apart = apart.groupBy("doc", "name", "column").agg(F.bool_or("strict").alias("strict"))
    keyed = columns.join(apart, ["doc", "name", "column"], "left")
    is_key = F.col("inline") | F.col("strict").isNotNull()
    fixed = F.col("not_null") | F.col("inline") | F.coalesce("strict", F.lit(False))
    column_rows = keyed.select("doc", F.lit("column").alias("kind"), F.col("column").alias("name"), F.col("name").alias("parent"), "n", F.col("n").alias("last_n"), attrs(type=F.col("type"), nullable=~fixed, primary_key=F.when(is_key, F.lit("true"))).alias("attrs"))
    # keys between tables
    get = lambda pattern, i: F.regexp_extract("piece", pattern, i)
    stated_keys = _keys(constraints.where(F.col("piece").rlike(FOREIGN)), _columns(get(FOREIGN, 1)), get(FOREIGN, 2), _columns(get(FOREIGN, 3)), F.col("name"))
    altered_keys = _keys(altered.where(F.col("piece").rlike(rf"(?i)^{FOREIGN[4:]}")), _columns(get(FOREIGN, 1)), get(FOREIGN, 2), _columns(get(FOREIGN, 3)), F.col("name"))
    inline_keys = _keys(columns.where(F.col("rest").rlike(REFERENCES)), F.array("column"), F.regexp_extract("rest", REFERENCES, 1), _columns(F.regexp_extract("rest", REFERENCES, 2)), F.col("name"))
    # views
    whole = F.split("text", r"(?im);|^\s*GO\s*$|^\s*/\s*$|^\s*@\s*$", 2)
    views = parts.where(F.col("text").rlike(VIEW)).select("doc", "n", _name(F.regexp_extract("text", VIEW, 1)).alias("name"), F.get(whole, 0).alias("body"))
    views = views.withColumn("body", F.regexp_replace("body", VIEW, ""))
    view_reads = relation(views.withColumn("t", F.explode(_tables(F.col("body"), READ))), "reads", "name", F.concat(F.lit("table:"), "t"), attrs(verb=F.lit("VIEW")))
    seen = views.select("doc", "n", "name", (F.col("n") + counted(F.col("body"), "\n")).alias("last_n"), F.lit("true").alias("view"))
    # indexes
    indexes = parts.where(F.col("text").rlike(INDEX)).select("doc", "n", _name(F.regexp_extract("text", INDEX, 3)).alias("name"), F.concat(_name(F.regexp_extract("text", INDEX, 2)), F.lit("("), F.array_join(_columns(F.regexp_extract("text", INDEX, 4)), ","), F.lit(")"), F.when(F.trim(F.regexp_extract("text", INDEX, 1)) != "", " unique").otherwise("")).alias("index"))
    indexed = indexes.groupBy("doc", "name").agg(F.array_join(F.array_sort(F.collect_set("index")), ";").alias("indexes"), F.min("n").alias("n"))
    named_only = united([indexed.select("doc", "n", "name"), altered.where(F.col("piece").rlike(rf"(?i)^{FOREIGN[4:]}")).select("doc", "n", "name")]).select("doc", "n", "name", F.col("n").alias("last_n"), F.lit(None).cast("string").alias("view"))
    rank = lambda df, r: df.withColumn("rank", F.lit(r))
    every = united([rank(made, 0), rank(seen, 1), rank(named_only, 2)])
    tables_of = every.groupBy("doc", "name").agg(F.min(F.struct("rank", "n", "last_n")).alias("at"), F.max("view").alias("view")).join(indexed.select("doc", "name", "indexes"), ["doc", "name"], "left")
    table_rows = tables_of.select("doc", F.lit("table").alias("kind"), "name", F.lit(None).cast("string").alias("parent"), F.col("at.n").alias("n"), F.col("at.last_n").alias("last_n"), attrs(schema_name=schema(F.col("name")), short_name=_last(F.col("name")), view=F.col("view"), indexes=F.col("indexes")).alias("attrs"))
    # routines
    routine = rf"(?i)^{ROUTINE}"
    cut = clean.select("doc", F.explode(sections(F.col("sql"), rf"(?i)\b{ROUTINE}")).alias("s")).select("doc", "s.n", "s.text")
    kind = F.upper(F.regexp_extract("text", routine, 1))
    cut = cut.select("doc", "n", F.when(kind == "PROC", "PROCEDURE").otherwise(kind).alias("of"), _name(F.regexp_extract("text", routine, 2)).alias("name"), F.regexp_replace("text", routine, "").alias("body"), counted(F.regexp_extract("text", routine, 0), "\n").alias("above"))
    routines = stage(cut, "routines")
    last = F.col("n") + F.col("above") + counted(F.regexp_replace("body", r"\s+$", ""), "\n")
    routine_rows = routines.select("doc", F.lit("function").alias("kind"), "name", F.lit(None).cast("string").alias("parent"), "n", last.alias("last_n"), attrs(sql_object=F.lower("of")).alias("attrs"))
    on = F.coalesce(F.nullif(F.regexp_extract("body", rf"(?i)^\s*ON\s+({QNAME})", 1), F.lit("")), F.nullif(F.regexp_extract("body", rf"(?i)\b(?:BEFORE|AFTER|INSTEAD\s+OF|FOR)\b[\w\s,]*?\bON\s+({QNAME})", 1), F.lit("")))
    triggers = relation(routines.where((F.col("of") == "TRIGGER") & on.isNotNull()), "depends_on", "name", F.concat(F.lit("table:"), _name(on)), attrs(trigger_on=F.lit("true")))
    inner = F.when(F.col("of") == "TRIGGER", F.regexp_replace("body", r"(?is)^.*?\b(?:AS|BEGIN)\b", "")).otherwise(F.col("body"))
    inside = routines.withColumn("body", inner).withColumns({"writes": _tables(F.col("body"), WRITTEN), "reads": F.array_except(_tables(F.col("body"), READ), _tables(F.col("body"), WRITTEN))})
    verb = attrs(verb=F.col("of"))
    used = [relation(inside.withColumn("t", F.explode(side)), side, "name", F.concat(F.lit("table:"), "t"), verb) for side in ("reads", "writes")]
    calls = routines.select("doc", "name", (F.col("n") + F.col("above")).alias("from_n"), F.explode(sections(F.col("body"), CALLED)).alias("c"))
    calls = calls.select("doc", "name", (F.col("from_n") + F.col("c.n") - 1).alias("n"), _name(F.regexp_extract("c.text", CALLED, 1)).alias("to")).where("to <> 'SQL'")
    called = relation(calls, "calls", "name", F.concat(F.lit("function:"), "to"))
    # scripts that define nothing
    defines = tables_of.select("doc").unionByName(routines.select("doc")).distinct()
    scripts = clean.join(defines, "doc", "left_anti").select("doc", F.lit(1).alias("n"), F.col("file").alias("name"), (counted(F.col("sql"), "\n") + 1).alias("last_n"), "sql")
    scripts = scripts.withColumns({"writes": _tables(F.col("sql"), WRITTEN), "reads": F.array_except(_tables(F.col("sql"), READ), _tables(F.col("sql"), WRITTEN))})
    script_rows = scripts.select("doc", F.lit("job").alias("kind"), "name", F.lit(None).cast("string").alias("parent"), "n", "last_n", attrs(tool=F.lit("SQL script")).alias("attrs"))
    loose = [relation(scripts.withColumn("t", F.explode(side)), side, "name", F.concat(F.lit("table:"), "t")) for side in ("reads", "writes")]
    entities = united([table_rows, first_column(column_rows), routine_rows, script_rows]).select(*ENTITY)
    return entities, first_of(united([stated_keys, altered_keys, inline_keys, view_reads, triggers, *used, called, *loose]))


def first_column(rows: DataFrame) -> DataFrame:
    """Of columns of one name in one table, the first."""
    nth = F.row_number().over(W.partitionBy("doc", "parent", "name").orderBy("n"))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")
