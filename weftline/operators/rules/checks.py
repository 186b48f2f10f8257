"""Cross-document and whole-document checks (R3, R4, R8 to R12, R14, R17, R18), and text extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import number_of, personal_data_class


def _all(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def missing_before(lines: DataFrame, key: str, wanted: str, guard: str, rows: int = 8) -> DataFrame:
    """(key, n) of lines that match `wanted` without a `guard` in the line or the `rows` before it."""
    near = W.partitionBy(key).orderBy("n").rowsBetween(-rows, 0)
    guarded = F.max(F.col("line").rlike(guard).cast("int")).over(near)
    return lines.withColumn("__g", guarded).where(F.col("line").rlike(wanted) & (F.col("__g") == 0)).select(key, "n")


def personal_data_spread(fields: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(personal fields, owners they reach in one hop). fields: owner, name; edges: from_owner, to_owner."""
    personal = fields.withColumn("c", personal_data_class(F.col("name"))).where("c IS NOT NULL").select("owner", "name", "c.label", "c.severity")
    owners = personal.select("owner").distinct()
    reached = owners.union(edges.join(owners, F.col("to_owner") == F.col("owner")).select("from_owner")).distinct()
    return personal, reached


def repeated_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of quoted secret values that two or more documents hold; the values themselves are not kept."""
    hits = docs.select(key, F.explode(F.array_distinct(_all(text, r"""(?i)(?:password|secret|token|api_?key)\s*[:=]\s*["']([^"']{6,})["']"""))).alias("value"))
    return hits.groupBy(F.sha2("value", 256).alias("digest")).agg(F.count_distinct(key).alias("holders"), F.min(key).alias("first")).where("holders >= 2")


def unread_settings(settings: DataFrame, code: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Defined names that no text mentions as a whole word."""
    words = code.select(F.explode(F.array_distinct(_all(text, r"([A-Za-z_][A-Za-z0-9_.-]*)"))).alias("word")).distinct()
    return settings.join(words, F.lower(name) == F.lower("word"), "left_anti")


def swallowed_failures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Handlers that do nothing, per document."""
    hits = F.size(_all(text, r"(?i)(catch\s*\([^)]*\)\s*\{\s*\}|except[^:\n]*:\s*pass\b|when\s+others\s+then\s+null)"))
    return docs.select(key, hits.alias("handlers")).where("handlers > 0")


def first_of_two(lines: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(key, a, b): the first lines that match two patterns, where both occur."""
    at = lambda pattern: F.min(F.when(F.col("line").rlike(pattern), F.col("n")))
    return lines.groupBy(key).agg(at(first).alias("a"), at(second).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def page_checks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, rule, n): tag rules on whole pages; one row per broken rule."""
    h = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<script\b.*?</script>", ""), r"(?s)<!--.*?-->", "")
    tags = lambda pattern: F.size(_all(h, pattern, 0))
    rules = {
        "no-language": F.when(h.rlike(r"(?i)<html\b") & ~h.rlike(r"(?i)<html[^>]*\slang\s*="), 1).otherwise(0),
        "no-title": F.when(h.rlike(r"(?is)<title>\s*\S"), 0).otherwise(1),
        "image-without-text": tags(r"(?i)<img\b(?![^>]*\balt\s*=)[^>]*>"),
        "vague-link": tags(r"(?i)<a\b[^>]*>\s*(?:click here|here|more|read more|link)\s*</a>"),
        "empty-link": tags(r"(?i)<a\b[^>]*>\s*</a>"),
        "no-zoom": tags(r"(?i)<meta\b[^>]*user-scalable\s*=\s*no[^>]*>"),
        "password-shown": tags(r"""(?i)<input\b(?=[^>]*name\s*=\s*["']?\w*passw)(?![^>]*type\s*=\s*["']?password)[^>]*>"""),
        "form-by-get": tags(r"""(?i)<form\b(?![^>]*method\s*=\s*["']?post)[^>]*>"""),
        "mixed-content": tags(r"""(?i)<(?:img|script|iframe|link)\b[^>]*(?:src|href)\s*=\s*["']http://"""),
        "duplicate-heading": F.greatest(F.lit(0), tags(r"(?i)<h1\b") - 1),
    }
    found = F.filter(F.array(*[F.struct(F.lit(name).alias("rule"), n.cast("int").alias("n")) for name, n in rules.items()]), lambda r: r["n"] > 0)
    return pages.select(key, F.explode(found).alias("r")).select(key, "r.*")


def stated_counts(docs: DataFrame, actual: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, noun, stated, actual) where a number before a known noun differs. actual: noun, actual."""
    hits = docs.select(key, F.explode(_all(text, r"(?i)\b((?:[0-9][0-9,]*|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+[a-z]+)", 1)).alias("hit"))
    parts = hits.select(key, number_of(F.regexp_extract("hit", r"^(\S+)", 1)).alias("stated"), F.lower(F.regexp_extract("hit", r"(\S+)$", 1)).alias("noun"))
    return parts.join(actual, "noun").where(F.col("stated") != F.col("actual")).select(key, "noun", "stated", "actual").distinct()


def contradictions(pairs: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, left, right): pairs of different quotes (columns key, left, right) that both occur in their document, each unordered pair once."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    asked = pairs.select(F.col(key).alias("asked_of"), plain("left").alias("x"), plain("right").alias("y")).where("x <> '' AND y <> '' AND x <> y")
    met = asked.join(docs.select(F.col(key).alias("held_by"), plain(text).alias("body")), F.col("asked_of") == F.col("held_by"))
    both = met.where(F.contains("body", "x") & F.contains("body", "y"))
    return both.select(F.col("asked_of").alias(key), F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right")).distinct()


def sql_references(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, name): tables read, written or defined in SQL text; comments and strings are blanked first."""
    sql = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "), r"'[^']*'", "''")
    name = r"([A-Za-z_][\w.]*)"
    kinds = {
        "reads": rf"(?i)\b(?:from|join)\s+{name}",
        "writes": rf"(?i)\b(?:insert\s+into|update|delete\s+from|merge\s+into)\s+{name}",
        "defines": rf"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?{name}",
    }
    listed = F.flatten(F.array(*[_kind_of(kind, F.array_distinct(F.transform(_all(sql, pattern), F.lower))) for kind, pattern in kinds.items()]))
    found = docs.select(key, F.explode(listed).alias("r")).select(key, "r.*")
    wrote = found.where("kind <> 'reads'").select(key, "name").distinct()
    return found.where("kind <> 'reads'").unionAll(found.where("kind = 'reads'").join(wrote, [key, "name"], "left_anti").select(key, "kind", "name"))


def _kind_of(kind: str, names: Column) -> Column:
    return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))


def block_balance(lines: DataFrame, key: str, opens: str, closes: str) -> DataFrame:
    """(key, first_bad, left_open): the first line where more blocks are closed than open, and how many stay open."""
    delta = F.size(_all("line", opens, 0)) - F.size(_all("line", closes, 0))
    order = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    depth = lines.withColumn("depth", F.sum(delta).over(order))
    return depth.groupBy(key).agg(F.min(F.when(F.col("depth") < 0, F.col("n"))).alias("first_bad"), F.max_by("depth", "n").alias("left_open"))


def properties(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, name, value) of name=value lines; # and ! start comments; secret-looking values are masked."""
    rows = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")).where(~F.col("line").rlike(r"^\s*[#!]") & F.col("line").rlike(r"^\s*[\w.-]+\s*[=:]"))
    name, value = F.regexp_extract("line", r"^\s*([\w.-]+)\s*[=:]", 1), F.trim(F.regexp_extract("line", r"^\s*[\w.-]+\s*[=:]\s*(.*)$", 1))
    return rows.select(key, (F.col("at") + 1).alias("n"), name.alias("name"), F.when(name.rlike("(?i)pass|pwd|secret|token|key"), "****").otherwise(value).alias("value"))


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, links) of a page."""
    links = F.array_sort(F.array_distinct(_all(html, r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']""")))
    return pages.select(key, F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)).alias("title"), links.alias("links"))


def url_hosts(df: DataFrame, text: str, own: tuple[str, ...] = ()) -> DataFrame:
    """(host, n): hosts of all addresses in a column, but for one's own."""
    hosts = df.select(F.explode(_all(text, r"""(?i)\bhttps?://([a-z0-9.-]+)""")).alias("host")).select(F.lower("host").alias("host"))
    return hosts.where(~F.col("host").isin(*own)).groupBy("host").agg(F.count("*").alias("n"))


def crawl(pages: DataFrame, start: str, most_pages: int = 10) -> DataFrame:
    """(url, depth): pages in the order a breadth-first crawl of one host visits them, at most `most_pages`, each once.

    The bound is the operator's own: it limits what a crawl takes, so the driver loop is bounded.
    """
    spark = pages.sparkSession
    site = F.regexp_extract(F.lit(start), r"^(https?://[^/]+)", 1)
    link = F.explode(F.array_distinct(_all("html", r"""(?i)\bhref\s*=\s*["']([^"'#]+)["']""")))
    out, seen, frontier = [], set(), [start]
    depth = 0
    while frontier and len(out) < most_pages:
        batch = [u for u in dict.fromkeys(frontier) if u not in seen][: most_pages - len(out)]
        seen.update(batch)
        rows = pages.where(F.col("url").isin(batch)).select("url", link.alias("to")).where(~F.col("to").startswith("http") | F.col("to").startswith(site))
        found = rows.select("url", F.when(F.col("to").startswith("http"), F.col("to")).otherwise(F.concat(site, "to")).alias("to")).collect()
        out += [(u, depth) for u in batch]
        order = {u: i for i, u in enumerate(batch)}
        frontier = [r["to"] for r in sorted(found, key=lambda r: (order[r["url"]], r["to"])) if r["to"] not in seen]
        depth += 1
    return spark.createDataFrame(out or [(start, 0)], "url string, depth int")


def logic_findings(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, rule) of lines whose logic is doubtful by form.

    weekend-by-one-day: a weekday is compared with one end of the weekend, and no line of the document
    within three names the other. csv-formula: values are joined by commas into a line of a file that
    nothing in it guards against a leading =, +, - or @. unsafe-rerun: a plain insert or append without a
    check that the rows are there. swallowed: a handler that does nothing.
    """
    near = W.partitionBy(key).orderBy("n").rowsBetween(-3, 3)
    day = lambda name: F.col("line").rlike(rf"(?i)day\w*\s*(?:\(\s*\)|\(\w+\))?\s*(?:==?|eq|\.equals\()\s*[\"']?(?:\w+\.)?{name}")
    rows = lines.withColumns({"sat": day("sat"), "sun": day("sun")})
    rows = rows.withColumns({"near_sat": F.max(F.col("sat").cast("int")).over(near), "near_sun": F.max(F.col("sun").cast("int")).over(near)})
    guards = W.partitionBy(key)
    rows = rows.withColumns({"guarded": F.max(F.col("line").rlike(r"[\"'\[]=?[+=@-]{2,}|(?i)escape.?csv|sanitize").cast("int")).over(guards), "checked": F.max(F.col("line").rlike(r"(?i)\bnot\s+exists\b|\bon\s+conflict\b|\bmerge\s+into\b|\btruncate\b|\bdelete\s+from\b").cast("int")).over(guards)})
    rules = {
        "weekend-by-one-day": (F.col("sat") & (F.col("near_sun") == 0)) | (F.col("sun") & (F.col("near_sat") == 0)),
        "csv-formula": F.col("line").rlike(r"""(?i)(?:write\w*|print\w*|append)\s*\(.*[+&]\s*["'],["']\s*[+&]""") & (F.col("guarded") == 0),
        "unsafe-rerun": F.col("line").rlike(r"(?i)\binsert\s+into\b") & (F.col("checked") == 0),
        "swallowed": F.col("line").rlike(r"(?i)catch\s*\([^)]*\)\s*\{\s*\}|except[^:]*:\s*pass\b|when\s+others\s+then\s+null|on error resume next"),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select(key, "n", F.explode(found).alias("rule"))


def never_set(states: DataFrame, uses: DataFrame) -> DataFrame:
    """(owner, value) of declared status values that their owner compares but never sets. states: owner, value; uses: owner, value, set."""
    made = uses.where("set").select("owner", "value").distinct()
    return states.join(uses.where("NOT set").select("owner", "value").distinct(), ["owner", "value"]).join(made, ["owner", "value"], "left_anti").select("owner", "value").distinct()


def truncations(moves: DataFrame, widths: DataFrame) -> DataFrame:
    """(id, source, target, lost) of moves (id, source, target) into fields narrower than their source. widths: field, width; a field of several widths counts by its narrowest as a target and its widest as a source."""
    known = widths.groupBy("field").agg(F.min("width").alias("least"), F.max("width").alias("most"))
    a, b = known.select(F.col("field").alias("source"), F.col("most").alias("from_width")), known.select(F.col("field").alias("target"), F.col("least").alias("to_width"))
    met = moves.join(a, "source").join(b, "target").where("from_width > to_width")
    return met.select("id", "source", "target", (F.col("from_width") - F.col("to_width")).alias("lost"))


def lifecycle_inventory(uses: DataFrame, cycles: DataFrame, today: Column) -> DataFrame:
    """(product, cycle, status, confirmed, files) of products in use against their support cycles.

    uses: file, product, version, confirmed; cycles: product, cycle (a version prefix), eol and
    extended (dates or null), eol_flag. A version belongs to the longest cycle it begins with, at a dot;
    a use without a version, or without such a cycle, has none and the status `unknown`. Of one
    (product, cycle) confirmed uses beat unconfirmed ones: only they are counted where there are any.
    """
    from weftline.functions.decisions import lifecycle_status

    parts = F.split(F.coalesce("version", F.lit("")), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    numbered = uses.withColumn("use", F.xxhash64("file", "product", "version", "confirmed"))
    met = numbered.select("use", "product", F.explode(prefixes).alias("cycle")).join(cycles.select("product", "cycle"), ["product", "cycle"])
    longest = met.groupBy("use").agg(F.max_by("cycle", F.length("cycle")).alias("cycle"))
    placed = numbered.join(longest, "use", "left")
    groups = placed.groupBy("product", "cycle").agg(F.bool_or("confirmed").alias("confirmed"), F.count_distinct(F.when(F.col("confirmed"), F.col("file"))).alias("sure"), F.count_distinct("file").alias("every"))
    dated = groups.alias("g").join(cycles.alias("c"), (F.col("g.product") == F.col("c.product")) & (F.col("g.cycle") == F.col("c.cycle")), "left")
    status = F.when(F.col("g.cycle").isNull(), "unknown").otherwise(lifecycle_status(today, F.col("c.eol"), F.col("c.eol_flag"), F.col("c.extended")))
    return dated.select("g.product", "g.cycle", status.alias("status"), "g.confirmed", F.when(F.col("confirmed"), F.col("sure")).otherwise(F.col("every")).alias("files"))
