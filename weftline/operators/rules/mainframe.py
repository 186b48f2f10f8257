"""Mainframe sources: COBOL programs and copybooks (X3), EXEC blocks (X4), BMS maps and JCL jobs.

Texts become rows once, and everything after that is windows, groups and joins over rows: what a row
belongs to (division, file description, section, paragraph, block, step) is carried down to it,
statements over several rows are folded, the parent of a data item is the nearest earlier one of a
smaller level, and names are resolved by joins (records to files, moved program names to calls,
copybooks to copybooks in rounds). A text of any length is one pass; nothing is read per document
in one piece but its rows, which a sort may spill.

The results are entities and relations as `facts` states them. Names are in capitals; a target that is not
a paragraph of the program reads kind:NAME.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.lines import carried_down, folded, split_lines_of
from weftline.operators.rules.facts import ENTITY, attrs, first_of, relation, united
from weftline.staging import dealt, stage

NAME = r"[A-Z0-9][A-Z0-9-]*"
SQLNAME = r"[A-Z0-9_][A-Z0-9_$#@-]*"
DIVISION = r"(?i)^(IDENTIFICATION|ID|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b"
SECTION = rf"(?i)^({NAME})\s+SECTION\s*\.?\s*$"
PARAGRAPH = rf"(?i)^({NAME})\s*\.\s*$"
SELECT_START = rf"(?i)\bSELECT\s+(?:OPTIONAL\s+)?{NAME}"
SELECT = rf"(?i)\bSELECT\s+(?:OPTIONAL\s+)?({NAME})\s+ASSIGN\s+(?:TO\s+)?['\"]?([A-Z0-9#@$.-]+)"
FILE_DESCRIPTION = rf"(?i)^(FD|SD)\s+({NAME})"
LEVEL = rf"(?i)^(\d{{1,2}})\s+({NAME})\s*(.*)$"
PICTURE = r"(?i)\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+?)\.?(?:\s|$)"
EXEC = r"(?i)\bEXEC\s+(CICS|SQL|DLI)\b"
END_EXEC = r"(?i)\bEND-EXEC\b"
# Words that stand alone like a paragraph's name, and verbs that begin a statement.
NOT_PARAGRAPHS = (
    "EXIT", "GOBACK", "CONTINUE", "STOP", "END-IF", "END-PERFORM", "END-EVALUATE", "END-READ", "ELSE", "END-EXEC", "END-CALL", "END-WRITE",
    "END-STRING", "END-SEARCH", "REPLACE", "EJECT", "SKIP1", "SKIP2", "SKIP3",
)
VERBS = (
    "ACCEPT", "ADD", "CALL", "CLOSE", "COMPUTE", "CONTINUE", "DELETE", "DISPLAY", "DIVIDE", "ELSE", "END-IF", "EVALUATE", "EXEC", "EXIT", "GO", "GOBACK",
    "IF", "INITIALIZE", "INSPECT", "MOVE", "MULTIPLY", "OPEN", "PERFORM", "READ", "RETURN", "REWRITE", "SEARCH", "SET", "SORT", "START", "STOP", "STRING",
    "SUBTRACT", "UNSTRING", "WHEN", "WRITE",
)
NOT_PERFORMED = ("UNTIL", "VARYING", "TEST", "WITH", "FOREVER")


def _all(text: Column, pattern: str, *groups: int) -> Column:
    """The groups g0, g1, ... of each match; an absent group is empty."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups)])


def _has(text: Column, word: str) -> Column:
    """Whether the text holds the word, in either case: a cheap look before a pattern that needs it."""
    return F.contains(F.upper(text), F.lit(word))


def with_blanks(line: Column) -> Column:
    """Tabs as blanks up to the next eighth column."""
    grown = lambda acc, x: F.concat(acc, F.repeat(F.lit(" "), 8 - F.length(acc) % 8), x)
    parts = F.split(line, "\t")
    return F.when(F.contains(line, F.lit("\t")), F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.get(parts, 0), grown)).otherwise(line)


def _stem(name: str) -> Column:
    return F.upper(F.regexp_extract(F.col(name), r"([^/\\]*?)(?:\.[^./\\]*)?$", 1))


def _read(docs: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """doc, stem, n, line. Texts are dealt by document, whole, so that windows and groups over their rows need no further exchange."""
    held = docs.select(F.col(key).cast("string").alias("doc"), F.coalesce(_stem(name), F.lit("")).alias("stem"), F.col(text).alias("text"))
    return split_lines_of(dealt(held, "doc"), ["doc", "stem"]).select("doc", "stem", "n", with_blanks(F.col("line")).alias("line"))


def logical_lines(docs: DataFrame, key: str = "doc_id", name: str = "name", text: str = "text") -> DataFrame:
    """doc, stem, n, code (without blanks at either end), area_a: COBOL rows without comments, continued ones joined.

    A text is in fixed columns when four fifths of its rows have a sequence area and an indicator; it lost
    that area when many rows begin at once and none is long; else it is free.
    """
    rows = _read(docs, key, name, text)
    written = F.trim("line") != ""
    start = F.length("line") - F.length(F.ltrim("line"))
    whole = W.partitionBy("doc").orderBy("n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shape = {
        "rows": F.count_if(written), "in_columns": F.count_if(written & F.col("line").rlike(r"^[ 0-9]{6}[ */dD-]")), "at_once": F.count_if(written & (start == 0)),
        "longest": F.max(F.when(written, F.length(F.rtrim("line")))), "declared": F.bool_or(_has(F.col("line"), "FREE") & F.col("line").rlike(r"(?i)^\s*(?:\$SET\s+SOURCEFORMAT|>>SOURCE\s+(?:FORMAT\s+)?(?:IS\s+)?)\W*FREE")),
    }
    form = F.when(F.col("declared"), "free").when(F.col("in_columns") >= 0.8 * F.col("rows"), "fixed").when((F.col("at_once") >= 0.3 * F.col("rows")) & (F.col("longest") <= 65), "shifted").otherwise("free")
    rows = rows.withColumns({k: v.over(whole) for k, v in shape.items()}).select("doc", "stem", "n", "line", form.alias("form"))
    moved = F.when(F.col("form") == "shifted", F.concat(F.when(F.col("line").rlike(r"^[*/]"), F.lit(" " * 6)).otherwise(F.lit(" " * 7)), "line")).otherwise(F.col("line"))
    rows = rows.withColumn("line", moved).withColumn("free", F.col("form") == "free")
    sign = F.when(F.col("free"), " ").otherwise(F.substring("line", 7, 1))
    code = F.when(F.col("free"), F.regexp_replace("line", r"\*>.*$", "")).otherwise(F.substring("line", 8, 65))
    area = F.when(F.col("free"), F.col("line").rlike(r"^\S")).otherwise(F.trim(F.substring("line", 8, 4)) != "")
    rows = rows.select("doc", "stem", "n", sign.alias("sign"), F.rtrim(code).alias("code"), area.alias("area_a")).where(~F.col("sign").isin("*", "/") & ((F.trim("code") != "") | (F.col("sign") == "-")))
    order = W.partitionBy("doc").orderBy("n")
    rows = rows.withColumn("begun", F.sum((F.col("sign") != "-").cast("int")).over(order)).where("begun > 0")
    piece = F.when(F.col("sign") == "-", F.regexp_replace(F.ltrim("code"), r"^['\"]", "")).otherwise(F.col("code"))
    pieces = F.array_sort(F.collect_list(F.struct("n", piece.alias("p"), "area_a")))
    whole = rows.groupBy("doc", "stem", "begun").agg(pieces.alias("p"))
    return whole.select("doc", "stem", F.get("p", 0)["n"].alias("n"), F.trim(F.array_join(F.transform("p", lambda x: x["p"]), "")).alias("code"), F.get("p", 0)["area_a"].alias("area_a"))


def _placed(lines: DataFrame) -> DataFrame:
    """Adds program, data_n and proc_n (where those divisions begin, null without), first_n and last_n."""
    here = lambda division: F.min(F.when(_has(F.col("code"), "DIVISION") & (F.upper(F.regexp_extract("code", DIVISION, 1)) == division), F.col("n")))
    stated = F.when(_has(F.col("code"), "PROGRAM-ID"), F.nullif(F.regexp_extract("code", rf"(?i)\bPROGRAM-ID\s*\.?\s*['\"]?({NAME})", 1), F.lit("")))
    whole = W.partitionBy("doc").orderBy("n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    facts = {"data_n": here("DATA"), "proc_n": here("PROCEDURE"), "first_n": F.min("n"), "end_n": F.max("n"), "stated": F.min_by(F.upper(stated), F.when(stated.isNotNull(), F.col("n")))}
    return lines.withColumns({k: v.over(whole) for k, v in facts.items()}).withColumn("program", F.coalesce("stated", F.nullif("stem", F.lit("")), F.lit("PROGRAM"))).drop("stated")


def fields(rows: DataFrame) -> DataFrame:
    """Data items of rows (doc, n, code, owner) as entities: a condition (88) belongs to the item before it, an item to the nearest earlier one of a smaller level, a 77 to the owner."""
    code = F.col("code")
    plain = ~(code.rlike(DIVISION) | code.rlike(SECTION) | code.rlike(FILE_DESCRIPTION))
    items = rows.where(plain & code.rlike(LEVEL)).select("doc", "n", "owner", F.regexp_extract("code", LEVEL, 1).cast("int").alias("level"), F.upper(F.regexp_extract("code", LEVEL, 2)).alias("name"), F.nullif(F.regexp_extract(F.regexp_extract("code", LEVEL, 3), PICTURE, 1), F.lit("")).alias("picture"))
    items = items.where((F.col("name") != "FILLER") & (F.col("level") != 66))
    before = W.partitionBy("doc").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    at = F.struct("n", "name")
    nested = ~F.col("level").isin(77, 88)
    last = F.max(F.when(nested, at)).over(before)["name"]
    of_level = F.array(*[F.max(F.when(nested & (F.col("level") == k), at)).over(before) for k in range(50)])
    items = items.withColumns({"last": last, "of_level": of_level})
    above = F.array_max(F.filter(F.slice("of_level", F.lit(1), F.greatest(F.lit(0), F.least(F.col("level"), F.lit(50)))), lambda x: x.isNotNull()))["name"]
    parent = F.coalesce(F.when(F.col("level") == 88, F.col("last")).when(F.col("level") != 77, above), F.col("owner"))
    condition = F.col("level") == 88
    told = attrs(level=F.col("level"), picture=F.when(~condition, F.col("picture")), condition=F.when(condition, F.lit("true")))
    return items.select("doc", F.lit("field").alias("kind"), "name", parent.alias("parent"), "n", F.col("n").alias("last_n"), told.alias("attrs"))


def _option(name: str) -> Column:
    """The operand of an EXEC option, in capitals; null where the body has none."""
    return F.upper(F.nullif(F.regexp_extract("body", rf"(?i)\b{name}\s*\(\s*['\"]?({NAME}(?:\.{NAME})*)['\"]?\s*\)", 1), F.lit("")))


def exec_relations(blocks: DataFrame) -> DataFrame:
    """Relations of EXEC blocks (doc, n, source, kind of block as `of`, body)."""
    upper = F.upper("body")
    blocks = blocks.withColumn("verb", F.regexp_extract(upper, r"^\s*(\S*)", 1))
    cics = blocks.where("of = 'CICS'").withColumns({"store": F.coalesce(_option("FILE"), _option("DATASET")), "queue": F.coalesce(_option("QUEUE"), _option("QNAME")), "program": _option("PROGRAM"), "map": _option("MAP"), "transid": _option("TRANSID"), "mapset": _option("MAPSET")})
    verb = F.concat(F.lit("CICS "), "verb")
    is_in = lambda *verbs: F.col("verb").isin(*verbs)
    to = lambda prefix, column: F.concat(F.lit(f"{prefix}:"), column)
    vsam = attrs(verb=verb, store_type=F.lit("VSAM"))
    sql = blocks.where("of = 'SQL'").withColumn("written", F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(rf"(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+({SQLNAME}(?:\.{SQLNAME})?)"), F.lit(1)), F.upper)))
    read = F.array_except(F.transform(F.regexp_extract_all("body", F.lit(rf"(?i)\b(?:FROM|JOIN)\s+({SQLNAME}(?:\.{SQLNAME})?)"), F.lit(1)), F.upper), "written")
    sql_verb = attrs(verb=F.concat(F.lit("SQL "), "verb"))
    found = [
        relation(cics.where(is_in("LINK", "XCTL", "LOAD") & F.col("program").isNotNull()), "calls", "source", to("program", "program"), attrs(verb=verb)),
        relation(cics.where(is_in("SEND", "RECEIVE") & F.col("map").isNotNull()), F.when(is_in("SEND"), "displays").otherwise("reads"), "source", to("screen", "map"), attrs(verb=F.concat(verb, F.lit(" MAP")), mapset=F.col("mapset"))),
        relation(cics.where(is_in("READ", "READNEXT", "READPREV", "STARTBR") & F.col("store").isNotNull()), "reads", "source", to("data_store", "store"), vsam),
        relation(cics.where(is_in("WRITE", "REWRITE", "DELETE") & F.col("store").isNotNull()), "writes", "source", to("data_store", "store"), vsam),
        relation(cics.where(is_in("READQ", "WRITEQ", "DELETEQ") & F.col("queue").isNotNull()), F.when(is_in("READQ"), "reads").otherwise("writes"), "source", to("data_store", "queue"), attrs(verb=verb, store_type=F.lit("queue"))),
        relation(cics.where(is_in("RETURN", "START") & F.col("transid").isNotNull()), "invokes_transaction", "source", to("transaction", "transid"), attrs(verb=verb)),
        relation(sql.withColumn("t", F.explode(read)), "reads", "source", to("table", "t"), sql_verb),
        relation(sql.withColumn("t", F.explode("written")), "writes", "source", to("table", "t"), sql_verb),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc, n, code, source, header, more) to (rows without what EXEC blocks hold, blocks, closed or of one row, all rows), of one staged table.

    A block goes on to END-EXEC, unless a header or another EXEC comes first; then its first row alone is the block.
    """
    order = W.partitionBy("doc").orderBy("n")
    columns = rows.columns
    starts = _has(F.col("code"), "EXEC") & F.col("code").rlike(EXEC) & ~F.col("header")
    rows = rows.withColumn("starts", starts).withColumn("block", F.sum((starts | F.col("header")).cast("int")).over(order))
    tail = F.when(F.col("starts"), F.regexp_extract("code", EXEC + r"(.*)$", 2)).otherwise(F.col("code"))
    whole = W.partitionBy("doc", "block")
    rows = rows.withColumn("end_n", F.min(F.when(_has(tail, "END-EXEC") & tail.rlike(END_EXEC), F.col("n"))).over(whole)).withColumn("of", F.max(F.when(F.col("starts"), F.upper(F.regexp_extract("code", EXEC, 1)))).over(whole))
    inside = F.col("of").isNotNull() & (F.col("starts") | F.coalesce(F.col("n") <= F.col("end_n"), F.lit(False)))
    rows = stage(rows.withColumn("inside", inside), "blocks", "doc")
    pieces = F.array_sort(F.collect_list(F.struct("n", F.regexp_replace(tail, END_EXEC + ".*$", "").alias("p"))))
    blocks = rows.where("inside").groupBy("doc", "block", "of", "source").agg(F.min("n").alias("n"), F.max("end_n").alias("end_n"), F.trim(F.regexp_replace(F.array_join(F.transform(pieces, lambda x: x["p"]), " "), r"\s+", " ")).alias("body"))
    left = rows.where("NOT inside OR starts").withColumn("code", F.when(F.col("starts"), F.regexp_extract("code", r"(?i)^(.*?)\bEXEC\s+(?:CICS|SQL|DLI)\b", 1)).otherwise(F.col("code")))
    return left.select(*columns), blocks, rows


def _opened(rows: DataFrame, files: DataFrame) -> DataFrame:
    """OPEN statements: each file with the mode stated last before it, over the rows of the statement."""
    order = W.partitionBy("doc").orderBy("n")
    opens = _has(F.col("code"), "OPEN") & F.col("code").rlike(r"(?i)(?<![\w-])OPEN\b")
    goes_on = F.col("code").rlike(rf"(?i)^(?:{NAME})\b") & ~F.col("code").rlike(rf"(?i)^(?:{'|'.join(VERBS)})\b")
    breaks = opens | ~goes_on | F.coalesce(F.lag("code").over(order).rlike(r"\.$"), F.lit(True)) | F.col("header")
    rows = rows.withColumn("opens", opens).withColumn("statement", F.sum(breaks.cast("int")).over(order))
    first = F.first("opens").over(W.partitionBy("doc", "statement").orderBy("n"))
    rows = rows.withColumn("of_open", first).where("of_open")
    said = F.when(F.col("opens"), F.regexp_extract("code", r"(?i)(?<![\w-])OPEN\b(.*)$", 1)).otherwise(F.col("code"))
    words = rows.select("doc", "n", "source", "statement", F.posexplode(F.split(F.trim(said), r"\s+")).alias("at", "word")).withColumn("word", F.regexp_replace(F.upper("word"), r"\.$", ""))
    words = carried_down(words, ["doc", "statement"], ["n", "at"], F.when(F.col("word").isin("INPUT", "OUTPUT", "I-O", "EXTEND"), F.col("word")), "mode")
    met = words.where("mode IS NOT NULL").join(files.select("doc", F.col("file").alias("word")), ["doc", "word"])
    kinds = F.when(F.col("mode") == "INPUT", F.array(F.lit("reads"))).when(F.col("mode") == "I-O", F.array(F.lit("reads"), F.lit("writes"))).otherwise(F.array(F.lit("writes")))
    return relation(met.withColumn("k", F.explode(kinds)), F.col("k"), "source", F.concat(F.lit("data_store:"), "word"), attrs(verb=F.lit("OPEN"), mode=F.col("mode")))


def cobol(docs: DataFrame, key: str = "doc_id", name: str = "name", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of COBOL programs."""
    lines = stage(_placed(logical_lines(docs, key, name, text)), "cobol", "doc")
    none = attrs(none=F.lit(""))
    programs = lines.groupBy("doc", "program").agg(F.min("first_n").alias("n"), F.max("end_n").alias("last_n"))
    ahead = lines.where("proc_n IS NULL OR n < proc_n")
    code = F.col("code")
    # files, the records of their descriptions, copybooks
    heads = code.rlike(SELECT_START) | code.rlike(FILE_DESCRIPTION) | code.rlike(DIVISION) | code.rlike(SECTION)
    order = W.partitionBy("doc").orderBy("n")
    numbered = ahead.withColumn("statement", F.sum((heads | F.coalesce(F.lag("code").over(order).rlike(r"\.$"), F.lit(True))).cast("int")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("n", "code")))
    said = numbered.groupBy("doc", "statement").agg(F.min("n").alias("n"), F.array_join(F.transform(pieces, lambda p: p["code"]), " ").alias("said")).where(F.col("said").rlike(SELECT))
    files = stage(said.select("doc", "n", F.upper(F.regexp_extract("said", SELECT, 1)).alias("file"), F.regexp_replace(F.upper(F.regexp_extract("said", SELECT, 2)), r"\.+$", "").alias("assign")), "files", "doc")
    described = F.when(code.rlike(FILE_DESCRIPTION), F.upper(F.regexp_extract("code", FILE_DESCRIPTION, 2))).when(code.rlike(r"(?i)^(WORKING-STORAGE|LOCAL-STORAGE|LINKAGE)\s+SECTION"), "")
    ahead = carried_down(ahead, ["doc"], ["n"], described, "fd").withColumn("fd", F.nullif("fd", F.lit("")))
    records = ahead.where(F.col("fd").isNotNull() & code.rlike(rf"(?i)^01\s+{NAME}") & ~code.rlike(FILE_DESCRIPTION)).select("doc", F.upper(F.regexp_extract("code", LEVEL, 2)).alias("record"), "fd", "n")
    records = records.groupBy("doc", "record").agg(F.max_by("fd", "n").alias("fd")).unionByName(files.select("doc", F.col("file").alias("record"), F.col("file").alias("fd"))).groupBy("doc", "record").agg(F.min("fd").alias("fd"))
    copies = ahead.where(_has(code, "COPY") & ~code.rlike(FILE_DESCRIPTION)).withColumn("c", F.explode(F.regexp_extract_all("code", F.lit(rf"(?i)\bCOPY\s+['\"]?({NAME})['\"]?"), F.lit(1))))
    includes = relation(copies, "includes", "program", F.concat(F.lit("copybook:"), F.upper("c")), attrs(section=F.concat(F.lit("FD "), "fd")))
    items = fields(ahead.where("n >= data_n").select("doc", "n", "code", F.col("program").alias("owner")))
    # sections and paragraphs
    body = lines.where("n > proc_n")
    title = F.when(F.col("area_a") & code.rlike(SECTION), F.upper(F.regexp_extract("code", SECTION, 1))).when(F.col("area_a") & code.rlike(PARAGRAPH) & ~F.upper(F.regexp_extract("code", PARAGRAPH, 1)).isin(*NOT_PARAGRAPHS), F.upper(F.regexp_extract("code", PARAGRAPH, 1)))
    body = body.withColumn("title", title).withColumn("header", F.col("title").isNotNull())
    section = F.when(F.col("header") & code.rlike(SECTION), F.col("title"))
    body = carried_down(carried_down(body, ["doc"], ["n"], F.col("title"), "current"), ["doc"], ["n"], section, "section")
    body = body.select("doc", "program", "n", "code", "title", "header", "section", F.col("end_n").alias("text_n"), section.isNotNull().alias("is_section"), F.coalesce("current", "program").alias("source"), F.lag("n").over(order).alias("before_n"))
    rows, blocks, body = _blocks(body)
    later = W.partitionBy("doc").orderBy("n").rowsBetween(1, W.unboundedFollowing)
    titled = body.where("header")
    next_any, next_section = F.lead("before_n").over(order), F.first(F.when(F.col("is_section"), F.col("before_n")), ignorenulls=True).over(later)
    parts = titled.select("doc", F.when(F.col("is_section"), "section").otherwise("paragraph").alias("kind"), F.col("title").alias("name"), F.when(F.col("is_section"), F.col("program")).otherwise(F.coalesce("section", "program")).alias("parent"), "n", F.coalesce(F.when(F.col("is_section"), next_section).otherwise(next_any), "text_n").alias("last_n"), none.alias("attrs"))
    # statements
    rows = rows.where(~F.col("header")).select("doc", "program", "n", "code", "source", "header")
    perform = rows.where(_has(code, "PERFORM")).withColumn("m", F.explode(_all(F.col("code"), rf"(?i)\bPERFORM\s+({NAME})(?:\s+(?:THRU|THROUGH)\s+({NAME}))?(?:\s+(\S+))?", 1, 2, 3)))
    perform = perform.withColumn("to", F.upper("m.g0")).where(~F.col("to").isin(*NOT_PERFORMED) & ~F.col("to").rlike(r"^\d+$") & ~F.startswith(F.upper("m.g2"), F.lit("TIMES")))
    names = parts.select("doc", F.col("name").alias("to"), F.lit(True).alias("own")).distinct()
    perform = perform.join(names, ["doc", "to"], "left").where(F.col("own") | F.col("to").rlike(r"[0-9-]"))
    target = F.when(F.col("own"), F.col("to")).otherwise(F.concat(F.lit("paragraph:"), "program", F.lit("."), "to"))
    performs = relation(perform, "calls", "source", target, attrs(verb=F.lit("PERFORM"), thru=F.upper("m.g1")))
    called = rows.where(_has(code, "CALL")).withColumn("m", F.explode(_all(F.col("code"), rf"(?i)\bCALL\s+(?:'({NAME})'|\"({NAME})\"|({NAME}))", 1, 2, 3))).withColumns({"literal": F.upper(F.concat("m.g0", "m.g1")), "var": F.upper("m.g2")})
    literal = relation(called.where("literal <> ''"), "calls", "source", F.concat(F.lit("program:"), "literal"), attrs(verb=F.lit("CALL")))
    moved = rows.where(_has(code, "MOVE")).withColumn("m", F.explode(_all(F.col("code"), rf"(?i)\bMOVE\s+['\"]({NAME})['\"]\s+TO\s+({NAME})", 1, 2))).groupBy("doc", F.upper("m.g1").alias("var"), F.upper("m.g0").alias("value")).agg(F.min("n").alias("moved_n"))
    by_name = called.where("literal = ''").join(moved, ["doc", "var"], "left").withColumn("known", F.coalesce(F.col("moved_n") <= F.col("n"), F.lit(False)))
    dynamic = relation(by_name.where("known"), "calls", "source", F.concat(F.lit("program:"), "value"), attrs(verb=F.lit("CALL"), dynamic=F.col("var")))
    unknown = by_name.groupBy("doc", "n", "var").agg(F.bool_or("known").alias("known")).where("NOT known").groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("var")), ",").alias("dynamic_calls"))
    verb_of = lambda word, pattern: rows.where(_has(code, word)).withColumn("m", F.explode(_all(F.col("code"), pattern, 1, 2))).withColumn("record", F.upper("m.g1"))
    reads = verb_of("READ", rf"(?i)\b(READ)\s+({NAME})").join(files.select("doc", F.col("file").alias("record")).distinct(), ["doc", "record"])
    deletes = verb_of("DELETE", rf"(?i)\b(DELETE)\s+({NAME})").join(files.select("doc", F.col("file").alias("record")).distinct(), ["doc", "record"])
    writes = verb_of("WRITE", rf"(?i)\b(WRITE|REWRITE)\s+({NAME})").join(records, ["doc", "record"])
    store = lambda column: F.concat(F.lit("data_store:"), column)
    # EXEC SQL ahead of the procedure
    early = _blocks(ahead.select("doc", "n", "code", F.col("program").alias("source"), F.lit(False).alias("header")))[1].where("of = 'SQL'")
    included = F.upper(F.regexp_extract("body", rf"(?i)^\s*INCLUDE\s+({NAME})\s*$", 1))
    sql_includes = relation(early.where((included != "") & ~included.isin("SQLCA", "SQLDA")), "includes", "source", F.concat(F.lit("copybook:"), included), attrs(verb=F.lit("SQL INCLUDE")))
    relations = [
        includes, performs, literal, dynamic, _opened(rows, files), exec_relations(blocks), sql_includes, exec_relations(early.where(included == "")),
        relation(reads, "reads", "source", store("record"), attrs(verb=F.lit("READ"))), relation(deletes, "writes", "source", store("record"), attrs(verb=F.lit("DELETE"))),
        relation(writes, "writes", "source", store("fd"), attrs(verb=F.upper("m.g0"), record=F.when(F.col("record") != F.col("fd"), F.col("record")))),
    ]
    open_blocks = blocks.where("end_n IS NULL").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_set("n")), lambda n: n.cast("string")), ",").alias("open_blocks"))
    program = programs.join(unknown, "doc", "left").join(open_blocks, "doc", "left").select("doc", F.lit("program").alias("kind"), F.col("program").alias("name"), F.lit(None).cast("string").alias("parent"), "n", "last_n", attrs(language=F.lit("COBOL"), dynamic_calls=F.col("dynamic_calls"), open_blocks=F.col("open_blocks")).alias("attrs"))
    stores = files.select("doc", F.lit("data_store").alias("kind"), F.col("file").alias("name"), F.lit(None).cast("string").alias("parent"), "n", F.col("n").alias("last_n"), attrs(assign=F.col("assign"), store_type=F.lit("file")).alias("attrs"))
    return united([program, stores, items, parts]).select(*ENTITY), first_of(united(relations))


def performed(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc, source, paragraph, n): every paragraph that a PERFORM runs: the one it names and, with THRU, those up to the other one."""
    asked = relations.where("kind = 'calls' AND attrs['verb'] = 'PERFORM' AND NOT startswith(target, 'paragraph:')").select("doc", "source", "n", F.col("target").alias("first"), F.coalesce(F.col("attrs")["thru"], "target").alias("last"))
    titles = entities.where("kind IN ('paragraph', 'section')").select("doc", "name", F.col("n").alias("at"), "last_n")
    low = titles.groupBy("doc", F.col("name").alias("first")).agg(F.min("at").alias("low"))
    high = titles.groupBy("doc", F.col("name").alias("last")).agg(F.min_by("last_n", "at").alias("high"))
    return asked.join(low, ["doc", "first"]).join(high, ["doc", "last"]).join(titles, "doc").where("at BETWEEN low AND high").select("doc", "source", F.col("name").alias("paragraph"), "n").distinct()


def copybooks(docs: DataFrame, key: str = "doc_id", name: str = "name", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of copybooks; each is named by its file."""
    lines = stage(logical_lines(docs, key, name, text).withColumn("owner", F.coalesce(F.nullif("stem", F.lit("")), F.lit("COPYBOOK"))), "copybooks")
    own = lines.groupBy("doc", "owner").agg(F.min("n").alias("n"), F.max("n").alias("last_n")).select("doc", F.lit("copybook").alias("kind"), F.col("owner").alias("name"), F.lit(None).cast("string").alias("parent"), "n", "last_n", attrs(none=F.lit("")).alias("attrs"))
    copies = lines.withColumn("c", F.explode(F.regexp_extract_all("code", F.lit(rf"(?i)\bCOPY\s+['\"]?({NAME})['\"]?"), F.lit(1))))
    return own.unionByName(fields(lines.select("doc", "n", "code", "owner"))).select(*ENTITY), first_of(relation(copies, "includes", "owner", F.concat(F.lit("copybook:"), F.upper("c"))))


def included_fields(relations: DataFrame, copy_entities: DataFrame, copy_relations: DataFrame) -> DataFrame:
    """(doc, program, copybook, field): the data items that come into a program by COPY, through copybooks that copy others as well.

    Rounds of joins on the copybook's name, until no program meets a new one; a cycle ends them too.
    """
    book = lambda r: F.regexp_extract(r, r"^copybook:(.*)$", 1)
    inner = stage(copy_relations.where("kind = 'includes'").select(F.col("source").alias("copybook"), book("target").alias("next")).distinct(), "copies")
    known = delta = stage(relations.where("kind = 'includes'").select("doc", F.col("source").alias("program"), book("target").alias("copybook")).distinct(), "included")
    while True:
        more = delta.join(inner, "copybook").select("doc", "program", F.col("next").alias("copybook")).distinct()
        delta = stage(more.join(known, ["doc", "program", "copybook"], "left_anti"), "included")
        if delta.isEmpty():
            break
        known = stage(known.unionByName(delta), "included")
    books = copy_entities.where("kind = 'copybook'").select(F.col("doc").alias("book_doc"), F.col("name").alias("copybook"))
    items = copy_entities.where("kind = 'field'").select(F.col("doc").alias("book_doc"), F.col("name").alias("field"))
    return known.join(books, "copybook").join(items, "book_doc").select("doc", "program", "copybook", "field").distinct()


def bms(docs: DataFrame, key: str = "doc_id", name: str = "name", text: str = "text") -> DataFrame:
    """Entities of map sets: screens and their elements. A sign in column 72 says that a macro goes on in the next row."""
    rows = _read(docs, key, name, text).where((F.trim("line") != "") & ~F.startswith("line", F.lit("*")))
    more = (F.length("line") > 71) & (F.substring("line", 72, 1) != " ")
    order = W.partitionBy("doc").orderBy("n")
    piece = F.rtrim(F.substring("line", 1, 71))
    cut = rows.withColumn("goes_on", F.coalesce(F.lag(more).over(order), F.lit(False))).select("doc", "stem", "n", F.when(F.col("goes_on"), F.trim(piece)).otherwise(piece).alias("piece"), more.alias("more"))
    said = folded(cut, ["doc", "stem"], "n", "piece", F.col("more"), "")
    macro = r"(?i)^([A-Z0-9#@$]{1,8})?\s+(DFHMSD|DFHMDI|DFHMDF)\b(.*)$"
    said = said.where(F.col("text").rlike(macro)).select("doc", "stem", F.col("first").alias("n"), F.col("last").alias("last_n"), F.upper(F.regexp_extract("text", macro, 1)).alias("label"), F.upper(F.regexp_extract("text", macro, 2)).alias("macro"), F.regexp_extract("text", macro, 3).alias("ops"))
    opens = (F.col("macro") == "DFHMSD") & ~F.contains(F.upper("ops"), F.lit("TYPE=FINAL"))
    said = carried_down(said, ["doc"], ["n"], F.when((F.col("macro") == "DFHMDI") & (F.col("label") != ""), F.col("label")), "screen")
    said = said.withColumn("mapset", F.max(F.when(opens, F.struct("n", F.coalesce(F.nullif("label", F.lit("")), "stem").alias("name")))).over(W.partitionBy("doc"))["name"])
    get = lambda pattern, group=1: F.nullif(F.regexp_extract("ops", pattern, group), F.lit(""))
    size = F.concat_ws("x", get(r"(?i)SIZE=\((\d+),(\d+)\)"), get(r"(?i)SIZE=\((\d+),(\d+)\)", 2))
    screens = said.where("macro = 'DFHMDI' AND label <> ''").select("doc", F.lit("screen").alias("kind"), F.col("label").alias("name"), F.lit(None).cast("string").alias("parent"), "n", "last_n", attrs(map_name=F.col("label"), mapset=F.col("mapset"), size=size).alias("attrs"))
    place = F.nullif(F.concat_ws(",", get(r"(?i)POS=\((\d+),(\d+)\)"), get(r"(?i)POS=\((\d+),(\d+)\)", 2)), F.lit(""))
    attributes = F.upper(get(r"(?i)ATTRB=\(?([A-Z,]+)\)?"))
    initial = F.when(F.col("ops").rlike(r"(?i)INITIAL='"), F.regexp_extract("ops", r"(?i)INITIAL='([^']*)'", 1))
    named = F.coalesce(F.nullif("label", F.lit("")), F.when(place.isNotNull() & initial.isNotNull(), F.concat(F.lit("LABEL@"), place)))
    told = attrs(pos=place, length=get(r"(?i)LENGTH=(\d+)"), attributes=attributes, text=initial, input=F.array_contains(F.split(F.coalesce(attributes, F.lit("")), ","), "UNPROT"))
    elements = said.where("macro = 'DFHMDF' AND screen IS NOT NULL").select("doc", F.lit("ui_element").alias("kind"), named.alias("name"), F.col("screen").alias("parent"), "n", "last_n", told.alias("attrs")).where("name IS NOT NULL")
    return screens.unionByName(elements).select(*ENTITY)


def jcl(docs: DataFrame, key: str = "doc_id", name: str = "name", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of jobs: programs and procedures that steps run, data sets that they read and write."""
    card = r"(?i)^//([A-Z0-9#@$]*)\s+(JOB|EXEC|DD)\b\s*(.*)$"
    operand = lambda c: F.regexp_extract(F.trim(c), r"^((?:[^ ']++|'[^']*+'?)*+)", 1)
    rows = _read(docs, key, name, text)
    last_card = rows.groupBy("doc", "stem").agg(F.max(F.when(F.col("line").rlike("^//(?!\\*)"), F.col("n"))).alias("last_n"))
    rows = rows.where(F.startswith("line", F.lit("//")) & ~F.startswith("line", F.lit("//*"))).withColumn("line", F.substring("line", 1, 72))
    begins = F.col("line").rlike(card)
    piece = F.when(begins, operand(F.regexp_extract("line", card, 3))).otherwise(operand(F.substring("line", 3, 70)))
    order = W.partitionBy("doc").orderBy("n")
    rows = rows.withColumn("begins", begins).withColumn("piece", piece).withColumn("card", F.sum(begins.cast("int")).over(order)).where("card > 0")
    before = W.partitionBy("doc", "card").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.coalesce(F.min(F.endswith("piece", F.lit(",")).cast("int")).over(before), F.lit(1))).where("open = 1")
    pieces = F.array_sort(F.collect_list(F.struct("n", "piece", "line")))
    cards = rows.groupBy("doc", "stem", "card").agg(pieces.alias("p"))
    cards = cards.select("doc", "stem", F.get("p", 0)["n"].alias("n"), F.upper(F.regexp_extract(F.get("p", 0)["line"], card, 1)).alias("label"), F.upper(F.regexp_extract(F.get("p", 0)["line"], card, 2)).alias("op"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))
    cards = cards.withColumn("program", F.upper(F.regexp_extract("text", r"(?i)\bPGM=([A-Z0-9#@$]+)", 1))).withColumn("proc", F.when(F.col("program") == "", F.upper(F.regexp_extract("text", r"(?i)^(?:PROC=)?([A-Z0-9#@$]+)(?:,|$)", 1))))
    carried = lambda df, when, value, column: carried_down(df, ["doc"], ["n"], F.when(F.col("op") == when, value), column)
    cards = carried(cards, "JOB", F.nullif("label", F.lit("")), "job")
    cards = carried(carried(cards, "EXEC", F.col("label"), "step"), "EXEC", F.col("program"), "runs")
    cards = cards.withColumn("job", F.coalesce("job", F.nullif("stem", F.lit("")), F.lit("JOB")))
    step = F.nullif("step", F.lit(""))
    # a card is a step or a data set: both are told of in one pass over the cards
    runs, uses = F.col("op") == "EXEC", F.col("op") == "DD"
    dsn = F.when(uses, F.upper(F.regexp_extract("text", r"(?i)\bDSN(?:AME)?=([A-Z0-9#@$.()&+-]+?)(?:,|$)", 1)))
    mode = F.when(F.col("text").rlike(r"(?i)\bDISP="), F.coalesce(F.nullif(F.upper(F.regexp_extract("text", r"(?i)\bDISP=\(?([A-Z]*)", 1)), F.lit("")), F.lit("NEW"))).otherwise("SHR")
    told = cards.where(runs | uses).withColumns({"dsn": dsn, "mode": F.when(uses, mode)}).where((runs & ((F.col("program") != "") | (F.col("proc") != ""))) | (F.col("dsn") != ""))
    kind = F.when(runs, "calls").when(F.col("mode").isin("SHR", "OLD"), "reads").otherwise("writes")
    target = F.when(uses, F.concat(F.lit("data_store:"), "dsn")).when(F.col("program") != "", F.concat(F.lit("program:"), "program")).otherwise(F.concat(F.lit("job:"), "proc"))
    about = attrs(step=step, proc=F.when(runs & (F.col("program") == ""), F.lit("true")), program=F.when(uses, F.col("runs")), ddname=F.when(uses, F.col("label")), disp=F.col("mode"), store_type=F.when(uses, F.lit("dataset")))
    found = relation(told, kind, "job", target, about)
    stated = cards.where("op = 'JOB'").select("doc", "job", "n")
    jobs = last_card.join(stated, "doc", "left").select("doc", F.lit("job").alias("kind"), F.coalesce("job", F.nullif("stem", F.lit("")), F.lit("JOB")).alias("name"), F.lit(None).cast("string").alias("parent"), F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("last_n", "n", F.lit(1)).alias("last_n"), attrs(none=F.lit("")).alias("attrs"))
    return jobs.select(*ENTITY), first_of(found)
