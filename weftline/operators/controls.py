"""Business controls and the risk register (R21): what the evidence of a program says of each control, and the risks that follow.

Evidence comes as tables, one row a piece: routines (program, kind, name, origin), findings (program, rule,
file), occurrences of data (program, component, business, engine, platform, store, access with R and W),
files (program, file, text). Each control is a few aggregates over them and one rule with three outcomes: `met`,
`not met`, and `open` where the evidence neither shows nor refutes it. A control that the code refutes has a
rating from 1 to 5, the higher the worse, and the components that show it. Risks are rows of a table of
conditions over the controls and over facts of the program.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How approvals, audit trails and rates are known, and the data whose copies must agree.
APPROVAL = r"(?i)APPROV|AUTHORI[SZ]E|RELEASE"
CALLABLE = ("api_endpoint", "method", "function", "procedure", "paragraph")
AUDIT = r"(?i)AuditTrail|audit_pkg|AIDAUDIT|AUDIT\.LOG|AuditLog|INSERT\s+INTO\s+\w*AUDIT\w*|WRITE\s+FILE\s*\(\s*\w*AUDIT\w*\s*\)|DSN\s*=\s*[\w.]*AUDIT[\w.]*"
LOCAL_ENGINE = "Windows desktop (local file)"
RECONCILED = ("Payment", "District", "Account", "Invoice", "Ledger", "Transaction")
MULTIPLIER, RATE_ITEM, PERIOD_ITEM = r"\*\s*(\d{3,}(?:\.\d+)?)\b", r"(?i)\b([\w-]*(?:PCT|RATE|PERCENT)[\w-]*)\s+PIC\s+\S+\s+VALUE\s+([\d.]+)", r"(?i)\b([\w-]*(?:PERIOD|YEAR|YYMM|CCYY|DATE)[\w-]*)\s+PIC\s+\S+\s+VALUE\s+(\d{4,8})\b"
COMMENT = r"^\s*(?:\*|//\*|--|/\*)|^.{6}[*/]"
TEST_FILE = r"(?i)(?:^|[/\\_.-])tests?(?:[/\\_.-]|$)"
CONTROLS = (
    "Maker-checker approval", "Audit trail integrity", "Error handling in posting", "Reconciliation between stores",
    "Control totals on file exchanges", "Automated tests on calculations", "Rate and parameter changes",
)
CATEGORIES = ("Financial control", "Data integrity", "Security", "Delivery", "Technology", "People", "Assessment", "Architecture")
# Control, title of the risk, category, likelihood, impact where the program moves money, impact where not.
CONTROL_RISKS = (
    ("Maker-checker approval", "Payments can be approved without an authorized second person", "Financial control", 4, 5, 4),
    ("Error handling in posting", "Unchecked posting errors could leave incomplete or duplicate updates", "Financial control", 3, 5, 4),
    ("Audit trail integrity", "The audit trail can be altered or lost", "Financial control", 3, 5, 3),
    ("Automated tests on calculations", "Calculation changes need verified regression coverage", "Delivery", 3, 5, 4),
)


def _names(values: Column) -> Column:
    return F.array_sort(F.array_compact(F.collect_set(values)))


def literal_rates(files: DataFrame) -> DataFrame:
    """(program, file, rate): multipliers of three digits or more, and rates, percentages and periods with a value in their declaration, outside comments."""
    lines = files.select("program", "file", F.explode(F.split("text", "\n")).alias("line")).where(~F.col("line").rlike(COMMENT) & ~F.contains("line", F.lit("[CUT OFF]")))
    named = lambda pattern: F.zip_with(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), F.regexp_extract_all("line", F.lit(pattern), F.lit(2)), lambda a, b: F.concat(a, F.lit(" = "), F.regexp_replace(b, r"\.$", "")))
    rates = F.concat(F.transform(F.regexp_extract_all("line", F.lit(MULTIPLIER), F.lit(1)), lambda x: F.concat(F.lit("multiplier "), x)), named(RATE_ITEM), named(PERIOD_ITEM))
    return lines.select("program", "file", F.explode(rates).alias("rate")).distinct()


def assessed(programs: DataFrame, routines: DataFrame, findings: DataFrame, occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """(program, control, state, rating, components): every control of every program of the table (program, money); programs that move no money have none."""
    base = programs.where("money").select("program")
    writes = F.contains("access", F.lit("W"))
    asked = routines.where(F.col("kind").isin(*CALLABLE) & F.col("name").rlike(APPROVAL) & (F.col("origin") != "placeholder")).groupBy("program").agg(F.count("*").alias("approvals"))
    rules = findings.groupBy("program").agg(_names(F.when(F.col("rule") == "SEC-AUTHZ", F.col("file"))).alias("unguarded"), _names(F.when(F.col("rule") == "SEC-ERR", F.col("file"))).alias("swallowing"))
    local = writes & (F.col("engine") == LOCAL_ENGINE) & F.col("store").rlike("(?i)AUDIT|LOG")
    exchanged = writes & (F.col("business") == "Payment") & F.endswith("engine", F.lit("(files)"))
    data = occurrences.groupBy("program").agg(_names(F.when(local, F.col("component"))).alias("local_audit"), _names(F.when(exchanged, F.col("component"))).alias("exchanges"), _names(F.when(writes & (F.col("business") == "Payment"), F.col("component"))).alias("payers"))
    copies = occurrences.where(F.col("business").isin(*RECONCILED)).groupBy("program", "business").agg(F.count_distinct("store").alias("copies"), _names(F.col("component")).alias("holders")).where("copies >= 2")
    copies = copies.groupBy("program").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("holders")))).alias("diverging"))
    read = files.groupBy("program").agg(_names(F.when(F.col("text").rlike(AUDIT), F.col("file"))).alias("auditing"), F.count_if(F.col("file").rlike(TEST_FILE)).alias("tests"))
    rates = literal_rates(files).groupBy("program").agg(_names(F.col("file")).alias("rated"))
    every = reduce(lambda a, b: a.join(b, "program", "left"), [asked, rules, data, copies, read, rates], base)
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none)
    some = lambda c: F.size(listed(c)) > 0
    posting = F.when(F.size(F.array_intersect(listed("swallowing"), listed("payers"))) > 0, F.array_intersect(listed("swallowing"), listed("payers"))).otherwise(listed("swallowing"))
    verdict = lambda control, state, rating, components: F.struct(F.lit(control).alias("control"), state.alias("state"), rating.cast("int").alias("rating"), components.alias("components"))
    approvals = F.coalesce("approvals", F.lit(0)) > 0
    outcome = F.array(
        verdict(CONTROLS[0], F.when(approvals, "not met").otherwise("open"), F.when(approvals, F.when(some("unguarded"), 5).otherwise(4)), F.when(approvals, listed("unguarded")).otherwise(none)),
        verdict(CONTROLS[1], F.when(some("local_audit"), "not met").when(some("auditing"), "met").otherwise("open"), F.when(some("local_audit"), 4), F.when(some("local_audit"), listed("local_audit")).otherwise(listed("auditing"))),
        verdict(CONTROLS[2], F.when(some("swallowing"), "not met").otherwise("open"), F.when(some("swallowing"), 4), posting),
        verdict(CONTROLS[3], F.when(some("diverging"), "not met").otherwise("open"), F.when(some("diverging"), 4), listed("diverging")),
        F.when(some("exchanges"), verdict(CONTROLS[4], F.lit("open"), F.lit(None), listed("exchanges"))),
        verdict(CONTROLS[5], F.when(F.coalesce("tests", F.lit(0)) > 0, "met").otherwise("not met"), F.when(F.coalesce("tests", F.lit(0)) > 0, 2).otherwise(4), none),
        F.when(some("rated"), verdict(CONTROLS[6], F.lit("not met"), F.lit(3), listed("rated"))),
    )
    return every.select("program", F.explode(F.array_compact(outcome)).alias("c")).select("program", "c.*")


def register(programs: DataFrame, controls: DataFrame, facts: DataFrame) -> DataFrame:
    """(program, place, title, category, likelihood, impact, score, band, components): the risks of each program, gravest first.

    programs: program, money, tier1. facts: program, kind, subject, unused, of risks beside the controls: lifecycle (a product),
    copies (an entity held three times or more), injection and credentials (a component), missing (a referenced component).
    """
    known = programs.select("program", "money", "tier1")
    impact = lambda high, low: F.when(F.col("money"), F.when(F.col("tier1"), high).otherwise(F.least(F.lit(4), F.lit(high)))).otherwise(low)
    risk = lambda title, category, likelihood, impact, components: F.struct(title.alias("title"), F.lit(category).alias("category"), likelihood.cast("int").alias("likelihood"), impact.cast("int").alias("impact"), components.alias("components"))
    failed = controls.where((F.col("rating") >= 4) | ((F.col("control") == "Error handling in posting") & F.col("rating").isNotNull())).join(known, "program")
    of_control = F.array_compact(F.array(*[F.when(F.col("control") == control, risk(F.lit(title), category, F.lit(likelihood), impact(high, low), F.col("components"))) for control, title, category, likelihood, high, low in CONTROL_RISKS]))
    first = failed.select("program", F.explode(of_control).alias("r"))
    grouped = facts.groupBy("program", "kind").agg(_names(F.col("subject")).alias("subjects"), F.count_distinct("subject").alias("k")).join(known, "program")
    kind = F.col("kind")
    several = F.array_compact(
        F.array(
            F.when(kind == "copies", risk(F.concat(F.get("subjects", 0), F.lit(" data could drift apart between its copies")), "Data integrity", F.lit(4), impact(5, 4), F.col("subjects"))),
            F.when(kind == "credentials", risk(F.lit("Passwords or keys in the source could be misused"), "Security", F.lit(3), impact(5, 4), F.col("subjects"))),
            F.when(kind == "injection", risk(F.lit("Crafted input could change or expose data (injection)"), "Security", F.lit(3), impact(5, 4), F.col("subjects"))),
            F.when(kind == "missing", risk(F.concat(F.lit("Unreviewed code ("), F.col("k").cast("string"), F.lit(" referenced components not provided) could change the assessment")), "Assessment", F.lit(4), F.lit(3), F.lit(None).cast("array<string>"))),
        )
    )
    second = grouped.select("program", F.explode(several).alias("r"))
    products = facts.where("kind = 'lifecycle'").groupBy("program", "subject").agg(F.bool_and(F.coalesce("unused", F.lit(False))).alias("unused"))
    third = products.select("program", risk(F.concat("subject", F.lit(" needs a support and upgrade decision")), "Technology", F.when(F.col("unused"), 2).otherwise(4), F.lit(4), F.array("subject")).alias("r"))
    rows = first.unionByName(second).unionByName(third).select("program", "r.*").withColumn("score", F.col("likelihood") * F.col("impact"))
    band = F.when(F.col("score") >= 15, "High").when(F.col("score") >= 8, "Medium").otherwise("Low")
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    place = F.row_number().over(W.partitionBy("program").orderBy(F.desc("score"), rank, "title"))
    return rows.withColumn("band", band).withColumn("place", place).select("program", "place", "title", "category", "likelihood", "impact", "score", "band", F.coalesce("components", F.array().cast("array<string>")).alias("components"))
