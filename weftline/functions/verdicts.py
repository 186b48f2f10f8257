"""More decision tables (V10, V12 to V16) and text clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Criterion weights of an option, weights of the scorecard's dimensions, effort per fix in days.
OPTION_WEIGHTS = (25, 20, 15, 15, 10, 10, 5)
SCORECARD = {"Technology currency": 20, "Code quality": 15, "Stability and reliability": 15, "Performance and scalability": 10, "Security posture": 15, "Documentation and knowledge": 10, "Business fit and adaptability": 15}
FIX_EFFORT = {"SEC-SQLI": (0.2, 0.5), "SEC-SQLDYN": (0.2, 0.5), "SEC-CRED": (0.2, 0.5), "SEC-XSS": (0.1, 0.3), "SEC-CMD": (0.3, 1.0), "SEC-PATH": (0.2, 0.5), "SEC-DESER": (0.5, 2.0), "SEC-CRYPTO": (0.3, 1.0), "SEC-TLS": (0.3, 1.0), "SEC-AUTH": (0.5, 1.5), "SEC-CONF": (0.05, 0.2), "SEC-MEM": (0.05, 0.2), "SEC-PII": (0.5, 1.5)}


def file_state(status: Column, paused: Column, analysing: Column, active: Column, rescan: Column) -> Column:
    """Where a file is."""
    waiting = F.when(paused, "paused").when(analysing, "reading").otherwise("waiting")
    return F.when(status == "captured", waiting).when(status == "failed", "failed").when(active, "reviewing").when(rescan, "needs_recapture").otherwise("done")


def record_owner(copies: Column, writers: Column, platforms: Column) -> Column:
    """Whether one copy of an entity can be called the record, from counts."""
    return F.when(copies <= 1, "only copy").when((writers == 1) & (platforms == 1), "candidate").when(writers > 0, "several writers").otherwise("no writer")


def option_score(criteria: list[Column]) -> Column:
    """Weighted score of an option over the seven criteria."""
    return sum((c * w for c, w in zip(criteria, OPTION_WEIGHTS, strict=True)), F.lit(0)) / 100


def scorecard(ratings: dict[str, Column]) -> Column:
    """Mean of the rated dimensions by weight; null when none is rated."""
    total, weight = F.lit(0.0), F.lit(0)
    for name, w in SCORECARD.items():
        total = total + F.coalesce(ratings[name] * w, F.lit(0))
        weight = weight + F.when(ratings[name].isNotNull(), w).otherwise(0)
    return F.when(weight > 0, total / weight)


def finding_risk(severity: Column, always: Column, severe: Column, reachable: Column, hedged: Column) -> Column:
    """struct(likelihood, impact) of a finding from what its text says."""
    high = severity == "high"
    likelihood = F.when(high & reachable, 5).when(high | always, 4).when(hedged, 2).otherwise(3)
    return F.struct(likelihood.alias("likelihood"), F.when(high & severe, 5).when(high, 4).when((severity == "medium") | severe, 3).otherwise(2).alias("impact"))


def fix_effort(rule: Column) -> Column:
    """struct(low, high) days per finding; null for rules without a known fix."""
    table = F.create_map(*[x for rule_id, (low, high) in FIX_EFFORT.items() for x in (F.lit(rule_id), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))])
    return F.try_element_at(table, rule)


def without_keys(text: Column) -> Column:
    """F8: checker output without credentials."""
    out = F.regexp_replace(text, r"\b(sk|pk|key)-[A-Za-z0-9_-]{8,}", "[redacted]")
    return F.regexp_replace(out, r"(?i)((?:api[_-]?key|token|password|secret)\s*[=:]\s*)\S+", "$1[redacted]")


def without_frames(text: Column) -> Column:
    """fences, status bars, and line numbers where at least 60 % of the written lines carry one."""
    rows = F.filter(F.split(text, "\n"), lambda r: ~r.rlike(r"^\s*```") & ~r.rlike(r"^\s*Ln \d+, Col \d+"))

    def strip(r: Column) -> Column:
        written = F.filter(r, lambda x: F.trim(x) != "")
        numbered = F.size(F.filter(written, lambda x: x.rlike(r"^\s*\d+[ \t|]")))
        return F.when((F.size(written) > 0) & (numbered >= 0.6 * F.size(written)), F.transform(r, lambda x: F.regexp_replace(x, r"^\s*\d+[ \t|]", ""))).otherwise(r)

    return F.array_join(F.get(F.transform(F.array(rows), strip), 0), "\n")


def counted(n: Column, noun: str) -> Column:
    """a number with its noun in the right form."""
    plural = noun[:-1] + "ies" if noun.endswith("y") and noun[-2] not in "aeiou" else noun + ("es" if noun.endswith(("s", "x", "ch", "sh")) else "s")
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, noun).otherwise(plural))
