"""Decision tables (V*) and numeric and date functions: ordered rules, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the seven dimensions, points per severity, level floors.
WEIGHTS = {"health": 0.15, "tech_debt": 0.18, "security": 0.24, "supportability": 0.18, "complexity": 0.08, "coupling": 0.07, "ux": 0.1}
SECURITY_POINTS = {"critical": 25, "high": 15, "medium": 7, "low": 3, "info": 0}
LIFECYCLE_POINTS = {"eol": 35, "extended": 20, "legacy": 20, "ending": 15, "unknown": 3}
UX_POINTS = {("accessibility", "high"): 15, ("accessibility", "medium"): 6, ("accessibility", "low"): 2, ("usability", "high"): 12, ("usability", "medium"): 5, ("usability", "low"): 2}
LEVELS = ((20, "critical"), (12, "high"), (6, "medium"))
SEVERITIES = ("info", "low", "medium", "high", "critical")
# Price per million input and output units by model name prefix, and cache read rates.
CACHE_WRITE, CACHE_WRITE_LONG, CACHE_READ = 1.25, 2.0, 0.1


def grade(score: Column) -> Column:
    """V2: bands 80, 60, 40."""
    return F.when(score.isNull(), "n/a").when(score >= 80, "good").when(score >= 60, "fair").when(score >= 40, "poor").otherwise("critical")


def likelihood(security: Column, supportability: Column, health: Column, debt: Column) -> Column:
    """V3: 1 to 5 from the worst of three scores, averaged with debt where debt is clearly worse."""
    worst = F.least(security, supportability, health)
    base = F.when(worst < debt + 15, worst.cast("double")).otherwise((worst + debt) / 2)
    return F.when(base < 30, 5).when(base < 50, 4).when(base < 70, 3).when(base < 85, 2).otherwise(1)


def impact(personal: Column, writes: Column, entry: Column) -> Column:
    """V4: default impact."""
    return F.when(personal, 4).when(writes, 4).when(entry, 3).otherwise(2)


def risk_level(score: Column) -> Column:
    """V4: level bands 20, 12, 6."""
    chain = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for floor, label in LEVELS[1:]:
        chain = chain.when(score >= floor, label)
    return chain.otherwise("low")


def disposition(s: dict[str, Column]) -> Column:
    """V5: one of seven outcomes. `s` has security, supportability, health, tech_debt, retire, cots, no_path,
    no_path_share, mainframe_share, eol_share, components, high_findings."""
    debt, support, security, health = s["tech_debt"], s["supportability"], s["security"], s["health"]
    legacy = F.greatest(s["eol_share"], s["no_path_share"])
    return (
        F.when(s["retire"], "retire")
        .when(s["cots"], "replace")
        .when(s["no_path"] & ((s["no_path_share"] >= 0.5) | (debt < 45) | (health < 50)), "rearchitect")
        .when((support < 40) & (debt < 40), "rearchitect")
        .when((s["mainframe_share"] >= 0.5) & (support < 70) & (debt >= 55) & (security >= 50), "rehost")
        .when((s["eol_share"] >= 0.5) & (debt >= 45), "replatform")
        .when((support < 60) & (debt >= 45), "replatform")
        .when((legacy >= 0.2) & (s["components"] > 1) & (debt >= 45), "replatform")
        .when((security < 70) | (debt < 60) | (health < 60) | (s["high_findings"] > 0), "refactor")
        .otherwise("retain")
    )


def confidence(ratio: Column, files: Column, unconfirmed: Column, partial: Column, failed: Column) -> Column:
    """V6: level with caps; a cap only lowers."""
    rank = F.when(ratio.isNull() | (files < 5) | (ratio < 0.6), 0).when(ratio < 0.85, 1).otherwise(2)
    rank = F.when((unconfirmed > 0) & (rank == 2), 1).otherwise(rank)
    many = F.greatest(F.lit(2.0), 0.2 * F.greatest(F.lit(1), files))
    for count in (partial, failed):
        rank = F.when(count > 0, F.least(rank, F.when(count >= many, 0).otherwise(1))).otherwise(rank)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), rank + 1)


def severity_shift(severity: Column, by: Column) -> Column:
    """V7: a severity raised or lowered by levels, inside the scale."""
    scale = F.array(*[F.lit(x) for x in SEVERITIES])
    at = F.array_position(scale, severity).cast("int") + by
    return F.element_at(scale, F.greatest(F.lit(1), F.least(F.lit(len(SEVERITIES)), at)))


def placeholder_class(kind: Column, name: Column, library_prefixes: tuple[str, ...]) -> Column:
    """V8: external, library or missing."""
    library = F.lit(False)
    for prefix in library_prefixes:
        library |= F.lower(name).startswith(prefix)
    return F.when(kind.isin("external_system", "data_store", "file", "table"), "external").when(library, "library").otherwise("missing_code")


def deductions(findings: DataFrame, component: str, category: str, severity: str) -> DataFrame:
    """V1: (component, dim, rule, points, cap) of the security and interface findings; capped and summed by A12."""
    points = F.lit(0)
    for name, value in SECURITY_POINTS.items():
        points = F.when(F.col(severity) == name, value).otherwise(points)
    ux = F.lit(0)
    for (kind, name), value in UX_POINTS.items():
        ux = F.when((F.col(category) == kind) & (F.col(severity) == name), value).otherwise(ux)
    interface = F.col(category).isin("accessibility", "usability")
    return findings.select(component, F.when(interface, "ux").otherwise("security").alias("dim"), F.col(category).alias("rule"), F.when(interface, ux).otherwise(points).alias("points"), F.lit(None).cast("int").alias("cap"))


def overall(scores: dict[str, Column]) -> Column:
    """Weighted mean of the seven dimensions, rounded half to even."""
    return F.bround(sum((scores[d] * w for d, w in WEIGHTS.items()), F.lit(0.0)))


def lifecycle_status(today: Column, eol: Column, eol_flag: Column, extended: Column) -> Column:
    """Status from dates that may be absent and a flag that may stand for a date."""
    ended = F.coalesce(eol <= today, eol_flag, F.lit(False))
    return F.when(ended & (extended > today), "extended").when(ended, "eol").when(F.datediff(eol, today) <= 365, "ending").otherwise("supported")


def usage_cost(price_in: Column, price_out: Column, tokens_in: Column, tokens_out: Column, cache_write: Column, cache_write_long: Column, cache_read: Column) -> Column:
    """Cost in money of one call, six decimals; prices are per million."""
    weighted = tokens_in + cache_write * CACHE_WRITE + cache_write_long * CACHE_WRITE_LONG + cache_read * CACHE_READ
    return F.bround(weighted * price_in + tokens_out * price_out) / 1_000_000


def luminance(channel: Column) -> Column:
    """sRGB channel (0 to 255) to linear light."""
    c = channel / 255.0
    return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def contrast(fg: Column, bg: Column) -> Column:
    """Contrast ratio of two #rrggbb colours."""

    def light(colour: Column) -> Column:
        r, g, b = (luminance(F.conv(F.substring(colour, at, 2), 16, 10).cast("int")) for at in (2, 4, 6))
        return 0.2126 * r + 0.7152 * g + 0.0722 * b

    a, b = light(fg), light(bg)
    return F.bround((F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05), 2)


# The CVSS 3.1 base metric weights.
CVSS_AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
CVSS_AC = {"L": 0.77, "H": 0.44}
CVSS_UI = {"N": 0.85, "R": 0.62}
CVSS_PR = {False: {"N": 0.85, "L": 0.62, "H": 0.27}, True: {"N": 0.85, "L": 0.68, "H": 0.5}}
CVSS_CIA = {"H": 0.56, "L": 0.22, "N": 0.0}


def _weight(column: Column, table: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column)


def cvss_base(av: Column, ac: Column, pr: Column, ui: Column, scope: Column, c: Column, i: Column, a: Column) -> Column:
    """CVSS 3.1 base score with the standard's round-up to one decimal."""
    parts = F.struct(
        (scope == "C").alias("changed"),
        (1 - (1 - _weight(c, CVSS_CIA)) * (1 - _weight(i, CVSS_CIA)) * (1 - _weight(a, CVSS_CIA))).alias("iss"),
        (8.22 * _weight(av, CVSS_AV) * _weight(ac, CVSS_AC) * _weight(ui, CVSS_UI)).alias("reach"),
        F.when(scope == "C", _weight(pr, CVSS_PR[True])).otherwise(_weight(pr, CVSS_PR[False])).alias("privileges"),
    )

    def rated(p: Column) -> Column:
        hit = F.when(p["changed"], 7.52 * (p["iss"] - 0.029) - 3.25 * F.pow(p["iss"] - 0.02, F.lit(15.0))).otherwise(6.42 * p["iss"])
        raw = (hit + p["reach"] * p["privileges"]) * F.when(p["changed"], 1.08).otherwise(1.0)
        return F.struct(hit.alias("hit"), F.round(F.least(raw, F.lit(10.0)) * 100000).cast("long").alias("scaled"))

    def rounded_up(r: Column) -> Column:
        return F.when(r["hit"] <= 0, 0.0).when(r["scaled"] % 10000 == 0, r["scaled"] / 100000.0).otherwise((F.floor(r["scaled"] / 10000) + 1) / 10.0)

    return F.element_at(F.transform(F.transform(F.array(parts), rated), rounded_up), 1)


def half_steps(value: Column) -> Column:
    """Rounding to halves from 1 on, to tenths below; half to even."""
    return F.when(value >= 1, F.bround(value * 2) / 2).otherwise(F.bround(value, 1))
