"""Secret scan with DataFrame operations only.

Base kinds, leftmost and non-overlapping per kind over the whole text: `assign` (a keyword, a
separator and a value of 6 characters or more), `access` (AKIA and capitals or digits, 20 or more)
and `hex` (24 or more). A match that is too short is dropped after it was matched.

The method adds spans of kind `random`: runs of 20 or more of [A-Za-z0-9+/_-] and the `=` that end
them, with a letter and at least two of small letters, capitals and digits. A run is cut at an `=`
with more behind it, so that the value of `NAME=value` is tested by itself, and of a run that overlaps
base spans the parts between them are tested. The encoding of a run is the narrowest alphabet that
holds it. Three tests ask, in that alphabet, whether its symbols could be drawn at random:

* chi-squared test of symbol uniformity, its upper tail by a gamma law with the statistic's mean,
  variance and skewness (with few symbols per cell it is the law of the number of coincidences);
* runs test on the changes between classes of characters (small letters, capitals, digits, signs),
  whose shares the alphabet gives; in hex and base32, where classes are of no use, the
  Wald-Wolfowitz test of runs in the lower and upper half of the alphabet;
* Knuth's circular serial correlation of the symbols' values.

Fisher's method combines the three p-values. A small one says that the run is not random: a name,
words, a path. All runs of the corpus are held against a false-discovery rate of `RATE`
(Benjamini-Hochberg) within bands of length, so that long names, which are easily told, do not
lower the bar for short ones. What the procedure rejects is no secret, and at most that share of what
it rejects is random after all. That says nothing of the runs it does not reject, so a second control
bounds the share of names among the spans: -ln p of names has few values near zero and more and more up
to the threshold t, so with d names a step just behind t (where hardly a random run is left), a span set
cut at a lower step u holds at most some d u^2 / (2 t) names. The largest u is taken at which that is
no more than FALSE_REPORTS of the runs below it; where names abound and random runs are few, none is
left. Both need only the counts of runs per band and p-value step, a table of fixed size that is summed
with a map-side combine; p-values are rounded up to their step.

Texts are read once; spans and p-value steps are written, and the decision is a filter on them.

Edge cases: a null text counts as empty; positions are code points, end exclusive; rows may repeat
and ids may be null; an empty table gives an empty result; a very long text is searched whole, in
its own row; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrays import let, matches
from weftline.llm.rows import column
from weftline.staging import stage

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS, HEX, SIGN, LEAST = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9+/_-]", 20
#: `=` belongs to a run only as padding at its end, and then counts for the length.
RUN = f"(?<!{SIGN})(?:{SIGN}{{{LEAST},}}+(?:=++(?!{SIGN}))?|(?={SIGN}++=++(?!{SIGN}))(?:{SIGN}|=){{{LEAST},}}+)"
KINDS = ("assign", "access", "hex", "random")

#: encoding: (symbols, lower half of the alphabet where runs are counted on halves, else None)
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ENCODINGS = {
    "hex": ("0123456789abcdef", "[0-7]"),
    "hexcaps": ("0123456789ABCDEF", "[0-7]"),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "[A-P]"),
    "small": ("abcdefghijklmnopqrstuvwxyz0123456789", None),
    "capitals": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", None),
    "alnum": (BASE64[:62], None),
    "base64": (BASE64, None),
}
BANDS = (20, 24, 32, 48, 96)
RATE, STEPS_PER_NAT, STEPS = 0.01, 4, 2000
#: The share of names among the reported spans of a band that is aimed at.
FALSE_REPORTS = 0.05


def _spans(text: Column, pattern: str, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["hit"].alias("hit")))


def base_spans(text: Column) -> Column:
    """All base spans, by start and then kind."""
    assign = F.filter(_spans(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN_VALUE, 1)) >= 6)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def class_shares(symbols: str) -> list[float]:
    """The shares of small letters, capitals, digits and signs in an alphabet."""
    counts = [sum(c.islower() for c in symbols), sum(c.isupper() for c in symbols), sum(c.isdigit() for c in symbols)]
    return [c / len(symbols) for c in (*counts, len(symbols) - sum(counts))]


def _encoding(token: Column) -> Column:
    """The name of the narrowest alphabet that holds the token; null for digits alone and for letters of one case alone."""
    body = F.regexp_replace(token, "=+$", "")
    return (
        F.when(~body.rlike("[A-Za-z]") | ~(body.rlike("[a-z]") & body.rlike("[A-Z]") | body.rlike("[0-9]")), F.lit(None))
        .when(body.rlike("^[0-9a-f]+$"), "hex")
        .when(body.rlike("^[0-9A-F]+$"), "hexcaps")
        .when(body.rlike("^[A-Z2-7]+$"), "base32")
        .when(body.rlike("^[a-z0-9]+$"), "small")
        .when(body.rlike("^[A-Z0-9]+$"), "capitals")
        .when(body.rlike("^[A-Za-z0-9]+$"), "alnum")
        .otherwise("base64")
    )


def _of_encoding(encoding: Column, value) -> Column:
    """`value` of each encoding's (symbols, half)."""
    found = F.lit(None)
    for name, parts in ENCODINGS.items():
        found = F.when(encoding == name, F.lit(value(*parts))).otherwise(found)
    return found


def _changes(text: Column) -> Column:
    """How often a character differs from the one before it."""
    return (F.length(F.regexp_replace(text, r"(.)\1*", "r")) - 1).cast("double")


def negative_log_tail(z: Column) -> Column:
    """-ln of the upper normal tail (Abramowitz and Stegun 26.2.17); 0, so p = 1, for z below one half."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0.5, 0.0).otherwise(z * z / 2 + math.log(math.sqrt(2 * math.pi)) - F.log(poly))


def _two_sided(size: Column) -> Column:
    """-ln of both tails, of a deviate's absolute value."""
    return F.greatest(F.lit(0.0), negative_log_tail(size) - math.log(2))


def _scored(span: Column, token: Column, encoding: Column) -> Column:
    """start, end, band and step (of -ln p of the battery) of one token. Each `let` keeps what follows from repeating what it binds."""
    bound = F.struct(token.alias("token"), encoding.alias("encoding"), F.length(token).cast("double").alias("n"), span["start"].alias("start"), span["end"].alias("end"))
    return let(bound, lambda b: let(_counted(b), lambda c: let(_deviations(b, c), lambda d: let(_surprise(b, d), lambda total: _stepped(b, total)))))


def _counted(b: Column) -> Column:
    """What the tests count in a token, and what its encoding fixes."""
    token, encoding = b["token"], b["encoding"]
    squares = F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(F.pow((F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0))))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[^A-Za-z0-9]", "-"), "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "9")
    halves = F.lit("")
    for name, (_, half) in ENCODINGS.items():
        if half:
            low = F.regexp_replace(F.regexp_replace(token, half.replace("[", "[^"), "+"), "[^+]", "0")
            halves = F.when(encoding == name, low).otherwise(halves)
    start = F.struct(F.lit(-1.0).alias("first"), F.lit(0.0).alias("last"), F.lit(0.0).alias("x"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("xy"))
    symbols = _of_encoding(encoding, lambda symbols, half: symbols)
    indexed = F.transform(F.filter(F.split(F.translate(token, "-_", "+/"), ""), lambda c: c != ""), lambda c: F.instr(symbols, c).cast("double"))
    serial = F.aggregate(
        indexed,
        start,
        lambda a, v: F.struct(F.when(a["first"] < 0, v).otherwise(a["first"]).alias("first"), v.alias("last"), (a["x"] + v).alias("x"), (a["xx"] + v * v).alias("xx"), F.when(a["first"] < 0, 0.0).otherwise(a["xy"] + a["last"] * v).alias("xy")),
    )
    return F.struct(
        squares.alias("sq"),
        _changes(classes).alias("changes"),
        halves.alias("halves"),
        serial.alias("serial"),
        _of_encoding(encoding, lambda symbols, half: float(len(symbols))).alias("k"),
        _of_encoding(encoding, lambda symbols, half: sum(q**2 for q in class_shares(symbols))).alias("same"),
        _of_encoding(encoding, lambda symbols, half: sum(q**3 for q in class_shares(symbols))).alias("twice"),
    )


def _deviations(b: Column, c: Column) -> Column:
    """The three tests as normal deviates; where a test has no spread, its -ln p stands in `sure`."""
    n, k, s, none = b["n"], c["k"], c["serial"], F.lit(0.0)
    # symbols: gamma law by mean, variance and skewness; Wilson and Hilferty's cube root makes it normal
    shape = 4 / (8 / (k - 1) + 2 * k / (n * (n - 1)))
    z = (k / n * c["sq"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    uniform = 3 * F.sqrt(shape) * (F.pow(F.greatest(none, 1 + z / F.sqrt(shape)), F.lit(1 / 3)) - 1 + 1 / (9 * shape))
    # runs of classes, with the alphabet's own shares
    by_class = (c["changes"] - (n - 1) * (1 - c["same"])) / F.sqrt((n - 1) * c["same"] * (1 - c["same"]) + 2 * (n - 2) * (c["twice"] - c["same"] * c["same"]) + 1e-9)
    # runs of halves, given how many symbols are in each
    n1 = (F.length(b["token"]) - F.length(F.replace(c["halves"], F.lit("+"), F.lit("")))).cast("double")
    mu = 2 * n1 * (n - n1) / n + 1
    spread = (mu - 1) * (mu - 2) / (n - 1)
    by_half = (_changes(c["halves"]) + 1 - mu) / F.sqrt(F.greatest(spread, F.lit(1e-9)))
    halved = b["encoding"].isin(*[name for name, (_, half) in ENCODINGS.items() if half])
    one_sided = halved & (spread <= 0)
    # circular serial correlation: mean -1 / (n - 1), variance n^2 / ((n - 1)^2 (n - 2))
    down = n * s["xx"] - s["x"] * s["x"]
    r = (n * (s["xy"] + s["first"] * s["last"]) - s["x"] * s["x"]) / F.greatest(down, F.lit(1e-9))
    serial = F.when(down <= 0, none).otherwise((r + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n)
    sure = F.when(one_sided, (n - 1) * math.log(2)).otherwise(none) + F.when(down <= 0, n).otherwise(none)
    runs = F.when(one_sided, none).when(halved, by_half).otherwise(by_class)
    return F.struct(uniform.alias("uniform"), F.abs(runs).alias("runs"), F.abs(serial).alias("serial"), sure.alias("sure"))


def _surprise(b: Column, d: Column) -> Column:
    """-ln of the product of the three p-values."""
    return negative_log_tail(d["uniform"]) + _two_sided(d["runs"]) + _two_sided(d["serial"]) + d["sure"]


def _stepped(b: Column, total: Column) -> Column:
    """Fisher's combination of three p-values, in steps."""
    fisher = total - F.log(1 + total + total * total / 2)
    step = F.least(F.lit(STEPS), F.floor(fisher * STEPS_PER_NAT + 1e-9)).cast("int")
    band = sum((b["n"] >= least).cast("int") for least in BANDS[1:])
    return F.struct(b["start"].alias("start"), b["end"].alias("end"), band.alias("band"), step.alias("step"))


def _parts(run: Column, base: Column) -> Column:
    """The stretches of LEAST signs or more of a run that are in no base span; base spans come by start."""

    def grown(parts: Column, start: Column, end: Column) -> Column:
        part = F.struct(start.alias("start"), end.alias("end"), F.substring(run["hit"], (start - run["start"] + 1).cast("int"), (end - start).cast("int")).alias("hit"))
        return F.when(end - start >= LEAST, F.concat(parts, F.array(part))).otherwise(parts)

    met = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    none = F.array().cast("array<struct<start:long,end:long,hit:string>>")
    left = F.aggregate(
        met,
        F.struct(run["start"].alias("at"), none.alias("parts")),
        lambda a, b: F.struct(F.greatest(a["at"], b["end"]).alias("at"), grown(a["parts"], a["at"], b["start"]).alias("parts")),
        lambda a: grown(a["parts"], a["at"], run["end"]),
    )
    return F.when(F.size(met) == 0, F.array(run)).otherwise(left)


def candidates(text: Column, base: Column) -> Column:
    """Scored token runs, or what is left of them beside base spans."""
    tokens = F.filter(F.flatten(F.transform(matches(text, RUN), lambda m: _parts(m, base))), lambda m: _encoding(m["hit"]).isNotNull())
    return F.transform(tokens, lambda m: _scored(m, F.regexp_replace(m["hit"], "=+$", ""), _encoding(m["hit"])))


def thresholds(counts: list[tuple[int, int, int]], rate: float = RATE) -> list[int]:
    """The smallest rejected step per band from (band, step, candidates): Benjamini-Hochberg on p rounded up to its step."""
    found = []
    for band in range(len(BANDS)):
        steps = sorted(((s, c) for b, s, c in counts if b == band), reverse=True)
        total, above, accepted = sum(c for _, c in steps), 0, STEPS + 1
        for step, count in steps:
            above += count
            if math.exp(-step / STEPS_PER_NAT) * total <= rate * above:
                accepted = step
        found.append(accepted)
    return found


def reported(counts: list[tuple[int, int, int]], rejected: list[int], share: float = FALSE_REPORTS) -> list[int]:
    """The step per band below which runs are spans: at most the rejected one, and as low as the bound on names asks for."""
    found = []
    for band, t in enumerate(rejected):
        steps = {s: c for b, s, c in counts if b == band}
        below = sum(c for s, c in steps.items() if s < t)
        left = below * math.exp(-t / STEPS_PER_NAT) / (1 - math.exp(-t / STEPS_PER_NAT))  # random runs behind t
        names = max(0.0, sum(c for s, c in steps.items() if t <= s < 2 * t) - left) / t
        u = t
        while u > 0 and names * u * u / (2 * t) > share * below:
            u -= 1
            below -= steps.get(u, 0)
        found.append(u)
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, base and spans of each document: arrays of start, rank (of KINDS), end, hit (null for random)."""
    text = F.coalesce(column(text_col), F.lit(""))
    scan = docs.select(column(id_col).alias("doc_id"), let(F.struct(text.alias("t")), lambda x: let(base_spans(x["t"]), lambda base: F.struct(base.alias("base"), candidates(x["t"], base).alias("found")))).alias("r"))
    scanned = stage(scan.select("doc_id", "r.base", "r.found"), "secrets")
    tally = scanned.where(F.size("found") > 0).select(F.explode("found").alias("f")).groupBy("f.band", "f.step").agg(F.count("*").alias("n"))
    counts = [tuple(r) for r in tally.collect()]
    bounds = F.array(*[F.lit(u) for u in reported(counts, thresholds(counts, rate))])
    random = F.transform(
        F.filter("found", lambda f: f["step"] < F.element_at(bounds, f["band"] + 1)),
        lambda f: F.struct(f["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), f["end"].alias("end"), F.lit(None).cast("string").alias("hit")),
    )
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")
