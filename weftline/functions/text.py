"""Text functions (F*)."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def short_name(name: Column) -> Column:
    """the last segment on . or :, upper-cased."""
    return F.upper(F.element_at(F.split(name, "[.:]"), -1))


def concept_word(name: Column, general: tuple[str, ...]) -> Column:
    """the last part of an identifier that is no number; empty if shorter than four characters, general, or a letter with digits."""
    parts = F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda p: (p != "") & ~p.rlike("^[0-9]+$"))
    word = F.upper(F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")))
    return F.when((F.length(word) >= 4) & ~word.isin(*general) & ~word.rlike("^[A-Z][0-9]+$"), word).otherwise("")


def upper_snake(name: Column) -> Column:
    """camelCase and spaces to UPPER_SNAKE of the last dotted segment."""
    last = F.element_at(F.split(name, r"\."), -1)
    return F.trim(F.upper(F.regexp_replace(F.regexp_replace(last, "([a-z])([A-Z])", "$1_$2"), r"[-\s]+", "_")), F.lit("_"))


# Classes of personal data by field name, first match wins.
PERSONAL_DATA = (
    (r"^(SSN|SOC_?SEC\w*|SOCIAL_?SECURITY\w*|SSNO)$", "social security number", "critical"),
    (r"^(DOB|BIRTH_?(DATE|DT)|DATE_?OF_?BIRTH|BIRTHDAY)$", "date of birth", "high"),
    (r"^(MARSS\w*|SSID|STATE_?STUDENT_?ID|STUDENT_?(ID|NUM|NBR|NO|NUMBER|KEY)|STU_?(ID|NUM|NBR))$", "student identifier", "high"),
    (r"^(STUDENT_?NAME|STU_?NAME|PUPIL_?(NAME|FIRST\w*|LAST\w*)|FIRST_?NAME|LAST_?NAME|MIDDLE_?NAME)$", "student / person name", "medium"),
    (r"^(GUARDIAN\w*|PARENT_?NAME\w*)$", "parent / guardian", "medium"),
    (r"^(HOME_?ADDR\w*|STREET\w*|ADDRESS\d?|ADDR\d?|PHONE\w*|EMAIL\w*)$", "contact details", "medium"),
    (r"^(FREE_?REDUCED\w*|FRL|FRPL|LUNCH_?STATUS|ECON\w*_?DISADV\w*)$", "free/reduced lunch (economic status)", "high"),
    (r"^(IEP|SPED|SPECIAL_?ED\w*|DISABILIT\w*|SECTION_?504|PRIMARY_?DISABILITY)$", "special education / disability", "high"),
    (r"^(LEP|ELL|EL_?STATUS|ENGLISH_?LEARNER\w*)$", "English learner status", "medium"),
    (r"^(RACE\w*|ETHNIC\w*|HOMELESS\w*|MIGRANT\w*)$", "demographic / protected status", "high"),
    (r"^(GRADE_?LEVEL|GRADE|ENROLL\w*|ATTENDANCE\w*)$", "education record", "low"),
)


def personal_data_class(name: Column) -> Column:
    """struct(label, severity) of the first class that the name, or the name without its first one or two parts, belongs to."""
    parts = F.split(F.regexp_replace(upper_snake(name), "_(IN|OUT|I|O|L|A|F)$", ""), "_")

    def class_of(candidate: Column) -> Column:
        chain = None
        for pattern, label, severity in PERSONAL_DATA:
            found = F.struct(F.lit(label).alias("label"), F.lit(severity).alias("severity"))
            chain = F.when(candidate.rlike(pattern), found) if chain is None else chain.when(candidate.rlike(pattern), found)
        return chain

    def first_class(p: Column) -> Column:
        tails = F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(p))), lambda d: F.array_join(F.slice(p, d, F.size(p)), "_"))
        return F.get(F.array_compact(F.transform(tails, class_of)), 0)

    return F.get(F.transform(F.array(parts), first_class), 0)


# What secrets look like on an evidence line, applied in this order.
MASKS = (
    (r"""(?i)((?:password|passwd|pwd|secret|api_?key|access_?key|token)\w*["']?\s*[:=]\s*["'])([^"']{3,})(["'])""", "$1****$3"),
    (r"""(?i)((?:password|passwd|pwd|secret|api_?key|access_?key|token|dbpass|logpass)\w*["']?\s*(?:==|=|:|\.Equals\s*\(|,)\s*@?)(["'])([^"'\n]+)(["'])""", "$1$2****$4"),
    (r"""(?i)(;\s*(?:Password|Pwd)\s*=\s*)([^;"']+)(?=[;"'])""", "$1****"),
    (r"""(?i)((?:Password|Pwd)\s*=\s*)([^;"'\s]+)""", "$1****"),
    (r"""(?i)(\b[a-z][a-z0-9+.-]*://[^\s/:@"']+:)[^\s@/"']+(@)""", "$1****$2"),
)
STRICT_MASKS = (
    (r"""(@?)(["'])((?:\\.|""|[^"'\\\n])*)(\2)""", "$1$2****$4"),
    (r"(\s-P\s*)(\S+)", "$1****"),
    (r"(\s-p)(\S+)", "$1****"),
    (r"(?i)(\bIDENTIFIED\s+BY\s+)(\"?\w+\"?)", "$1****"),
    (r"(\b\w+/)([^\s@/]+)(@\w+)", "$1****$3"),
    (r"""(?i)(\b(?:password|pw|pwd|dbpass)\s*=\s*)([^"'\s;)&%*]{2,})""", "$1****"),
    (r"(?i)(net\s+use\s+(?:[A-Za-z*]:\s+)?\\\\\S+\s+)(?!/)(\S+)", "$1****"),
)


def masked(line: Column, strict: Column | None = None) -> Column:
    """an evidence line without secret values, at most 200 characters; `strict` rows lose every quoted literal too."""
    out = line
    for pattern, by in MASKS:
        out = F.regexp_replace(out, pattern, by)
    out = F.when(out.rlike("(?i)(PASSWORD|PASSWD|PWD)"), F.regexp_replace(out, r"(VALUE\s+['\"])([^'\"]+)(['\"])", "$1****$3")).otherwise(out)
    if strict is not None:
        hard = out
        for pattern, by in STRICT_MASKS:
            hard = F.regexp_replace(hard, pattern, by)
        out = F.when(strict, hard).otherwise(out)
    return F.substring(F.trim(out), 1, 200)


def redacted(text: Column, terms: dict[str, str]) -> Column:
    """stated names replaced, the longest first."""
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        text = F.regexp_replace(text, "(?i)\\b\\Q" + term + "\\E\\b", terms[term])
    return text


def delivered(text: Column, terms: tuple[str, ...], short: str = "CLIENT") -> Column:
    """Stated names replaced by `short`, the longest first, spaced or joined by underscores, unless a letter stands before.

    Names of several words match in any case, single words as stated. Characters that XML forbids go
    (vertical tabs and form feeds become spaces), then doubled underscores and those before an ending.
    `terms` is the short list of the settings.
    """
    text = F.regexp_replace(F.translate(text, "\x0b\x0c", "  "), r"[\x00-\x08\x0e-\x1f\uFFFE\uFFFF]", "")
    cleaned = text
    for term in sorted({t.strip() for t in terms} - {""}, key=lambda t: (-len(t), t)):
        for spelled in sorted({term, term.replace(" ", "_")}):
            cleaned = F.regexp_replace(cleaned, ("(?i)" if " " in spelled else "") + "(?<![A-Za-z])\\Q" + spelled + "\\E", short.replace("\\", "\\\\").replace("$", "\\$"))
    return F.regexp_replace(F.regexp_replace(cleaned, r"_+(?=\.[A-Za-z0-9]+\b)", ""), "__+", "_") if terms else text


def slug(name: Column) -> Column:
    """lower case, runs of other characters as one hyphen."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


# Fixed values.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}


def number_of(token: Column) -> Column:
    """F16: number words and digit groups to an integer, null for anything else."""
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, F.lower(token)), F.regexp_replace(token, ",", "").try_cast("int"))


def fitted(text: Column, most: int) -> Column:
    """head and tail of a long text, cut at line ends where there is one, with a note between."""
    head, tail = F.substring(text, 1, most // 2), F.reverse(F.substring(F.reverse(text), 1, most // 2))
    head = F.when(F.instr(head, "\n") > 0, F.regexp_replace(head, r"\n[^\n]*$", "")).otherwise(head)
    tail = F.when(F.instr(tail, "\n") > 0, F.regexp_replace(tail, r"^[^\n]*\n", "")).otherwise(tail)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(head, F.lit("\n[...]\n"), tail))


def first_sentence(text: Column, most: int) -> Column:
    """whole text if short enough, else cut at the last sentence end that fits, else at the last space."""
    cut = F.substring(text, 1, most)
    sentence = F.regexp_extract(cut, r"(?s)^(.*[.!?])(?=\s|$)", 1)
    words = F.regexp_replace(cut, r"\s+\S*$", "")
    return F.when(F.length(text) <= most, text).when(sentence != "", sentence).otherwise(words)


def squeeze_outside_quotes(line: str) -> str:
    """runs of blanks outside quotes (\", ' and `) as one space, none at the ends but inside an open quote; a backslash keeps the next character."""
    out: list[str] = []
    quote = ""
    escape = False
    for ch in line.lstrip():
        if escape:
            out.append(ch)
            escape = False
        elif quote:
            out.append(ch)
            escape = ch == "\\"
            if ch == quote:
                quote = ""
        elif ch in "\"'`":
            quote = ch
            out.append(ch)
        elif ch.isspace():
            if out and out[-1] != " ":
                out.append(" ")
        else:
            out.append(ch)
    return "".join(out) if quote else "".join(out).rstrip()


@F.pandas_udf(StringType())
def squeezed_outside_quotes(lines: pd.Series) -> pd.Series:
    """F1 over a column; equal lines are worked on once per batch."""
    known = {x: squeeze_outside_quotes(x) for x in lines.dropna().unique()}
    return lines.map(known)


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio; cheap upper bounds (F19) spare most exact ones below a threshold."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """F18 over two columns; null where either is."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """no ratio exceeds 2 min(length) / (sum of lengths)."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2 * F.least(F.length(a), F.length(b)) / total)
