"""Balanced brackets and quotes in code and statements, JVM-side only: a text is cut in tokens once, and depths are running sums over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Running sums are built in blocks of this many values, so that their cost stays near linear.
BLOCK = 256
#: A quoted string (an open one goes to the end), one bracket, one comma or semicolon, or a run of other characters.
TOKEN = r""""[^"]*"?|'[^']*'?|`[^`]*`?|[()\[\]{},;]|[^"'`()\[\]{},;]+"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once however often `body` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column) -> Column:
    """v1, v1 + v2, ... of a short array."""
    return F.slice(F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), F.lit(2), F.size(values))


def running_sums(values: Column) -> Column:
    """v1, v1 + v2, ... of an array of ints."""

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: _running(F.slice(v, b * BLOCK + 1, BLOCK)))
        ends = lambda bs: F.concat(F.array(F.lit(0)), _running(F.transform(bs, lambda b: F.element_at(b, -1))))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.slice(ends(bs), F.lit(1), F.size(bs)), lambda b, base: F.transform(b, lambda x: x + base))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(of(v)))


def _opens(token: Column) -> Column:
    return F.when(token.isin("(", "[", "{"), 1).when(token.isin(")", "]", "}"), -1).otherwise(0)


def _cut(tokens: Column, depths: Column, separator: str, level: int, trim: bool = True) -> Column:
    """The tokens joined between separators that stand at a depth; each part trimmed, unless told otherwise."""
    places = F.filter(F.transform(tokens, lambda t, i: F.when((t == separator) & (F.get(depths, i) == level), i)), lambda i: i.isNotNull())
    starts, ends = F.concat(F.array(F.lit(-1)), places), F.concat(places, F.array(F.size(tokens)))
    blank = lambda part: F.trim(part, F.lit(" \t\r\n")) if trim else part
    return F.zip_with(starts, ends, lambda a, b: blank(F.array_join(F.slice(tokens, a + 2, b - a - 1), "")))


def top_level_parts(body: Column, separator: str = ",") -> Column:
    """the parts of a text between separators that stand outside brackets and quotes."""
    return let(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), lambda tokens: let(running_sums(F.transform(tokens, _opens)), lambda depths: _cut(tokens, depths, separator, 0)))


def bracketed_parts(rest: Column, separator: str = ",", trim: bool = True) -> Column:
    """The parts of what stands in a bracket, given the text behind the opening one; to the end of the text where it never closes. No part for an empty bracket."""

    def of(tokens: Column, depths: Column) -> Column:
        closed = F.array_position(depths, -1)
        size = F.when(closed > 0, closed - 1).otherwise(F.size(tokens)).cast("int")
        return let(F.slice(tokens, F.lit(1), size), lambda inner: _cut(inner, depths, separator, 0, trim))

    parts = let(F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0)), lambda tokens: let(running_sums(F.transform(tokens, _opens)), lambda depths: of(tokens, depths)))
    return let(parts, lambda p: F.when((F.size(p) == 1) & (F.get(p, 0) == ""), F.array().cast("array<string>")).otherwise(p))


def counted(text: Column, sign: str) -> Column:
    """How often a character stands in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def sections(text: Column, head: str) -> Column:
    """array<struct<n: int, text: string>>: the text from each match of `head` to the next, and the line on which it begins; what stands before the first is left out."""

    def of(parts: Column) -> Column:
        lines = F.transform(parts, lambda p: counted(p, "\n"))
        placed = let(running_sums(lines), lambda after: F.zip_with(parts, F.zip_with(after, lines, lambda a, b: a - b + 1), lambda p, n: F.struct(n.alias("n"), p.alias("text"))))
        return F.filter(placed, lambda s: s["text"].rlike(f"^(?:{head})"))

    return let(F.split(text, f"(?={head})", -1), of)


def code_only(expression: Column) -> Column:
    """The expression without what its string literals say; what stands in {braces} inside them stays, as it is code."""
    literal = r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`"""
    tokens = F.regexp_extract_all(expression, F.lit(literal + r"""|[^"'`]+|["'`]"""), F.lit(0))
    spoken = lambda t: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(t, F.lit(r"\{([^}]*)\}"), F.lit(1)), " "), F.lit(" "))
    return F.array_join(F.transform(tokens, lambda t: F.when((F.length(t) > 1) & t.rlike("^[\"'`]"), spoken(t)).otherwise(t)), "")


def without_line_comment(line: Column) -> Column:
    """The line up to `#` or `//` outside quotes, without blanks at its end."""
    tokens = F.regexp_extract_all(line, F.lit(r""""[^"]*"?|'[^']*'?|`[^`]*`?|//|#|[^"'`/#]+|/"""), F.lit(0))
    cut = let(tokens, lambda t: let(F.array_position(F.transform(t, lambda x: x.isin("#", "//")), True), lambda at: F.array_join(F.when(at > 0, F.slice(t, F.lit(1), (at - 1).cast("int"))).otherwise(t), "")))
    return F.rtrim(F.regexp_replace(cut, r"\s+$", ""))
