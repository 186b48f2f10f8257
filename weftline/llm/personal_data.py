"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs (written out ones too), plus signs, digits,
``://``, colon pairs, and the words that announce an identifier. Each anchor is handed to parsers
that read a few characters to its left and right, fix the boundaries and check what they hold. No
pattern is searched through the whole text.

Base kinds are what the leftmost non-overlapping matches of these patterns are over the whole text,
with those that fail the check dropped afterwards (a dropped match still takes up its characters):

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``: from an at-sign to the left as far as the
  local part's characters go, but not into the match before, and to the right as the domain goes;
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, no part above 255: from the first digit of a run;
* card ``[0-9]([\\x20-]?[0-9])+``, 12 to 19 digits that pass Luhn's check: the same;
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits: from a plus sign.

The method adds spans that are not inside a base span: `written` (an email with its at-sign or dots spelled
out in brackets), `login` (user and password in an address), `profile` (an address whose path names an
account), `ipv6`, `iban` (two capitals, two digits, the check modulo 97), `ssn` (with a cue at most CUE_REACH
characters before it) and `account` (a cue, a word for number or a sign, and a value with six digits
or more). Of added spans that overlap the one of the kind listed first stays.

Edge cases: a null text counts as empty; positions are code points, end exclusive; a very long text is
searched whole by its task, each parser in time linear in its length; rows may repeat and ids may be
null; an empty table gives an empty result. Only id and text are read by the search, and `redact`
carries a row in one struct, so other columns cannot clash.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.rows import ROW, column, packed

BASE = ("email", "ip", "card", "phone")
ADDED = ("written", "login", "profile", "ipv6", "iban", "ssn", "account")
KINDS = BASE + ADDED
CUE_REACH = 60
SPANS = "array<struct<start:long,rank:int,end:long>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WRITTEN_AT = ("(at)", "[at]", "{at}", "<at>", "(@)", "[@]")
SSN_CUES = ("ssn", "social security")
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "reisepass", "passeport", "pasaporte", "patient", "customer id", "client id", "tax id")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WRITTEN_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[(\[{<](?:dot|DOT|Dot)[)\]}>])\x20?[A-Za-z0-9-]+)+")
AUTHORITY = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[^\s/@:\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
PROFILE = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+(?::[0-9]+)?/(?:@|~|u/|user/|users/|profile/|profiles/|in/|people/)[A-Za-z0-9._-]*[A-Za-z0-9_]")
SCHEMES = ("https", "http", "ftps", "ftp", "ssh", "git", "smb", "imap", "smtp", "redis", "postgres", "postgresql", "mysql", "mongodb", "amqp")
HEX_GROUPS = re.compile(r"[0-9A-Fa-f:]{2,45}(?:(?<=:)[0-9]{1,3}(?:\.[0-9]{1,3}){3})?")
IBAN = re.compile(r"[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
ACCOUNT_VALUE = re.compile(r"\x20?(?:(?:number|num|no|nr|nummer|numéro|número|id)\b\.?\x20?[:#=]?|[:#=])\x20?([A-Z0-9]+(?:-[A-Z0-9]+|\x20[0-9][A-Z0-9]*)*)(?![A-Za-z0-9])", re.I)


def _passes_luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits_of(text: str) -> str:
    return "".join(filter("0123456789".__contains__, text))


def automaton():
    """Anchors and what they stand for; words in small letters, capitals and with a capital first."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for what, words in (("@", ["@"]), ("+", ["+"]), ("0", "0123456789"), ("//", ["://"]), ("::", [":"]), ("at", WRITTEN_AT), ("ssn", SSN_CUES), ("cue", ACCOUNT_CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (what, len(form)))
    found.make_automaton()
    return found


class Scan:
    """The parsers over one text. `ends` holds where each kind's latest match ended, so that matches never overlap."""

    def __init__(self, text: str) -> None:
        self.text, self.base, self.more = text, [], []
        self.ends = dict.fromkeys(KINDS, 0)
        self.run_end = self.ssn_cue = -1

    def _keep(self, kind: str, start: int, end: int) -> None:
        rank = KINDS.index(kind)
        (self.base if rank < len(BASE) else self.more).append((start, rank, end))

    def _open(self, at: int) -> bool:
        """No letter or digit stands before `at`."""
        return at == 0 or not self.text[at - 1].isalnum()

    def _left(self, at: int, stop: int) -> int:
        """Where the run of local-part characters that ends at `at` begins."""
        while at > stop and self.text[at - 1] in LOCAL:
            at -= 1
        return at

    def at_sign(self, at: int) -> None:
        if domain := DOMAIN.match(self.text, at + 1):
            start = self._left(at, self.ends["email"])
            if start < at:
                self._keep("email", start, domain.end())
                self.ends["email"] = domain.end()

    def written_at(self, at: int, end: int) -> None:
        if domain := WRITTEN_DOMAIN.match(self.text, end):
            stop = at - (at > 0 and self.text[at - 1] == " ")
            start = self._left(stop, self.ends["written"])
            if start < stop:
                self._keep("written", start, domain.end())
                self.ends["written"] = domain.end()

    def plus(self, at: int) -> None:
        if (hit := PHONE.match(self.text, at)) and 9 <= len(_digits_of(hit[0])) <= 15:
            self._keep("phone", at, hit.end())

    def digit(self, at: int) -> None:
        if at >= self.ends["card"] and (hit := CARD.match(self.text, at)):
            self.ends["card"] = hit.end()
            digits = _digits_of(hit[0])
            if 12 <= len(digits) <= 19 and _passes_luhn(digits):
                self._keep("card", at, hit.end())
        if at >= self.ends["ip"] and at >= self.run_end:
            if hit := IP.match(self.text, at):
                self.ends["ip"] = hit.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in hit[0].split(".")):
                    self._keep("ip", at, hit.end())
        if at < self.run_end:
            return
        self.run_end = DIGITS.match(self.text, at).end()  # the digits behind the first of a run begin nothing that it does not
        if 0 <= at - self.ssn_cue <= CUE_REACH and self.ssn_cue >= 0 and self._open(at) and (hit := SSN.match(self.text, at)):
            self._keep("ssn", at, hit.end())
        if at >= 2 and self.text[at - 2 : at].isascii() and self.text[at - 2 : at].isalpha() and self.text[at - 2 : at].isupper() and self._open(at - 2) and at >= self.ends["iban"]:
            self._iban(at)

    def _iban(self, at: int) -> None:
        if hit := IBAN.match(self.text, at):
            value = (self.text[at - 2 : at] + hit[0]).replace(" ", "")
            turned = value[4:] + value[:4]
            if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
                self._keep("iban", at - 2, hit.end())
                self.ends["iban"] = hit.end()

    def scheme(self, at: int, end: int) -> None:
        scheme = next((s for s in SCHEMES if self.text[max(0, at - len(s)) : at].lower() == s and self._open(at - len(s))), None)
        if scheme:
            for kind, parser in (("login", AUTHORITY), ("profile", PROFILE)):
                if hit := parser.match(self.text, end):
                    self._keep(kind, at - len(scheme), hit.end())
                    return

    def colon(self, at: int) -> None:
        if at < self.ends["ipv6"]:
            return
        start = at
        while start > self.ends["ipv6"] and at - start < 4 and self.text[start - 1] in "0123456789abcdefABCDEF":
            start -= 1
        hit = HEX_GROUPS.match(self.text, start)
        if hit is None:
            return
        self.ends["ipv6"] = hit.end()
        whole = hit[0].rstrip(":") if not hit[0].endswith("::") else hit[0]
        end = start + len(whole)
        if self._open(start) and not self.text[end : end + 1].isalnum() and sum(map(bool, re.split("[:.]", whole))) >= 4:
            try:
                ipaddress.IPv6Address(whole)
            except ValueError:
                return
            self._keep("ipv6", start, end)

    def cue(self, at: int, end: int) -> None:
        if self._open(at) and end >= self.ends["account"] and (hit := ACCOUNT_VALUE.match(self.text, end)) and len(_digits_of(hit[1])) >= 6:
            self._keep("account", hit.start(1), hit.end(1))
            self.ends["account"] = hit.end(1)

    def run(self, anchors) -> tuple[list, list]:
        """Base spans, and all spans, each by start and then kind."""
        for last, (what, length) in anchors.iter(self.text):
            at = last + 1 - length
            if what == "0":
                self.digit(at)
            elif what == "@":
                self.at_sign(at)
            elif what == "+":
                self.plus(at)
            elif what == "::":
                self.colon(at)
            elif what == "//":
                self.scheme(at, last + 1)
            elif what == "at":
                self.written_at(at, last + 1)
            elif what == "cue":
                self.cue(at, last + 1)
            elif self._open(at):
                self.ssn_cue = last + 1
        base = sorted(self.base)
        return base, sorted(base + _free(base, self.more))


def _free(base: list, more: list) -> list:
    """The added spans that are inside no base span and overlap none of a kind before theirs."""
    kept: list = []
    reached = [0, *accumulate((end for _, _, end in base), max)]  # how far the base spans up to one go
    for span in sorted(more, key=lambda s: (s[1], s[0])):
        if reached[bisect_right(base, (span[0], len(KINDS), 0))] >= span[2] and any(s <= span[0] and span[2] <= e for s, _, e in base):
            continue
        at = bisect_right(kept, span)
        if (at == 0 or kept[at - 1][2] <= span[0]) and (at == len(kept) or span[2] <= kept[at][0]):
            kept.insert(at, span)
    return kept


def _array(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())]))
    return pa.array([[{"start": s, "rank": r, "end": e} for s, r, e in spans] for spans in found], kind)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        found = [Scan(text or "").run(anchors) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), _array([b for b, _ in found]), _array([a for _, a in found])], ["doc_id", "base", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans of each document: arrays of start, rank (of KINDS), end, by start and then kind."""
    read = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return read.mapInArrow(_scan_batches, f"doc_id long, base {SPANS}, spans {SPANS}")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for start, rank, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[rank].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        clean = [t if t is None else masked(t, Scan(t).run(anchors)[1]) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string())], [ROW, "clean"])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data in their text replaced by the names of its kinds; other columns as they were."""
    held = docs.select(packed(docs), column(text_col).alias("clean"))
    done = held.mapInArrow(_mask_batches, held.schema)
    return done.select(*[F.col("clean").alias(c) if c == text_col else F.col(ROW).getField(c).alias(c) for c in docs.columns])


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")
