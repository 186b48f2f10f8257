"""Anchor expansion against the patterns run over the whole text, and hand-made cases of the added kinds."""

import hashlib
import random
import re

import pytest

from weftline.llm import personal_data
from weftline.llm.queries import registry
from weftline.sources.tables import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    """Base spans (start, rank, end) by the patterns themselves."""
    return sorted((m.start(), rank, m.end()) for rank, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if holds(kind, m[0]))


def spans(text):
    return personal_data.Scan(text).run(personal_data.automaton())


def named(text):
    return [(personal_data.KINDS[r], text[s:e]) for s, r, e in spans(text)[1]]


def test_base_spans_equal_the_patterns_on_random_texts():
    rng = random.Random(12)
    pieces = ["a", "Z9", "@", "@@", ".", "..", "-", "+", "+1", "(", ")", " ", "  ", "\n", "7", "255", "256", "4111 1111 1111 1111", "1.2.3.4", "é", "🙂", "x.y", "_", "%", "٣", "://", "::", "ssn", "(at)", "Account no"]
    anchors = personal_data.automaton()
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        base, every = personal_data.Scan(text).run(anchors)
        assert base == brute(text), text
        assert [s for s in every if s[1] < 4] == base
        more = [s for s in every if s[1] >= 4]
        assert all(a[2] <= b[0] or b[2] <= a[0] for a in more for b in more if a != b)
        assert not any(b[0] <= a[0] and a[2] <= b[2] for a in more for b in base)


def test_added_kinds():
    assert named("write to jo.doe (at) example (dot) org, or x[at]y.net.") == [("written", "jo.doe (at) example (dot) org"), ("written", "x[at]y.net")]
    assert named("see https://jo:pw1@db.example.com:80/x and http://social.example.com/@jo_d.") == [("login", "https://jo:pw1@db.example.com:80"), ("email", "pw1@db.example.com"), ("profile", "http://social.example.com/@jo_d")]
    assert named("host 2001:db8:0:1:1:1:1:1 and fe80:0:0:1::2, at 12:30:45, std::vector a::b") == [("ipv6", "2001:db8:0:1:1:1:1:1"), ("ipv6", "fe80:0:0:1::2")]
    assert named("IBAN DE89 3702 0044 0532 0130 00 or GB29NWBK60161331926819, not DE89 3702 0044 0532 0130 01")[-1] == ("iban", "GB29NWBK60161331926819")
    assert named("SSN: 123-45-6789; part 123-45-6789x; ssn 000-12-3456") == [("ssn", "123-45-6789")]
    assert named("part 123-45-6789 of the list") == []
    assert named("Account number: 00123456-7, account 2024, konto nr. 998877 and passport no C01X00T478") == [("account", "00123456-7"), ("account", "998877"), ("account", "C01X00T478")]


def test_texts_without_personal_data_stay_clean():
    for text in ("at 12:30 on 2024-01-02, 3.5 % of 1,000,000 people", "std::map<int, a::b>", "see https://example.com/users and www.example.org", "accounts of 1999 to 2004", "a@b", "v1.2.3", "@home", "+ 1 + 2", "the dot (at) the end"):
        assert named(text) == [], text


def test_rows_of_all_shapes(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cc"), (3, "x" * 300_000 + "@" + "y" * 1000 + ".zz"), (3, "x" * 300_000 + "@" + "y" * 1000 + ".zz"), (4, "🙂 é a@b.cc 🙂 +1 (234) 567-8901"), (5, "1." * 2_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, base string, spans int").repartition(3)
    got = sorted(((r.doc_id, [tuple(s) for s in r.base]) for r in personal_data.find_personal_data(docs).collect()), key=repr)
    assert got == sorted(((i, brute(t or "")) for i, t in rows), key=repr)
    clean = {r.doc_id: r for r in personal_data.redact(docs).collect()}
    assert clean[4].text == "🙂 é [EMAIL] 🙂 [PHONE]" and clean[4].base == "x" and clean[1].text is None and clean[2].text == ""
    assert personal_data.find_personal_data(docs.where("doc_id > 9")).count() == 0


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_the_query_against_the_patterns(spark, size):
    root = f"/root/testdata/sf{size}"
    texts = {r.doc_id: r.text or "" for r in table(spark, root, "documents").collect()}
    got = registry.queries["op12_personal_data"](spark, root).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4))
        told = ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.spans == told  # the tables hold none of the added kinds
