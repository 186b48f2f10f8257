"""The randomness battery against its definitions in plain Python, and what it finds in prose."""

import base64
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import secret_scan as scan

ALPHABETS = {name: symbols for name, (symbols, _) in scan.ENCODINGS.items()}


def encoding(token):
    if not re.search("[A-Za-z]", token) or not (re.search("[a-z]", token) and re.search("[A-Z]", token) or re.search("[0-9]", token)):
        return None
    return next(name for name, symbols in ALPHABETS.items() if set(token.translate(str.maketrans("-_", "+/"))) <= set(symbols))


def tail(z):
    return -math.log(0.5 * math.erfc(z / math.sqrt(2))) if z >= 0.5 else 0.0


def two_sided(z):
    return max(0.0, tail(abs(z)) - math.log(2))


def surprise(token):
    """-ln p of the battery, from the definitions."""
    name, n = encoding(token), len(token)
    symbols = ALPHABETS[name]
    k = len(symbols)
    chi = sum((token.count(c) - n / k) ** 2 / (n / k) for c in set(token)) + (k - len(set(token))) * n / k
    z = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    shape = 4 / (8 / (k - 1) + 1 / (n * (n - 1) / (2 * k)))
    uniform = tail(3 * math.sqrt(shape) * (max(0.0, 1 + z / math.sqrt(shape)) ** (1 / 3) - 1 + 1 / (9 * shape)))
    plain = token.translate(str.maketrans("-_", "+/"))
    values = [symbols.index(c) + 1 for c in plain]
    if scan.ENCODINGS[name][1]:
        side = [v <= k // 2 for v in values]
        n1 = sum(side)
        mu = 2 * n1 * (n - n1) / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        count = 1 + sum(a != b for a, b in zip(side, side[1:], strict=False))
        runs = (n - 1) * math.log(2) if var <= 0 else two_sided((count - mu) / math.sqrt(var))
    else:
        kind = lambda c: (c.islower(), c.isupper(), c.isdigit())
        share = [sum(kind(c) == x for c in symbols) / k for x in {kind(c) for c in symbols}]
        s2, s3 = sum(q**2 for q in share), sum(q**3 for q in share)
        changes = sum(kind(a) != kind(b) for a, b in zip(token, token[1:], strict=False))
        runs = two_sided((changes - (n - 1) * (1 - s2)) / math.sqrt((n - 1) * s2 * (1 - s2) + 2 * (n - 2) * (s3 - s2**2)))
    mean = sum(values) / n
    down = sum((v - mean) ** 2 for v in values)
    r = sum((values[i] - mean) * (values[(i + 1) % n] - mean) for i in range(n)) / down if down else None
    serial = n if r is None else two_sided((r + 1 / (n - 1)) / (n / ((n - 1) * math.sqrt(n - 2))))
    total = uniform + runs + serial
    return total - math.log(1 + total + total**2 / 2)


def scored(spark, tokens):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    span = F.struct(F.lit(0).cast("long").alias("start"), F.length("t").cast("long").alias("end"))
    got = rows.select("i", scan._encoding(F.col("t")).alias("name"), scan._scored(span, F.col("t"), scan._encoding(F.col("t"))).alias("s")).collect()
    return {tokens[r.i]: r for r in got}


def drawn(rnd, name, n):
    while True:
        token = "".join(rnd.choice(ALPHABETS[name]) for _ in range(n))
        if encoding(token) == name:
            return token


def test_scores_match_the_definitions(spark):
    rnd = random.Random(11)
    tokens = [drawn(rnd, name, n) for name in ALPHABETS for n in (20, 23, 32, 47, 100) for _ in range(8)]
    tokens += ["CustomerReportFinalVersion2024", "a1" * 15, "0a" + "1" * 30, "my_variable_name_for_the_2nd_time", "A" * 20 + "b", "AbCdEfGhIjKlMnOpQrStUvWxYz012345"]
    for token, row in scored(spark, tokens).items():
        want = surprise(token) * scan.STEPS_PER_NAT
        assert row.name == encoding(token)
        assert want - 1.01 <= row.s.step <= want + 0.01 or row.s.step == scan.STEPS, (token, row, want)


@pytest.mark.parametrize("n", [20, 24, 40, 100])
def test_random_tokens_are_seldom_surprising(spark, n):
    rnd = random.Random(n)
    tokens = [drawn(rnd, name, n) for name in ALPHABETS for _ in range(400)]
    steps = [r.s.step for r in scored(spark, tokens).values()]
    for p in (0.1, 0.01, 0.001):
        assert sum(s >= -math.log(p) * scan.STEPS_PER_NAT for s in steps) <= 1.6 * p * len(steps) + 6


def prose(rnd, words):
    return " ".join(rnd.choice(words) for _ in range(60))


def test_planted_tokens_in_prose(spark):
    rnd = random.Random(5)
    root = "/root/testdata/sf0.01"
    texts = [r.text or "" for r in spark.read.parquet(f"{root}/documents.parquet").select("text").limit(300).collect()]
    kinds = [lambda: base64.b64encode(rnd.randbytes(30)).decode(), lambda: drawn(rnd, "alnum", 40), lambda: drawn(rnd, "base32", 32), lambda: "ghp_" + drawn(rnd, "alnum", 36), lambda: drawn(rnd, "small", 32), lambda: drawn(rnd, "alnum", 24)]
    names = ["ApplicationContextInitializer2", "getUserAccountBalanceFromCache", "2024-11-05-quarterly-report-final", "src/main/java/com/example/Main3", "TransactionManagerFactoryBean", "covid-19-vaccination-campaign"]
    rows, planted = [], {}
    for i, text in enumerate(texts):
        token = kinds[i % len(kinds)]() if i % 2 else names[i % len(names)] + str(i)
        at = rnd.choice([0, len(text)])
        rows.append((i, text[:at] + f" {token} " + text[at:]))
        planted[i] = (at + 1, at + 1 + len(token), i % 2)
    got = {r.doc_id: {(s.start, s.end) for s in r.spans if s.rank == 3} for r in scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    secrets = [i for i, p in planted.items() if p[2]]
    found = sum(planted[i][:2] in got[i] for i in secrets)
    wrong = sum(len(spans - {planted[i][:2]} if planted[i][2] else spans) for i, spans in got.items())
    print(f"recall {found / len(secrets):.3f}, wrong spans {wrong} in {len(rows)} documents")
    assert found >= 0.95 * len(secrets) and wrong <= 0.01 * len(rows)


WORDS = "get set user account balance from cache load file report final version index value name list map key token count page view model service manager factory bean context handler request response buffer stream reader writer query table column row total amount order item part price date time zone process task queue worker thread pool lock state event error check valid parse format string number".split()


def camel(rnd, low, high):
    while True:
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(3, 6))]
        name = words[0] + "".join(w.capitalize() for w in words[1:])
        if low <= len(name) <= high:
            return name


@pytest.mark.parametrize(("names", "secrets", "least"), [(2500, 0, 0.0), (1500, 500, 0.4), (300, 600, 0.7)])
def test_reports_hold_few_names(spark, names, secrets, least):
    """Identifiers of 20 to 30 characters, with and without random tokens of the same lengths among them."""
    rnd = random.Random(names)
    rows = [(i, camel(rnd, 20, 30), False) for i in range(names)] + [(names + i, drawn(rnd, rnd.choice(["alnum", "base64"]), rnd.randint(20, 30)), True) for i in range(secrets)]
    truth = {i: t for i, _, t in rows}
    got = [r.doc_id for r in scan.find_secrets(spark.createDataFrame([(i, f"see {t} now") for i, t, _ in rows], "doc_id long, text string")).collect() if any(s.rank == 3 for s in r.spans)]
    hits = sum(truth[i] for i in got)
    print(f"reported {len(got)}, of them names {len(got) - hits}, recall {hits / max(1, secrets):.3f}")
    assert len(got) - hits <= scan.FALSE_REPORTS * max(1, len(got)) + 1 and hits >= least * secrets
