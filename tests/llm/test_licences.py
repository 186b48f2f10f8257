"""The licence scan against a plain-Python twin, and its figures on planted notices."""

import random
import re

import numpy as np

from weftline.llm import licences as scan

PLACE, WEIGHTS, BIAS, BOUND = scan.model()
KNOWN = [(k, grams) for k, family in enumerate(scan.FAMILIES) if k for grams in scan.template_grams(family)]
ALL = {g for _, grams in KNOWN for g in grams}


def threes(words):
    return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {" ".join(words)}


def holds(words):
    return any(" ".join(words[i : i + n]) in ALL for n in (1, 2, 3) for i in range(len(words) - n + 1))


def joined(text):
    return re.sub(scan.WRAPPED, " ", re.sub(scan.HYPHENATED, "-", text))


def judged(words):
    logits = BIAS + sum((WEIGHTS[PLACE[g]] for g in scan.grams_of(words) if g in PLACE), np.zeros(len(BIAS)))
    p = np.exp(logits - logits.max())
    p /= p.sum()
    k, own = int(p.argmax()), threes(words)
    hits = {f: len({g for j, grams in KNOWN if j == f for g in grams} & own) for f in range(1, len(scan.FAMILIES))}
    whole = max((len(grams & own) / len(grams) for j, grams in KNOWN if j == k), default=0.0)
    contained = max(hits.get(k, 0) / len(own), whole)
    return k, k > 0 and p.max() >= BOUND and contained >= scan.CONTAINED, hits


def twin(text):
    text, families, n_windows, n_confirmed = text or "", set(), 0, 0
    for paragraph in re.split(scan.PARAGRAPH_END, text):
        main = [judged(w) for w in scan.cuts(scan.words_of(joined(paragraph))) if holds(w)]
        of_unit = {k for k, sure, _ in main if sure}
        parts = []
        for split in (re.split(scan.LINE_END, paragraph), re.split(scan.SENTENCE_END, joined(paragraph))):
            parts += split if len(split) > 1 else []
        pieces = []
        for words in map(scan.words_of, parts):
            pieces += [words] if words not in pieces else []
        for k, sure, hits in (judged(w) for words in pieces for w in scan.cuts(words) if holds(w)):
            if sure and not any(hits[f] >= scan.CONTAINED * hits[k] for f in of_unit):
                main.append((k, sure, hits))
        n_windows += len(main)
        n_confirmed += sum(sure for _, sure, _ in main)
        families |= {scan.FAMILIES[k] for k, sure, _ in main if sure}
    return n_windows, n_confirmed, tuple(sorted(families))


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_windows, r.n_confirmed, tuple(r.families)) for r in scan.scan_licences(rows).collect()}


def corpus(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_scan_equals_its_twin(spark):
    rnd = random.Random(6)
    sentences = [s for group in scan.TEMPLATES.values() for s in group] + list(scan.OTHERS)
    texts = corpus(spark)[:60] + sentences + [None, "", "\n\n\n", "word " * 30_000, "mit", "spdx-license-identifier: mit"]
    for _ in range(150):  # paragraphs of notices, counter-sentences and words, wrapped and commented at random
        parts = rnd.choices(sentences, k=rnd.randrange(1, 5)) + [" ".join(rnd.choices(["alpha", "beta", "gamma-", "delta.", "x-\n"], k=rnd.randrange(0, 30)))]
        rnd.shuffle(parts)
        text = rnd.choice([" ", "\n", "\n\n"]).join(parts)
        texts.append("".join(rnd.choice(["\n", "\n * ", "\r\n# "]) if c == " " and rnd.random() < 0.08 else c for c in text))
    got = scanned(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == twin(text), (text, got[i], twin(text))


def test_a_hyphen_at_a_line_end_hides_no_notice(spark):
    texts = ["intro x-\nSPDX-License-Identifier: MIT", "end of a paragraph-\n\nSPDX-License-Identifier: MIT", "SPDX-License-Identifier: MIT"]
    got = scanned(spark, texts)
    assert all(got[i] == twin(t) and got[i][2] == ("MIT",) for i, t in enumerate(texts))


def test_calibration_rows_are_unseen():
    train, held = scan.fitting_rows()
    assert not {w for w, _ in train} & {w for w, _ in held}
    others = [tuple(scan.words_of(s)) for s in scan.OTHERS[::3]]
    assert not [w for w, k in train if k == 0 and w in others]
    assert len([1 for _, k in held if k == 0]) > 50 and len([1 for _, k in held if k > 0]) > 100


def test_every_template_is_found_and_no_counter_sentence(spark):
    notices = [(family, s) for family, group in scan.TEMPLATES.items() for s in group]
    got = scanned(spark, [s for _, s in notices] + list(scan.OTHERS))
    assert all(family in got[i][2] for i, (family, _) in enumerate(notices))
    assert all(got[len(notices) + i][2] == () for i in range(len(scan.OTHERS)))


def test_recall_and_precision_on_documents(spark):
    rnd = random.Random(9)
    texts = [t for t in corpus(spark) if t and not re.search("(?i)licen|rights reserved", t)]
    notices = [(family, s) for family, group in scan.TEMPLATES.items() for s in group]
    planted, rows = {}, []
    for i, text in enumerate(texts):
        if i % 2:
            family, s = notices[i // 2 % len(notices)]
            words = s.split()
            if len(words) > 8:  # a word lost, and wrapped
                words.pop(rnd.randrange(len(words)))
                words.insert(len(words) // 2, "\n//")
            planted[i], text = family, text + rnd.choice(["\n", "\n\n", " "]) + " ".join(words)
        rows.append(text)
    got = scanned(spark, rows)
    recall = sum(planted[i] in got[i][2] for i in planted) / len(planted)
    wrong = sum(bool(set(got[i][2]) - {planted.get(i)}) for i in got)
    print(f"recall {recall:.3f} of {len(planted)}, documents with a wrong family {wrong} of {len(rows)}")
    assert recall >= 0.9 and wrong <= 0.03 * len(rows)
