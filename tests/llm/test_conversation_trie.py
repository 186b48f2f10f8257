"""The trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

from weftline.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string, part string, place string"


def brute(rows):
    turns = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    for c, n, r, t in sorted(((c, -1 if n is None else n + 1, r or "", t or "") for c, n, r, t in rows if c is not None), key=lambda x: (x[0], x[1], x[2], digest(x[2], x[3]))):
        turns.setdefault(c, []).append((r, t))
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    nodes = {}
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members) for n in below)
        children = sum(len(n) == len(node) + 1 for n in below)
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        nodes[node] = (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(nodes.values(), key=repr)


def built(spark, rows, parts=None):
    turns = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)
    found = conversation_trie.trie(*conversation_trie.rebuilt(conversation_trie.numbered_turns(turns, parts=parts)))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_random_conversations(spark):
    rng = random.Random(13)
    rows = [(c, n, rng.choice(["user", "bot", None]), rng.choice(["", "é", "hello", None, "🙂 x"])) for c in rng.sample(range(-30, 400), 150) for n in range(rng.randrange(0, 12))]
    assert built(spark, rows) == brute(rows)
    assert built(spark, rows, parts=7) == brute(rows)  # conversations cut between parts


def test_copies_and_a_common_first_turn(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "HUBS", 4)
    rows = [(c, n, "user", t) for c in range(0, 900) for n, t in enumerate(["hi", "x" if c % 3 else f"y{c}", "z"])]
    assert built(spark, rows) == brute(rows)


def test_rows_of_all_shapes(spark):
    rows = [(None, 1, "a", "b"), (7, None, "a", "first"), (7, 0, "a", "second"), (7, 0, "a", "second"), (7, 0, None, None), (3, 5, "u", "t"), (12, 1, "q", "long " * 50_000), (-3, 1, "u", "v"), (0, 2, "u", "v"), (0, 1, "u", "w")]
    rows += [(25, n, "user", f"t{n % 7}") for n in range(3000)]  # one long conversation
    assert built(spark, rows[:10]) == brute(rows[:10])
    long = [r for r in built(spark, rows, parts=5) if r[0] == 25]
    assert len(long) == 3000 and all(r[2] in (-3, 25) for r in long) and sorted(r[1] for r in long) == list(range(1, 3001))
    assert sum(r[5] for r in long if r[1] == 3000) == 1 and {r[6] for r in long} == {0}


def test_empty_tables_and_turnless_conversations(spark):
    assert built(spark, []) == []
    short = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:3]
    rows = [(c, 0, "u", "t") for c in short]
    assert built(spark, rows) == brute(rows) == [(min(short), 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, short)).encode()).hexdigest())]
