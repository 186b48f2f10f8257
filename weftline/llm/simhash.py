"""Near-duplicate groups by SimHash and multi-index hashing.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, word 4-grams (repeats count) joined by
spaces, XXH64 of each in UTF-8 with seed 42; bit b is 1 when over half of the hashes have it. A
text of fewer words is one shingle; a text without words has fingerprint zero, which links like
any other. Null counts as empty.

Links: fingerprints are first made distinct, so copies never meet one another: one row per
distinct fingerprint goes on, with the smallest id that has it. The 64 bits are cut into m
segments. Two fingerprints within r = m a + b bits (b < m) agree within a bits in one of the first
b + 1 segments, or within a - 1 bits in one of the others; otherwise they differ in more than r
bits. So each fingerprint looks up, per segment, the whole Hamming ball of that radius around its
segment value in the table of (segment, value). The complete distance is verified inside the join,
and a pair is taken at the first segment that brings it up, from its smaller to its larger side
only: each link comes out once.

A ball of radius 2 is met halfway: both sides spell their ball of radius 1, and a pair counts only
where the asking side flipped the lowest differing bit, so it still comes out once. Three segments
(48 entries a fingerprint) cost least up to some 2^23 distinct fingerprints, two (100 entries in
far smaller buckets) beyond that. The choice changes the cost and not the result: the pigeonhole
argument holds for each m.

Components: large-star and small-star rounds over the links, each round a written table, until
nothing changes. Nodes with very many links, and fingerprints with very many copies, are split off
and joined by a broadcast of bounded size; nothing is gathered in one task or the driver.

Edge cases: rows may repeat and ids may be null (a null id is never the smallest id of a
component that has another); an empty table gives an empty result. A very long text is read whole
by its task, its hashes in blocks. Other columns are carried in one struct or not read, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.rows import column, packed, unpacked
from weftline.staging import discard, stage

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
#: From so many distinct fingerprints, 100 N entries are cheaper than 48 N that meet N / 2^21 others each.
TWO_SEGMENTS_FROM = 1 << 23
#: Hashes whose bits are unpacked at once; bounds the memory a very long text takes.
BLOCK = 1 << 15
#: A key with more than 1 / HUBS of all rows is joined by broadcast, so at most this many rows are.
HUBS = 1024


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    tokens = text.lower().split()  # bytes: lower() changes A-Z only, split() cuts at [\x20\x09-\x0D]+ only
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            found = np.fromiter((fingerprint(x or b"", words) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return run


def text_hash(text: Column) -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's bits as a signed long), one row per document."""
    read = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"), text_hash(column(text_col)).alias("text_hash"))
    return read.mapInArrow(_fingerprint_batches(words), "doc_id long, text_hash long, fp long")


def segments(distinct: int, max_bits: int = MAX_BITS) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment for a table of so many fingerprints."""
    m = 3 if max_bits > 1 and distinct < TWO_SEGMENTS_FROM else 2
    sizes = [64 // m + (i >= m - 64 % m) for i in range(m)]
    a, b = divmod(max_bits, m)
    firsts = [sum(sizes[:i]) for i in range(m)]
    return [(first, size, a if i <= b else a - 1) for i, (first, size) in enumerate(zip(firsts, sizes, strict=True)) if i <= b or a > 0]


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most `radius` of `bits` bits."""
    return [sum(1 << i for i in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def _segment(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _looked_up(distinct: DataFrame, parts: list[tuple[int, int, int]], name: str) -> DataFrame:
    """(`name`, seg, val, mask): all values in the balls around the segment values of each fingerprint."""
    masks = [(s, first, (1 << bits) - 1, mask) for s, (first, bits, radius) in enumerate(parts) for mask in ball(bits, radius)]
    listed = F.array(*[F.struct(F.lit(s).alias("seg"), F.lit(first).alias("first"), F.lit(ones).cast("long").alias("ones"), F.lit(mask).cast("long").alias("mask")) for s, first, ones, mask in masks])
    spelled = distinct.select(F.col("fp").alias(name), F.explode(listed).alias("e"))
    return spelled.select(name, F.col("e.seg").alias("seg"), F.col("e.mask").alias("mask"), F.expr(f"((shiftrightunsigned({name}, e.first)) & e.ones) ^ e.mask").alias("val"))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, parts: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """u, v: all pairs u < v of the distinct fingerprints in column fp within `max_bits` bits, each once."""
    parts = parts or segments(distinct.count(), max_bits)
    asked = _looked_up(distinct, [(first, bits, 1 if radius == 2 else radius) for first, bits, radius in parts], "u")
    held = _looked_up(distinct, [(first, bits, 1 if radius == 2 else 0) for first, bits, radius in parts], "v").drop("mask")
    differ = F.col("u").bitwiseXOR(F.col("v"))
    at = F.col("a.seg")
    verified = (F.col("u") < F.col("v")) & (F.bit_count(differ) <= max_bits)
    for s, (first, bits, radius) in enumerate(parts):  # met halfway: one of the middle values counts
        if radius == 2:
            here = _segment(differ, first, bits)
            verified &= (at != s) | (F.col("a.mask") == here.bitwiseAND(-here))
    for s, (first, bits, radius) in enumerate(parts[:-1]):  # an earlier segment within its radius has brought the pair up already
        verified &= (at <= s) | (F.bit_count(_segment(differ, first, bits)) > radius)
    return asked.alias("a").join(held.alias("h"), (at == F.col("h.seg")) & (F.col("a.val") == F.col("h.val")) & verified).select("u", "v")


def least_neighbours(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The (u, v) links with m, the least v of their u, and the staged (u, m, n) they were joined with.

    A node with more than 1 / HUBS of all links is a hub; there are fewer than HUBS of them, so they are
    broadcast and their links stay where they are. All other links meet their u by a shuffle.
    """
    low = stage(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    hub = F.col("n") > F.lit((edges.count()) / HUBS)
    hubs = F.broadcast(low.where(hub).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(low.where(~hub).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest), low


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of the (u, v) links; root is the smallest node of the component.

    Large-star then small-star per round (after Kiveris et al., 2014): the number of rounds grows
    with the logarithm of a component's size. A round's tables are deleted when the next one stands.
    """
    edges = stage(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = stage(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        met, low = least_neighbours(both)
        large = stage(met.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large")
        met, low_small = least_neighbours(large)
        small = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        older, edges = edges, stage(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        for done in (older, both, low, large, low_small):
            discard(done)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, text_hash, fp, component_id (the smallest id in the document's component), kept.

    The row with the smallest id of a component is kept; a row without id only where the component has no id.
    """
    rows = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash")).alias("first")
    distinct = stage(rows.groupBy("fp").agg(first, F.count("*").alias("n")), "distinct")
    linked = components(stage(links(distinct.select("fp"), max_bits), "links")).withColumnRenamed("node", "fp")
    member = stage(linked.join(distinct, "fp"), "members")
    groups = stage(member.groupBy("root").agg(F.min("first").alias("keeper"), F.count("*").alias("size")), "groups")
    large = F.col("size") > F.lit(member.count() / HUBS)  # components of very many fingerprints: fewer than HUBS, broadcast
    giants = F.broadcast(groups.where(large).drop("size"))
    of = member.join(giants, "root").unionByName(member.join(giants.select("root"), "root", "left_anti").join(groups.where(~large).drop("size"), "root")).select("fp", "keeper")
    named = stage(distinct.join(of, "fp", "left").select("fp", "n", F.coalesce("keeper", "first").alias("keeper")), "named")
    hot = F.col("n") > F.lit(rows.count() / HUBS)  # fingerprints of very many copies: fewer than HUBS, broadcast
    hubs = F.broadcast(named.where(hot).drop("n"))
    decided = rows.join(hubs, "fp").unionByName(rows.join(hubs.select("fp"), "fp", "left_anti").join(named.where(~hot).drop("n"), "fp"))
    kept = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_hash") == F.col("keeper.text_hash"))
    return decided.select("doc_id", "text_hash", "fp", F.col("keeper.doc_id").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Of each component one document stays (see `near_duplicates`), with all its columns.

    A row is known by its id and the hash of its text, so rows without id or with a common id are
    decided one by one; rows that repeat both stay or go together.
    """
    found = near_duplicates(docs, id_col, text_col, words, max_bits)
    gone = found.where(~F.col("kept")).select("doc_id", "text_hash").distinct().hint("merge").alias("gone")  # grows with the input: never broadcast
    held = docs.select(packed(docs), column(id_col).cast("long").alias("doc_id"), text_hash(column(text_col)).alias("text_hash")).alias("held")
    same = F.col("held.doc_id").eqNullSafe(F.col("gone.doc_id")) & (F.col("held.text_hash") == F.col("gone.text_hash"))
    return unpacked(held.join(gone, same, "left_anti"))
