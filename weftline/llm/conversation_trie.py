"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of the first d turns (role, text) of the conversations; the root is
the empty sequence. The smallest conversation through a node owns it. Members only leave on the way
down, so what a conversation owns is a suffix of its own path, and two facts about each
conversation c say it all: the depth `first` at which its suffix begins and the tokens it has read
before that depth.

Let T(c, d) be the tokens of c's turns from depth d on and O(c, d) those of them that stand in nodes
c owns. Each node below v is owned by one member of v, so over the members c of v

    saved tokens of v's subtree = sum of T(c, d) - O(c, d),
    leaves of v's subtree       = sum of [c owns a childless node],
    children of v               = sum of [first(c) <= d + 1 <= length of c],

and one group-by on prefixes gives all three. No node is ever joined with its descendants.

The plan, none of whose steps brings a whole conversation or a whole node into one task:

1. turns are dealt by ranges of (conv_id, turn, role, digest), so a conversation of any length is cut
   in parts; places are counted inside parts, and what lies before a part is added from a table of
   (conversation, part). Texts do not go beyond this step: a turn is its SHA-256 and its tokens;
2. a prefix is known by the exclusive-or of two 64-bit hashes of (place, turn) up to it: it is that
   of a set of numbered turns, so it can be summed in parts like a count;
3. a group-by on prefixes finds each node's owner and what leads to it (map-side combined, so a
   node that all conversations share is cheap), a second one on owners the suffix of each;
4. the facts of a conversation go back to its parts, and the group-by on prefixes sums them;
5. a node's parent belongs to the same owner, but for the first node of a suffix: one look-up a
   conversation. Nodes on which very many suffixes begin are split off and broadcast (at most HUBS);
6. the ids of the conversations that end at a node are joined in runs of 256 ids, and a node's runs,
   in order, are fed to SHA-256 one at a time: its state has a fixed size, however many end there.

Edge cases: rows without conv_id take no part; a null turn comes first; turns of one number come by
role and then by their digest, and repeated rows are turns of their own; null roles and texts are
empty; a conversation may have no turn (it is a member of the root). An empty table gives an empty
result. A very long text is read once, by its own row. Only the named columns are read, so others
cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.rows import column
from weftline.staging import stage

#: A node on which more than 1 / HUBS of all suffixes begin is joined by broadcast, so at most this many rows are.
HUBS = 1024
#: Ids joined to one string before they are hashed.
RUN_BITS = 8
EMPTY_SHA256 = hashlib.sha256().hexdigest()
KEY = ["depth", "k1", "k2"]


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """conv_id, part, place (from 1), digest, tokens of each turn; tokens are the UTF-8 bytes of its text.

    Within a part the places of one conversation follow one another, and parts are in order.
    """
    role, text = F.coalesce(column(role_col), F.lit("")), F.coalesce(column(text_col), F.lit(""))
    read = turns.select(
        column(conv_col).cast("long").alias("conv_id"),
        column(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("tokens"),
        F.monotonically_increasing_id().alias("row_no"),
    ).where("conv_id IS NOT NULL")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("row_no")]
    dealt = read.repartitionByRange(parts, *order) if parts else read.repartitionByRange(*order)
    dealt = stage(dealt.withColumn("part", F.spark_partition_id()), "turns")
    inside = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order[1:]))
    before = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = before.select("conv_id", "part", _earlier(F.sum("n"), "part").alias("before"))
    return dealt.withColumn("inside", inside).join(before, ["conv_id", "part"]).select("conv_id", "part", (F.col("before") + F.col("inside")).alias("place"), "digest", "tokens")


def _earlier(total: Column, order: str) -> Column:
    """`total` over a conversation's rows before this one; 0 before the first."""
    return F.coalesce(total.over(W.partitionBy("conv_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))


def rebuilt(turns: DataFrame, family: int = 5, longest_head: int = 8) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with its first h turns replaced by those of conversation c - c % family.

    h is the unsigned CRC-32 of the id's decimal digits modulo longest_head + 1. Gives the turns as
    `numbered_turns` does, and the conversations (conv_id), those without any turn included. At most
    longest_head turns of a conversation go to at most 2 family - 1 others.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % (longest_head + 1)
    convs = stage(turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", head), "convs")
    based = convs.select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    heads = turns.where(F.col("place") <= longest_head).withColumnRenamed("conv_id", "base")
    taken = based.join(heads, "base").where("place <= h").select("conv_id", F.lit(-1).alias("part"), "place", "digest", "tokens")
    length = F.least("h", F.coalesce("base_n", F.lit(0)))
    shift = based.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").select("conv_id", "h", (length - F.col("h")).alias("shift"))
    parts = turns.groupBy("conv_id", "part").agg(F.lit(1).alias("one")).drop("one").join(shift, "conv_id")  # a long conversation meets its shift part by part
    own = turns.join(parts, ["conv_id", "part"]).where("place > h").select("conv_id", "part", (F.col("place") + F.col("shift")).alias("place"), "digest", "tokens")
    return stage(taken.unionByName(own), "rebuilt"), convs.select("conv_id")


def occurrences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each turn as the last one of a prefix, and the (conv_id, part) pairs with the conversation's length and tokens.

    conv_id, part, depth, k1, k2 (the prefix), p1, p2 (the prefix without its last turn), tokens, before (tokens before the last turn).
    """
    lanes = turns.select("conv_id", "part", "place", "tokens", F.xxhash64("place", "digest").alias("l1"), F.xxhash64("digest", "place").alias("l2"))
    parts = lanes.groupBy("conv_id", "part").agg(F.bit_xor("l1").alias("t1"), F.bit_xor("l2").alias("t2"), F.sum("tokens").alias("in_part"), F.max("place").alias("top"))
    every = W.partitionBy("conv_id")
    carried = stage(
        parts.select("conv_id", "part", _earlier(F.bit_xor("t1"), "part").alias("c1"), _earlier(F.bit_xor("t2"), "part").alias("c2"), _earlier(F.sum("in_part"), "part").alias("c_tokens"), F.max("top").over(every).alias("length"), F.sum("in_part").over(every).alias("total")),
        "parts",
    )
    running = W.partitionBy("conv_id", "part").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = lanes.select("conv_id", "part", "place", "tokens", "l1", "l2", F.bit_xor("l1").over(running).alias("r1"), F.bit_xor("l2").over(running).alias("r2"), F.sum("tokens").over(running).alias("read"))
    k1, k2 = F.col("r1").bitwiseXOR(F.col("c1")), F.col("r2").bitwiseXOR(F.col("c2"))
    before = F.col("c_tokens") + F.col("read") - F.col("tokens")
    found = summed.join(carried.select("conv_id", "part", "c1", "c2", "c_tokens", "length"), ["conv_id", "part"])
    found = found.select("conv_id", "part", F.col("place").alias("depth"), k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("l1")).alias("p1"), k2.bitwiseXOR(F.col("l2")).alias("p2"), "tokens", before.alias("before"), (F.col("place") == F.col("length")).alias("ends"))
    return stage(found, "occurrences"), carried.select("conv_id", "part", "length", "total")


def owners(found: DataFrame) -> DataFrame:
    """conv_id, first (depth of its first own node), before (tokens read until there), p1, p2 (the prefix it leaves), leaf (1 if it owns a childless node), of conversations that own a node."""
    same = [F.first(c).alias(c) for c in ("p1", "p2", "before")]  # one value to a prefix
    nodes = found.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.sum(F.col("ends").cast("long")).alias("ended"), *same)
    top = F.min(F.struct("depth", "before", "p1", "p2")).alias("top")
    suffixes = nodes.groupBy("conv_id").agg(top, F.max((F.col("n") == F.col("ended")).cast("long")).alias("leaf"))
    return suffixes.select("conv_id", F.col("top.depth").alias("first"), "top.before", "top.p1", "top.p2", "leaf")


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, depth, ids) sorted by node and run: one digest a node."""
    names = ["depth", "k1", "k2", "ends_sha256"]
    last, state = None, None
    for batch in batches:
        out = []
        for depth, k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (depth, k1, k2) != last:
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = (depth, k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, state.hexdigest())], names)


def end_digests(ended: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2), the node at which each conversation ends, to depth, k1, k2, ends_sha256."""
    runs = ended.groupBy(*KEY, F.shiftright("conv_id", RUN_BITS).alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "run").select(*KEY, "ids").mapInArrow(_hash_runs, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` as `numbered_turns` gives them; `convs` has the conv_id of every conversation once.
    """
    found, parts = occurrences(turns)
    found = found.withColumn("depth", F.col("depth").cast("long"))
    suffix = stage(owners(found), "suffixes")
    # what a member brings to each of its nodes; one that owns nothing has read all its tokens in nodes of others
    lengths = parts.groupBy("conv_id").agg(F.max("length").alias("length"), F.max("total").alias("total"))
    facts = stage(
        convs.join(lengths, "conv_id", "left")
        .join(suffix.select("conv_id", "first", F.col("before").alias("shared"), "leaf"), "conv_id", "left")
        .select("conv_id", F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.coalesce("first", F.col("length") + 1, F.lit(1)).cast("long").alias("first"), F.coalesce("shared", "total", F.lit(0)).alias("shared"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")),
        "facts",
    )
    told = found.join(parts.select("conv_id", "part").join(facts, "conv_id"), ["conv_id", "part"])
    depth = F.col("depth")
    sums = [
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(((F.col("first") <= depth + 1) & (depth < F.col("length"))).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(depth < F.col("first"), F.col("shared") - F.col("before")).otherwise(0)).alias("saved_tokens"),
    ]
    nodes = stage(told.groupBy(*KEY).agg(*sums), "nodes")
    zero = F.lit(0).cast("long")
    of_root = facts.select("conv_id", zero.alias("depth"), "length", "first", "shared", "leaf", zero.alias("before")).agg(*sums).where("n_convs > 0")
    root = of_root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"), "saved_tokens")
    nodes = stage(nodes.unionByName(root), "all_nodes")
    # parents: the node a suffix leaves, one look-up a conversation
    left = suffix.select(F.col("conv_id").alias("owner"), "first", (F.col("first") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    begins = stage(left.groupBy(*KEY).agg(F.count("*").alias("begun")).join(nodes.select(*KEY, F.col("conv_id").alias("parent")), KEY), "left_nodes")
    hot = F.col("begun") > F.lit(suffix.count() / HUBS)
    hubs = F.broadcast(begins.where(hot).drop("begun"))
    met = left.join(hubs, KEY).unionByName(left.join(hubs.select(*KEY), KEY, "left_anti").join(begins.where(~hot).drop("begun"), KEY))
    parents = met.select(F.col("owner").alias("conv_id"), "first", "parent")
    # an owner's nodes are a suffix of its path: only the first of them has another owner's node above it
    named = nodes.join(parents.withColumn("depth", F.col("first")).select("conv_id", "depth", "parent"), ["conv_id", "depth"], "left")
    parent = F.when(depth > 0, F.coalesce("parent", "conv_id"))
    ended = found.where("ends").select("conv_id", *KEY).unionByName(facts.where("length = 0").select("conv_id", *[zero.alias(c) for c in KEY]))
    out = named.withColumn("parent_conv_id", parent).join(end_digests(ended), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
