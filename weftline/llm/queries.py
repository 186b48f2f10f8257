"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import conversation_trie, exact_dedup, hard_negatives, licences, mixing, personal_data, quality_model, quality_rules, secret_scan, sentencepiece_codec, sharding, simhash, token_shards
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; WEFTLINE_TOKENIZERS names another folder."""
    if folder := os.environ.get("WEFTLINE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    """The pattern by which the public byte-level tokenizer cuts words before merging."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


OP1_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
     n AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n
"""


@registry.add("op1_exact_dedup", OP1_SQL)
def op1_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, root, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@registry.add("op2_licences")
def op2_licences(spark: SparkSession, root: str) -> DataFrame:
    found = licences.scan_licences(table(spark, root, "documents"))
    return found.select("doc_id", "n_windows", "n_confirmed", "n_unknown", F.array_join("families", ",").alias("families"))


@registry.add("op3_token_shards")
def op3_token_shards(spark: SparkSession, root: str) -> DataFrame:
    written = token_shards.sequences(table(spark, root, "documents"), read_bytes(tokenizer_file("byte_bpe_50k.tiktoken")), word_pattern())
    return token_shards.training_order(written)


@registry.add("op4_mixing", None)
def op4_mixing(spark: SparkSession, root: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized(table(spark, root, "documents")))
    return mixing.taken(mixed).select("doc_id", "size", "source_size", "target", "taken")


@registry.add("op5_secrets")
def op5_secrets(spark: SparkSession, root: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, root, "documents"))
    counts = [secret_scan.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.spelled(F.col("base")), 256).alias("base_sha256"), secret_scan.spelled(F.col("spans")).alias("spans"))


@registry.add("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    judged = quality_rules.judge(docs, quality_rules.learn_rules(docs, table(spark, root, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@registry.add("op7_simhash_groups")
def op7_simhash_groups(spark: SparkSession, root: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, root, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@registry.add("op8_sharding")
def op8_sharding(spark: SparkSession, root: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, root, "documents"))
    return placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@registry.add("op9_quality_model")
def op9_quality_model(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    scored = quality_model.score(docs, *quality_model.train(docs, table(spark, root, "labels")))
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@registry.add("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, root: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, root, "documents"), read_bytes(tokenizer_file("piece_bpe_32k.model")))


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score QUALIFY rank <= 10
"""


@registry.add("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.prepared(vectors.select("vec_id", "embedding", label.alias("label"))))


@registry.add("op12_personal_data")
def op12_personal_data(spark: SparkSession, root: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, root, "documents"))
    counts = [personal_data.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in personal_data.BASE]
    return found.select("doc_id", *counts, F.sha2(personal_data.spelled(F.col("base")), 256).alias("base_sha256"), personal_data.spelled(F.col("spans")).alias("spans"))


OP13_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL),
     o AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY place) AS turns FROM t GROUP BY conv_id),
     h AS (SELECT *, (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, b: list_reduce(list_prepend(xor(crc, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) .xor(4294967295)) % 9 AS h FROM o),
     r AS (SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns FROM h c LEFT JOIN h b ON b.conv_id = c.conv_id - c.conv_id % 5),
     p AS (SELECT conv_id, d, sha256(to_json(list_slice(turns, 1, d))::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(to_json(list_slice(turns, 1, d - 1))::VARCHAR) END AS pk, coalesce(strlen(turns[d].t), 0) AS b, d = len(turns) AS ends
           FROM r, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
     n AS (SELECT d, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, k),
     c AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
     w AS (SELECT DISTINCT a.d AS top_d, a.k AS top_k, b.d, b.k FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.d <= b.d),
     s AS (SELECT top_d AS d, top_k AS k, sum((n.n - 1) * n.b)::BIGINT AS saved_tokens, (count(*) - count(c.n_children))::BIGINT AS n_leaves FROM w JOIN n ON w.d = n.d AND w.k = n.k LEFT JOIN c ON w.d = c.d AND w.k = c.k GROUP BY top_d, top_k)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s USING (d, k) LEFT JOIN c USING (d, k) LEFT JOIN n q ON q.d = n.d - 1 AND q.k = n.pk
"""


@registry.add("op13_conversation_trie", OP13_SQL)
def op13_conversation_trie(spark: SparkSession, root: str) -> DataFrame:
    return conversation_trie.trie(*conversation_trie.rebuilt(conversation_trie.numbered_turns(table(spark, root, "conversations"))))
