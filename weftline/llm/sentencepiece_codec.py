"""SentencePiece encoding and decoding with a distinct-chunk table.

In the model's vocabulary no piece has a whitespace marker after another character (checked when
the model is loaded), so no merge crosses the start of a run of markers. A text is cut before each
run; each distinct chunk is segmented once by the library and its ids are joined back by position.
A literal U+2581 in a text is the marker itself, so it is cut like a space.

The table of distinct chunks is kept per task, bounded by `TABLE_ROWS`, and filled per Arrow batch
with one call for all chunks that are new. A table for the whole corpus would have to shuffle each
distinct chunk of each document there and back, measured at 2.3 times the input each way; the
task's table gives the same ids, as the ids of a chunk depend on nothing else.

Edge cases: a null or empty text has no ids and decodes to the empty text. White space is kept by
the model (no trimming, no collapsing), tabs and line ends stay inside their chunk. Chunks longer
than `LONGEST_KEPT` bytes are segmented but not kept. Rows may repeat; an empty table gives an
empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.rows import column

TABLE_ROWS, LONGEST_KEPT = 300_000, 96
MARK = "▁"
#: A run of spaces and the characters up to the next one.
CHUNK = re.compile(r" +[^ ]*")


class Codec:
    """Encodes and decodes texts chunk by chunk; equal to the library's own encode and decode."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size()))
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
            raise ValueError("this model has pieces across whitespace markers; chunks cannot be segmented alone")
        #: chunk without its first space -> (number of ids, ids joined by commas, decoded text)
        self.table: dict[str, tuple[int, str, str]] = {}
        #: A single space at the end of a text: the library would take an empty chunk for an empty text.
        self.last_space = {"": (1, str(self.processor.piece_to_id(MARK)), "")}

    def chunks(self, text: str) -> list[str]:
        """The chunks without their first space. The model puts one marker before the text."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if text[0] != " " and text[-1] != " " and "  " not in text:
            return text.split(" ")
        return [chunk[1:] for chunk in CHUNK.findall(" " + text)]

    def fill(self, chunks: set[str]) -> dict[str, tuple[int, str, str]]:
        """Segment the chunks that the table lacks. Returns a table that has all of them."""
        chunks = chunks - self.last_space.keys()
        new = sorted(chunks.difference(self.table))
        if len(self.table) + len(new) > TABLE_ROWS:
            self.table = {}
            new = sorted(chunks)
        ids = self.processor.encode(new, num_threads=1)
        found = dict(zip(new, zip(map(len, ids), (",".join(map(str, x)) for x in ids), self.processor.decode(ids) if ids else [], strict=True), strict=True))
        self.table.update((k, v) for k, v in found.items() if len(k) <= LONGEST_KEPT)
        self.table.update(self.last_space)
        return self.table | found if any(len(k) > LONGEST_KEPT for k in found) else self.table

    def encode(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, str]]]:
        """The table rows of each text's chunks, in order."""
        cut = [self.chunks(x or "") for x in texts]
        table = self.fill(set().union(*cut))
        for chunks in cut:
            yield [table[c] for c in chunks]


def token_ids(rows: list[tuple[int, str, str]]) -> str:
    """All ids of a text as decimal numbers joined by commas."""
    return ",".join([r[1] for r in rows])


def decoded(rows: list[tuple[int, str, str]]) -> str:
    """The text that decoding all ids gives."""
    return " ".join([r[2] for r in rows])


def _per_batch(model: bytes, of_rows, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                columns = list(zip(*map(of_rows, codec.encode(part.column(1).to_pylist())), strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", *names])

    return run


def _digest(rows: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    return sum([r[0] for r in rows]), hashlib.sha256(token_ids(rows).encode()).hexdigest(), hashlib.sha256(decoded(rows).encode()).hexdigest()


def _whole(rows: list[tuple[int, str, str]]) -> tuple[list[int], str]:
    ids = token_ids(rows)
    return [int(x) for x in ids.split(",")] if ids else [], decoded(rows)


def _run(docs: DataFrame, model: bytes, id_col: str, text_col: str, of_rows, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    pair = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return pair.mapInArrow(_per_batch(model, of_rows, names, types), f"doc_id long, {schema}")


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string of each document. `model` is the content of a model file."""
    return _run(docs, model, id_col, text_col, _whole, ["ids", "decoded"], [pa.list_(pa.int32()), pa.string()], "ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return _run(docs, model, id_col, text_col, _digest, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], "n_tokens long, ids_sha256 string, decoded_sha256 string")
