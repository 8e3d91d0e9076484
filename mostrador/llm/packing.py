"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

The classes are the reciprocals 1, 1/2, 1/4, ... of the capacity. A document is cut into full sequences and, for the
rest, one piece for each binary digit of its length, so that every piece has exactly its class's length and a bin of
class 1/k is full with k pieces. Each task fills its own bins; what is left of a class at its end becomes sequences
whose length is a power of two. No sequence needs padding.

Null texts are empty documents (the terminator alone). Documents without an id, repeated ids and equal rows are each
packed on their own. An empty table gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import columns, emit

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

CHUNK = 1 << 20
# A word boundary at which the vocabulary's own pattern always cuts: letter, one space, letter.
SAFE_CUT = re.compile(r"(?<=[a-z]) (?=[a-z])")
# Beyond Latin letters the two libraries' character classes might differ; such texts take the slower one.
OTHER_SCRIPT = re.compile("[^\\x00-\\u024f]")
LONG_RUN = re.compile(r"\S{2000}")


class Encoder:
    """Ids of the vocabulary file ``<name>.json``.

    ``tokenizers`` reads that file; the same ranks in ``<name>.tiktoken`` give the same ids several times as fast, and
    are used where a text is Latin, names no special token and has no run long enough to matter for time.
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def chunk(self, text: str) -> list[int]:
        plain = self.fast and not OTHER_SCRIPT.search(text) and not LONG_RUN.search(text) and not any(s in text for s in self.special)
        return self.fast.encode_ordinary(text) if plain else self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a whole text, chunk by chunk; chunks end where the pattern cuts anyway."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > CHUNK and (cut := SAFE_CUT.search(text, at + CHUNK)):
                end = cut.start()
            yield np.array(self.chunk(text[at:end]), dtype="<u4")
            at = end


class Bins:
    """Open bins of one task, one list of pieces a class; bounded by the capacity."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {capacity >> k: [] for k in range(capacity.bit_length())}

    def sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for piece in pieces:
            yield (*piece, self.next_id, offset)
            offset += piece[2]
        self.next_id += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        held = self.open[piece[2]]
        held.append(piece)
        if len(held) * piece[2] == self.capacity:
            yield from self.sequence(held)
            self.open[piece[2]] = []

    def close(self) -> Iterator[tuple]:
        for held in self.open.values():
            at = 0
            for k in reversed(range(len(held).bit_length())):
                if len(held) >> k & 1:
                    yield from self.sequence(held[at: at + (1 << k)])
                    at += 1 << k


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Full sequences, then one piece for each binary digit of the rest, longest first."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << k for k in reversed(range(capacity.bit_length())) if rest >> k & 1]


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = 1024, terminator: int = 0,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece; ``ids`` holds its ids as little-endian unsigned 32-bit numbers.

    ``capacity`` is a power of two. One pass over the table without a shuffle: sequences never cross tasks, so the work
    and a retry are local to one input split. Ids of sequences start at the task's number times 2**40.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        def rows() -> Iterator[tuple]:
            encoder = Encoder(json_path, ranks_path)
            bins = Bins(capacity, TaskContext.get().partitionId() << 40)
            for doc_id, text in columns(batches):
                ids = np.concatenate([*encoder.ids(text or ""), np.array([terminator], dtype="<u4")])
                start = 0
                for length in piece_lengths(len(ids), capacity):
                    yield from bins.add((doc_id, start, length, ids[start: start + length].tobytes(), len(ids)))
                    start += length
            yield from bins.close()

        yield from emit(rows(), ARROW, 4000)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, SCHEMA)
