"""Token counts of whole texts, by the tokenizers library in Arrow functions that return lengths only.

A byte-level pre-tokenizer never joins a blank with what stands before it, so a text may be cut before any blank that
follows a character other than white space: the pieces' counts add up to the text's. Long texts are cut there, equal
pieces are counted once in a portion, and pieces already counted are remembered up to a fixed number. Portions and the
library's batches are balanced by bytes. The added special token of the vocabulary holds no blank, so it is never cut.

Defined results: a null text counts as an empty one: no bytes, no tokens. A text without a safe boundary is counted as
one piece, whatever its length. Rows that repeat are counted each; a null doc_id stays null. An empty table gives an empty
result. Columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import spread

#: UTF-8 bytes of text in a portion, and of pieces in a call of the library.
PORTION, CALL = 2_000_000, 256_000
#: Counts of pieces that a task remembers; longer pieces aren't remembered.
KEPT, KEPT_CHARS = 250_000, 64
BOUNDARY = re.compile(r"(?<=\S)(?= )")


class Counter:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> dict[str, int]:
        pieces.sort(key=len)
        out, batch, total = {}, [], 0
        for i, piece in enumerate(pieces):
            batch.append(piece)
            total += len(piece.encode())
            if total >= CALL or i + 1 == len(pieces):
                out.update(zip(batch, map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)), strict=True))
                batch, total = [], 0
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        split = [BOUNDARY.split(t) if t else [] for t in texts]
        new = self.learn(list({p for ps in split for p in ps} - self.known.keys()))
        self.known.update(new)
        out = [sum(map(self.known.__getitem__, ps)) for ps in split]
        for piece in new:
            if len(piece) > KEPT_CHARS or len(self.known) > KEPT:
                del self.known[piece]
        return out


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        counter = _COUNTERS[path]
        for batch in batches:
            counts, sizes, texts = [], batch.column("n_bytes").to_pylist(), batch.column("text")
            lo = total = 0
            for hi, size in enumerate(sizes):
                if total and total + size > PORTION:
                    counts += counter.count(texts.slice(lo, hi - lo).to_pylist())
                    lo, total = hi, 0
                total += size
            counts += counter.count(texts.slice(lo).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        counter.known = {}  # the worker may wait for other tasks for long

    sized = spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
