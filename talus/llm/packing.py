"""Packing whole documents into sequences of a fixed number of tokens, in their order, by dynamic programming over cuts.

The ids of the documents of a portion of the table stand one after the other, each document with an end id. A sequence is the
stretch between two cuts. Cuts may lie at the ends of documents, at the ends of sentences, and, if no such end lies just before, at one
full sequence after an end, or several where ends lie farther apart. A cut costs nothing at the end of a document,
`SENTENCE` at the end of a sentence and `INSIDE` elsewhere; a sequence costs its padding, and `EACH`. Padding is what the
sequence lacks of `size`, and nothing if its length is a power of two. For a cut at p the best last one q >= p - size has the least
cost(q) + q, a minimum over a sliding window, which a monotone queue gives; lengths that are powers of two are looked up by
their exact places. So the time is linear in the number of places, and the memory is a portion's ids.

Nothing is shuffled: each task packs its rows in the table's order, and sequences don't cross tasks or portions. Of the 1,000,000
ids at least in a portion, one sequence may end early. Sequence ids are the task's number and a count, so they are unique; another
split of the table gives another packing of the same ids.

Ids are those of the tokenizers library. Texts go through tiktoken on the same vocabulary, which is several times faster and gives the
same ids: a test compares all code points, and long runs with and without white space.

Defined results: a null or empty text is the end id alone. Rows that repeat are packed each, and a null doc_id stays null. A text of
any length is packed whole. Of plans that cost the same, the one whose last sequence is shorter is taken, at each cut. An empty table gives
no pieces. Columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, END = 1024, 0
#: Costs in tokens of padding.
SENTENCE, INSIDE, EACH = 4, 16, 4
#: Ids in a portion at least.
PORTION = 1_000_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of a text as an array, and which ids end a sentence."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        self.ends[[i for token, i in ranks.items() if token.rstrip().endswith((b".", b"!", b"?")) or b"\n" in token]] = True

    def ids(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, allowed_special="all")


def places(ends: np.ndarray, sentences: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may lie, rising, and what a cut costs there. `ends` and `sentences` are the ends of documents and sentences, rising."""
    soft = np.union1d(np.append(0, ends), sentences)
    cost = np.full(len(soft), SENTENCE)
    cost[np.searchsorted(soft, np.append(0, ends))] = 0
    full = [soft[:-1] + size]
    for g in np.flatnonzero(np.diff(soft) > size):
        starts = soft[np.searchsorted(soft, soft[g] - size, "right") : g + 1]
        steps = (starts[:, None] + size * np.arange(2, (soft[g + 1] - soft[g]) // size + 2)).ravel()
        full.append(steps[steps < soft[g + 1]])
    inside = np.unique(np.concatenate(full)) if len(full) > 1 else full[0]
    inside = inside[inside < soft[-1]]
    # An end so near before it costs no more than the place inside.
    inside = inside[inside - soft[np.searchsorted(soft, inside, "right") - 1] > min(INSIDE - SENTENCE, size // 8)]
    at = np.append(soft, inside)
    order = np.argsort(at, kind="stable")
    return at[order], np.append(cost, np.full(len(inside), INSIDE))[order]


def cheapest_cuts(at: np.ndarray, cost: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The ends of the sequences, rising, of the cheapest way from the first place to the last."""
    # Pairs of places between which a sequence needs no padding, by their later place.
    later, earlier = [], []
    for power in (1 << k for k in range((size - 1).bit_length())):
        found = np.minimum(np.searchsorted(at, at - power), len(at) - 1)
        j = np.flatnonzero(at[found] == at - power)
        later.append(j)
        earlier.append(found[j])
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later, kind="stable")
    later, earlier, x = [*later[order].tolist(), -1], earlier[order].tolist(), 0
    at, cost = at.tolist(), cost.tolist()
    total, came = [0] * len(at), [0] * len(at)
    keys, queue, head = [at[0]], [0], 0  # total + place, rising; the queue's places
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[head]] < p - size:
            head += 1
        best, last = keys[head] + size - p, queue[head]
        while later[x] == j:
            i = earlier[x]
            if total[i] < best or total[i] == best and i > last:
                best, last = total[i], i
            x += 1
        total[j], came[j] = best + cost[j] + EACH, last
        key = total[j] + p
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = came[j]
    return np.array(out[::-1], np.int64)


def pieces(documents: list[np.ndarray], ends_sentence: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """(document, start, length, crc32, sequence, offset) of the pieces of a portion's documents, by their numbers."""
    ids = np.concatenate(documents).astype("<u4")
    ends = np.cumsum([len(d) for d in documents])
    starts = ends - [len(d) for d in documents]
    cuts = cheapest_cuts(*places(ends, np.flatnonzero(ends_sentence[ids]) + 1, size), size)
    begin = np.union1d(starts, cuts[:-1])
    length = np.diff(np.append(begin, len(ids)))
    document = np.searchsorted(ends, begin, "right")
    sequence = np.searchsorted(cuts, begin, "right")
    offset = begin - np.append(0, cuts)[sequence]
    raw = memoryview(ids.tobytes())
    crc = np.array([zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)], np.int64)
    return document, begin - starts[document], length, crc, sequence, offset


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], size: int = SIZE, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(ranks_path, pattern, special), TaskContext.get().partitionId()
        used, held, names, documents = 0, 0, [], []

        def packed() -> pa.RecordBatch:
            nonlocal used
            document, start, length, crc, sequence, offset = pieces(documents, encoder.ends, size)
            whole = np.array([len(d) for d in documents])[document]
            ids = pa.array(names, pa.int64()).take(pa.array(document))
            out = [ids, *map(pa.array, (start, length, crc, whole, sequence + (task << 33) + used, offset))]
            used += int(sequence[-1]) + 1
            return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for name, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.append(encoder.ids(text.as_py()), np.uint32(end))
                names.append(name.as_py())
                documents.append(ids)
                held += len(ids)
                if held >= PORTION:
                    yield packed()
                    held, names, documents = 0, [], []
        if documents:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECE)
