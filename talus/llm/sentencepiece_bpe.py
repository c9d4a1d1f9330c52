"""SentencePiece encoding and decoding with byte-pair models, by vectorised merge rounds.

A text's blanks become U+2581 after one such mark is put in front; pieces never hold a mark behind another character
(checked when a model is read), so merges stay inside words: a run of marks and what follows up to the next mark. The
distinct words of a batch are laid out in flat arrays of symbols. A round looks up the rank of every adjacent pair, takes
the smallest rank in each word (a segmented minimum), merges its leftmost place in all words at once, and compacts the
arrays; words without a pair in the vocabulary are done and leave. Characters that are not in the vocabulary end as
bytes. Words already encoded are kept, up to a fixed number, for later batches.

In a word longer than `LONG` symbols, a round merges every non-overlapping place of the smallest pair, from the left,
provided that no pair that such a merge can create ranks as low; else the leftmost place alone. Both give the sequence
of merges of the library.

Decoding gathers the pieces' bytes, turns marks into blanks, drops the blank that encoding put in front, and reads byte
pieces as UTF-8.

Defined results: a null text encodes as an empty one, which has no ids; a null list of ids decodes as an empty one. Texts
of any length are encoded whole; rows that repeat are encoded each, and a null doc_id stays null. Of pairs of equal rank the
leftmost merges first. An empty table gives an empty result. Columns other than doc_id and text, whatever their names, are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Encoded words that a task keeps: the first ones it meets, among them the frequent ones.
KEPT_WORDS = 100_000
LONG = 64
NEVER = np.int64(2**62)


class Model:
    """Vocabulary tables of a model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        read = SentencePieceProcessor(model_file=path)
        n = read.get_piece_size()
        self.pieces = [read.id_to_piece(i) for i in range(n)]
        special = [read.is_control(i) or read.is_unknown(i) or read.is_unused(i) for i in range(n)]
        self.is_byte = np.array([read.is_byte(i) for i in range(n)])
        self.byte_ids = np.flatnonzero(self.is_byte)
        if len(self.byte_ids) != 256 or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces) or read.encode("a  b ") != read.encode("a  b ", add_bos=False) or read.decode(read.encode(" a  b ")) != " a  b ":
            raise ValueError("not a byte-pair model of the kind described above")
        if [self.pieces[i] for i in self.byte_ids] != [f"<0x{b:02X}>" for b in range(256)] or any(read.is_unused(i) for i in range(n)):
            raise ValueError("byte pieces out of order, or unused pieces")
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not self.is_byte[i]}
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece")
        # By falling score: the rank of the piece that a pair gives.
        order = sorted(self.ids.values(), key=lambda i: (-read.get_score(i), i))
        ranks = {i: r for r, i in enumerate(order)}
        keys, made = [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
        keys = np.array(keys, np.int64)
        # An open-addressing table with one probe a step: numpy looks up all pairs of a round at once.
        self.bits = int(len(keys) * 2).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.slots = np.zeros((1 << self.bits, 2), np.int32)
        for key, at, i in zip(keys.tolist(), self._home(keys).tolist(), made, strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at] = key
            self.slots[at] = ranks[i], i
        byte_of = {i: b for b, i in enumerate(self.byte_ids.tolist())}
        surface = [bytes([byte_of[i]]) if self.is_byte[i] else b"" if special[i] and i else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.starts = np.r_[0, np.cumsum([len(s) for s in surface])]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.marked = np.array([p.startswith(MARK) for p in self.pieces])
        self.words: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

        self.forget()

    def forget(self) -> None:
        """Let go of the encoded words."""
        self.words: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair gives; NEVER where it gives nothing."""
        keys = np.where((a >= 0) & (b >= 0), a << 32 | b, -2)
        at = self._home(keys)
        rank, made = np.full(len(keys), NEVER), np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            rank[todo[hit]], made[todo[hit]] = self.slots[at[todo[hit]]].T
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return rank, made

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and the number of each word's ids."""
        chars = "".join(words)
        symbols = np.array([self.ids.get(c, -1 - ord(c)) for c in chars], np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_words = [], []
        while len(symbols):
            n = len(symbols)
            rank, made = np.full(n, NEVER), np.full(n, -1, np.int64)
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner], made[inner] = self.ranks(symbols[inner], symbols[inner + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[first, n])
            lows = np.minimum.reduceat(rank, first)
            over = np.repeat(lows == NEVER, lengths)
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                symbols, word, rank, made = symbols[~over], word[~over], rank[~over], made[~over]
                keep = lows < NEVER
                lows, lengths = lows[keep], lengths[keep]
                if not len(symbols):
                    break
                first = np.r_[0, np.cumsum(lengths)[:-1]]
            low = np.flatnonzero(rank == np.repeat(lows, lengths))
            owner = np.repeat(np.arange(len(first)), lengths)[low]
            left = np.r_[True, owner[1:] != owner[:-1]]
            if (lengths[owner] > LONG).any():
                left |= self._all_places(symbols, word, made, low, owner, lengths, lows)
            low = low[left]
            symbols[low] = made[low]
            keep = np.ones(len(symbols), bool)
            keep[low + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return self._bytes(symbols[order], word[order], len(words))

    def _all_places(self, symbols, word, made, low, owner, lengths, lows) -> np.ndarray:
        """Which places of the smallest pair may merge at once, in long words only."""
        # Of places that overlap (a run of them), every other one counts.
        run = np.r_[True, (low[1:] != low[:-1] + 1) | (owner[1:] != owner[:-1])]
        start = np.maximum.accumulate(np.where(run, np.arange(len(low)), 0))
        take = (np.arange(len(low)) - start) % 2 == 0
        low_t, owner_t = low[take], owner[take]
        after = symbols.copy()
        after[low_t] = made[low_t]
        n = len(symbols)
        gone = np.zeros(n, bool)
        gone[low_t + 1] = True
        bad = np.zeros(len(lengths), bool)
        before = np.maximum(low_t - 1, 0)
        before = np.where(gone[before], np.maximum(low_t - 2, 0), before)
        behind = np.minimum(low_t + 2, n - 1)
        for other, here in ((before, 0), (behind, 1)):
            same = (word[other] == word[low_t]) & ((other < low_t) if here == 0 else (other > low_t + 1))
            for neighbour in (symbols[other], after[other]):
                pair = (neighbour, made[low_t]) if here == 0 else (made[low_t], neighbour)
                rank, _ = self.ranks(*pair)
                bad[owner_t[same & (rank <= lows[owner_t])]] = True
        # The left neighbour as it is before a merge that takes its right half.
        previous = np.maximum(low_t - 1, 0)
        rank, _ = self.ranks(symbols[previous], made[low_t])
        bad[owner_t[(word[previous] == word[low_t]) & (previous < low_t) & (rank <= lows[owner_t])]] = True
        return take & (lengths[owner] > LONG) & ~bad[owner]

    def _bytes(self, symbols: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Spell characters that are not in the vocabulary as bytes."""
        unknown = np.flatnonzero(symbols < 0)
        if len(unknown):
            spelt = [chr(-1 - s).encode("utf-8", "surrogatepass") for s in symbols[unknown].tolist()]
            widths = np.ones(len(symbols), np.int64)
            widths[unknown] = [len(s) for s in spelt]
            out = np.repeat(symbols, widths)
            out[out < 0] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
            symbols, word = out, np.repeat(word, widths)
        return symbols.astype(np.int32), np.bincount(word, minlength=n_words)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the number of each text's ids."""
        split = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in self.words})
        if new:
            ids, counts = self.merge(new)
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
        get = self.words.__getitem__
        index = np.fromiter((get(w) for ws in split for w in ws), np.int64)
        lengths = self.offsets[index + 1] - self.offsets[index]
        out = self.flat[_gather(self.offsets[index], lengths)]
        kept = max(KEPT_WORDS, len(self.words) - len(new))
        if len(self.words) > kept:  # full: the words of this call are forgotten
            for word in new[kept - len(self.words) :]:
                del self.words[word]
            self.flat, self.offsets = self.flat[: self.offsets[kept]].copy(), self.offsets[: kept + 1].copy()
        ends = np.r_[0, np.cumsum(lengths)]
        edges = np.r_[0, np.cumsum([len(ws) for ws in split])]
        return out, ends[edges[1:]] - ends[edges[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of lists of ids on end."""
        lengths = self.starts[ids + 1] - self.starts[ids]
        data = self.surface[_gather(self.starts[ids], lengths)]
        ends = np.r_[0, np.cumsum(lengths)]
        edges = np.r_[0, np.cumsum(counts)]
        raw, out = data.tobytes(), []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            lo = int(ends[a]) + (a < b and bool(self.marked[ids[a]]))
            piece = raw[lo : int(ends[b])]
            try:
                out.append(piece.decode())
            except UnicodeDecodeError:
                out.append(_replaced(piece))
        return out


def _replaced(data: bytes) -> str:
    """Read UTF-8; every byte that belongs to no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                break
            except UnicodeDecodeError:
                n = 0
        if not n:
            out.append("�")
        at += max(n, 1)
    return "".join(out)


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_MODELS: dict[str, Model] = {}


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all the stretches, one after the other."""
    total = int(lengths.sum())
    shift = starts - np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else starts
    return np.repeat(shift, lengths) + np.arange(total)


def model(path: str) -> Model:
    """Read once for each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for hi, size in enumerate(sizes):
        if total and total + size > most:
            yield lo, hi
            lo, total = hi, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


#: Bytes of text, or ids, that are worked on at once.
PORTION = 300_000


def _encoded(own: Model, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """doc_ids and lists of ids, a portion of the batch at a time."""
    texts = batch.column("text")
    for lo, hi in _portions(pc.binary_length(texts).fill_null(0).to_pylist(), PORTION):
        ids, counts = own.encode(texts.slice(lo, hi - lo).to_pylist())
        yield batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))


def _decoded(own: Model, doc_ids: pa.Array, lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, text), a portion of the lists at a time."""
    counts = np.asarray(pc.list_value_length(lists).fill_null(0), np.int64)
    for lo, hi in _portions(counts.tolist(), PORTION):
        part = lists.slice(lo, hi - lo)
        texts = own.decode(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts[lo:hi])
        yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), part, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for doc_ids, lists in _encoded(own, batch):
                yield pa.RecordBatch.from_arrays([doc_ids, lists], ["doc_id", "ids"])
        own.forget()  # the worker may wait for other tasks for long

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of every list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            yield from _decoded(own, batch.column("doc_id"), batch.column("ids"))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """What `decode` gives of `encode`'s result, (doc_id, ids, text), by one Python worker a task instead of two with a model each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for doc_ids, lists in _encoded(own, batch):
                yield from _decoded(own, doc_ids, lists)
        own.forget()

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, text string")
