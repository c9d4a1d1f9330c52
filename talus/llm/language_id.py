"""Language identification by hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point. A trigram's vector binds its three
letters' vectors, each rotated by its place, by multiplication. A text's profile bundles (adds) the vectors of all its
trigrams, repeats included; a language's prototype bundles the unit profiles of its training texts. Texts are compared
with the prototypes by cosine, both freed of what all languages have in common (the mean prototype direction).

Letters are lower-cased; each run of other characters counts as one blank, and a text begins and ends with one.

Defined results: a null text, or one without a letter, is `und` with score 0. Ties go to the language that sorts first.
With nothing learned every text is `und`. A text of any length is profiled whole, a part at a time. Rows that repeat are
predicted alike, and each counts where prototypes are learned. An empty table gives an empty result. Only text (and, to
learn from, lang and doc_id) is read; other columns, whatever their names, pass untouched through `accepted`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, is_held_out

DIMENSIONS = 2048
#: Distinct language labels that may be learned; a table with more has something else in its lang column.
MAX_LANGUAGES = 1000
#: Code points, and distinct trigrams, worked on at once: a worker's arrays stay at some 80 MB.
CHUNK, GRAMS = 200_000, 2048
#: Texts whose profiles are held at once.
ROWS = 256
HELD_OUT = (4, 2)
#: Of the smallest score that a rightly predicted text of about the same length has: up to NEAR length classes shorter or longer.
SHARE, NEAR = 0.5, 3


def letter_vectors(code_points: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point, the same on every machine."""
    lanes = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    x = code_points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (lanes[None, :] + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
    return (2 * bits.astype(np.int8) - 1).astype(np.int8)


class Letters:
    """Which code points are letters, asked once for each code point."""

    def __init__(self) -> None:
        self.known = np.full(0x110000, -1, np.int8)

    def blanked(self, text: str) -> np.ndarray:
        """Code points of the lower-cased text with every run of non-letters as one blank, between blanks."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.known[points]
        if (kinds < 0).any():
            for p in np.unique(points[kinds < 0]):
                self.known[p] = unicodedata.category(chr(p))[0] == "L"
            kinds = self.known[points]
        points = np.r_[np.uint32(32), np.where(kinds == 1, points, np.uint32(32)), np.uint32(32)]
        return points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]


def profiles(texts: list[str], letters: Letters) -> np.ndarray:
    """A float32 row for each text: the sum of its trigrams' vectors."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    at = 0
    while at < len(texts):
        pieces, owners, total = [], [], 0
        while at < len(texts) and total < CHUNK:
            points = letters.blanked(texts[at]) if texts[at] else np.zeros(0, np.uint32)
            for a in range(0, max(0, len(points) - 2), CHUNK):  # overlapping by two, so that no trigram is lost
                pieces.append(points[a : a + CHUNK + 2])
                owners.append(at)
                total += len(pieces[-1])
                if total >= 2 * CHUNK:
                    _bundle(pieces, owners, out)
                    pieces, owners, total = [], [], 0
            at += 1
        _bundle(pieces, owners, out)
    return out


def _bundle(pieces: list[np.ndarray], owners: list[int], out: np.ndarray) -> None:
    if not pieces:
        return
    alphabet, codes = np.unique(np.concatenate(pieces), return_inverse=True)
    k = len(alphabet)
    ends = np.cumsum([len(p) for p in pieces])
    starts = np.ones(len(codes), bool)
    starts[ends - 1] = starts[ends - 2] = False  # no trigram starts at a piece's last two places
    first = np.flatnonzero(starts[:-2])
    grams = (codes[first].astype(np.int64) * k + codes[first + 1]) * k + codes[first + 2]
    if k**3 <= 4_000_000:
        table = np.zeros(k**3, np.int64)
        table[grams] = 1
        used = np.flatnonzero(table)
        table[used] = np.arange(len(used))
        grams = table[grams]
    else:
        used, grams = np.unique(grams, return_inverse=True)
    rows, row_of = np.unique(np.array(owners), return_inverse=True)
    row = np.repeat(row_of, np.array([len(p) for p in pieces]))[first]
    base = letter_vectors(alphabet)
    a, b = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    for lo in range(0, len(rows), 256):
        hi = min(lo + 256, len(rows))
        mine = slice(np.searchsorted(row, lo), np.searchsorted(row, hi))
        counts = np.bincount((row[mine] - lo) * len(used) + grams[mine], minlength=(hi - lo) * len(used)).reshape(hi - lo, len(used))
        seen = np.flatnonzero(counts.any(axis=0))
        for s in range(0, len(seen), GRAMS):
            part = seen[s : s + GRAMS]
            bound = a[used[part] // (k * k)] * b[used[part] // k % k] * base[used[part] % k]
            out[rows[lo:hi]] += counts[:, part].astype(np.float32) @ bound.astype(np.float32)


def _units(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (matrix / np.where(norms > 0, norms, 1)).astype(np.float32)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    for lo in range(0, batch.num_rows, ROWS):
        yield lo, batch.column(column).slice(lo, ROWS).to_pylist()


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes by language, from all rows of (text, lang). Partial sums leave each task once; the result is small."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = Letters(), {}
        for batch in batches:
            for lo, texts in _slices(batch, "text"):
                unit = _units(profiles(texts, letters))
                langs = np.array(batch.column("lang").slice(lo, ROWS).to_pylist())
                for lang in np.unique(langs):
                    total[lang] = total.get(lang, 0) + unit[langs == lang].sum(axis=0, dtype=np.float64)
        names = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[n].tolist() for n in names], pa.list_(pa.float64()))], ["lang", "total"])

    parts = labelled.select("text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(sums, "lang string, total array<double>")
    # Rounded before they are added, so that the order of the sums can't show.
    added = parts.select("lang", F.posexplode("total").alias("at", "v")).groupBy("lang", "at").agg(F.sum(F.round(F.col("v") * 1e6).cast("long")).alias("v"))
    rows = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("vs")).select("lang", "vs.v").orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: np.array(r["v"], np.float64) / 1e6 for r in rows}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of each document with lang_pred and score (0 to 1); columns of these names are replaced."""
    names = sorted(prototypes)
    matrix = _units(np.array([prototypes[n] for n in names])) if names else np.zeros((0, DIMENSIONS), np.float32)
    common = _units(matrix.sum(axis=0, keepdims=True))[0] if len(names) > 1 else np.zeros(DIMENSIONS, np.float32)
    own = _units(matrix - np.outer(matrix @ common, common)) if names else matrix
    model = docs.sparkSession.sparkContext.broadcast((names, common, own))
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, common, own = model.value
        letters = Letters()
        for batch in batches:
            langs, scores = [], []
            for _, texts in _slices(batch, "text"):
                rows = profiles(texts, letters)
                there = rows.any(axis=1) & bool(names)
                rows = _units(rows)
                rows = _units(rows - np.outer(rows @ common, common))
                cosines = rows @ own.T if names else np.zeros((len(texts), 1))
                best = cosines.argmax(axis=1)
                langs += [names[b] if t else "und" for b, t in zip(best, there, strict=True)]
                scores += np.where(there, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(guess, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~is_held_out(F.col("doc_id"), *HELD_OUT))


def length_class(text: str = "text") -> Column:
    """0 for an empty text, 1 for one character, 2 for two and three, and so on by powers of two."""
    return F.floor(F.log2(F.char_length(F.coalesce(text, F.lit(""))) + F.lit(0.5)) + 1).cast("int")


def least_scores(labelled: DataFrame, prototypes: dict[str, np.ndarray], share: float = SHARE) -> DataFrame:
    """(class, least): for texts of each length class, `share` of the smallest score that a rightly predicted row of (text, lang) has.

    That is the smallest over NEAR classes to both sides: a class with few known texts, which may all be typical, takes over
    what its neighbours allow. A class without a known text has no row.
    """
    known = labelled.select("text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    right = predict(known, prototypes).filter("lang_pred = lang")
    least = right.groupBy(length_class().alias("class")).agg((share * F.min("score")).alias("least"))
    near = least.select("class", "least", F.explode(F.sequence(F.col("class") - NEAR, F.col("class") + NEAR)).alias("to"))
    there = near.groupBy("to").agg(F.min("least").alias("least"), F.max(F.col("to") == F.col("class")).alias("known"))
    return there.filter("known").select(F.col("to").alias("class"), "least")


def accepted(docs: DataFrame, prototypes: dict[str, np.ndarray], least: DataFrame | None = None) -> DataFrame:
    """The documents in some language, with all their columns as they came.

    `und` goes, and so does a text whose score is below `least` (as least_scores has it) for its length: it is less like
    its language than half of what the least typical known text of about that length is. Classes without a known text
    lose nothing more. With no prototypes, only texts without a letter go.
    """
    own = {c: new for c, new in zip(docs.columns, free_names(docs, *(f"__own_{i}" for i in range(len(docs.columns)))), strict=True) if c.lower() != "text"}
    guessed = predict(docs.withColumnsRenamed(own), prototypes or {"any": np.ones(DIMENSIONS)}).filter("lang_pred <> 'und'")
    if least is not None and prototypes:
        # As many rows as a text has powers of two: 64 at most.
        guessed = guessed.withColumn("class", length_class()).join(F.broadcast(least), "class", "left").filter("least IS NULL OR score >= least")
    return guessed.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))
