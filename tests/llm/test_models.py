import math
import random
import re
import textwrap
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import katz, language_id, license_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class KatzByHand:
    def __init__(self, texts, trained):
        self.words, self.pairs, self.contexts = Counter(), Counter(), Counter()
        for t, use in zip(texts, trained, strict=True):
            if use:
                self.words.update(t)
                for pair in zip([1, *t[:-1]], t, strict=True):
                    self.pairs[pair] += 1
                    self.contexts[pair[0]] += 1
        self.n, self.v = sum(self.words.values()), len(self.words)
        of = lambda c: katz.katz_discounts([sum(1 for x in c.values() if x == r) for r in range(1, 7)])
        self.dw, self.dp = of(self.words), of(self.pairs)
        self.unknown = 1 - sum(self.d(self.dw, c) * c for c in self.words.values()) / self.n if self.n else 1.0
        self.mass, self.seen = defaultdict(float), defaultdict(float)
        for (v, w), r in self.pairs.items():
            self.mass[v] += self.d(self.dp, r) * r
            self.seen[v] += self.p_word(w)

    @staticmethod
    def d(table, r):
        return table[r - 1] if r <= 5 else 1 - 1e-3

    def p_word(self, w):
        return self.d(self.dw, self.words[w]) * self.words[w] / self.n if self.words[w] else self.unknown

    def weight(self, v):
        return (1 - self.mass[v] / self.contexts[v]) / (1 - self.seen[v]) if self.contexts[v] else 1.0

    def p(self, v, w):
        r = self.pairs[v, w]
        return self.d(self.dp, r) * r / self.contexts[v] if r else self.weight(v) * self.p_word(w)


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), 0]


@pytest.mark.parametrize("heavy", [None, 1e-9])
def test_katz(docs, sample, heavy, monkeypatch):
    """The second case makes every word and pair that occurs twice heavy."""
    if heavy:
        monkeypatch.setattr(katz, "HEAVY_SHARE", heavy)
    edge = docs.withColumn("doc_id", F.when(F.col("doc_id") == 9, F.lit(-(2**63))).otherwise(F.col("doc_id"))).withColumnRenamed("keep_id", "row_id")
    for table in (edge, sample):
        rows = table.collect()
        texts, trained = [tokens(r.text) for r in rows], [r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 != 0 for r in rows]
        model = KatzByHand(texts, trained)
        for v in [1, *list(model.words)[:5]]:
            assert sum(model.p(v, w) for w in model.words) + model.weight(v) * model.unknown == pytest.approx(1)
        want = []
        for r, t, use in zip(rows, texts, trained, strict=True):
            base = sum(math.log10((model.words[w] + 0.1) / (model.n + 0.1 * (model.v + 1))) for w in t)
            score = sum(math.log10(model.p(v, w)) for v, w in zip([1, *t[:-1]], t, strict=True))
            want.append((r.doc_id, not use, len(t), sum(model.words[w] > 0 for w in t), model.n, base, score))
        got = [tuple(r) for r in katz.score(table).collect()]
        order = lambda r: (r[0] is None, r[0] or 0, r[2])
        for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_katz_without_texts(spark, none):
    assert katz.score(none).count() == 0
    # 8 is in the held-out fold: nothing to learn from
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = katz.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_language(docs, sample, none):
    prototypes = language_id.learn(language_id.training_rows(sample))
    assert set(prototypes) == {"de", "en", "es", "fr"}
    guessed = language_id.predict(sample, prototypes, ["doc_id", "lang"]).collect()
    held = [r for r in guessed if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in guessed)
    out = {r.doc_id: r for r in language_id.predict(docs, prototypes).collect()}
    assert [out[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and out[7].lang_pred != "und" and out[6].keep_id == "own"
    kept = language_id.accepted(docs, prototypes)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 2, 6, 7, 8, 9, 10]
    clash = docs.withColumnsRenamed({"lang_pred": "Lang_Pred", "keep_id": "__own_1", "n_chars": "Score", "source": "class"})
    kept = language_id.accepted(clash, prototypes, language_id.least_scores(language_id.training_rows(sample), prototypes))
    assert kept.columns == clash.columns and {repr(r) for r in kept.collect()} <= {repr(r) for r in clash.collect()}
    assert language_id.predict(none, prototypes).count() == 0 and language_id.learn(none) == {}
    assert {r.lang_pred for r in language_id.predict(docs, {}, ["doc_id"]).collect()} == {"und"}


def profile_by_hand(text):
    letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
    points = [ord(c) for c in re.sub(" +", " ", f" {letters} ")]
    return sum((np.roll(x, 2) * np.roll(y, 1) * z for x, y, z in (language_id.letter_vectors(np.array(points[i : i + 3])).astype(float) for i in range(len(points) - 2))), np.zeros(language_id.DIMENSIONS))


def test_prediction_equals_brute_force(spark, docs, sample):
    """Prototypes, cosines and the choice, trigram by trigram and without any batching."""
    unit = lambda x: x / (np.sqrt((x * x).sum()) or 1)
    rows = [(r.doc_id, r.text[:400], r.lang) for r in sample.limit(60).collect()] + [(r.doc_id, (r.text or "")[:300], r.lang) for r in docs.collect()]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sums = {}
    for d, text, lang in rows:
        if lang and zlib.crc32(str(d).encode()) % 4 != 2 or lang and d is None:
            sums[lang] = sums.get(lang, 0) + unit(profile_by_hand(text))
    names = sorted(sums)
    prototypes = np.array([unit(sums[n]) for n in names])
    common = unit(prototypes.sum(axis=0))
    own = np.array([unit(p - (p @ common) * common) for p in prototypes])
    want = []
    for d, text, _ in rows:
        raw = profile_by_hand(text)
        u = unit(raw)
        cosines = own @ unit(u - (u @ common) * common)
        known = any(unicodedata.category(c)[0] == "L" for c in text.lower())
        want.append((str(d), names[cosines.argmax()] if known else "und", round(min(1, max(0, cosines.max())), 3) + 0.0 if known else 0.0))
    got = language_id.predict(table, language_id.learn(language_id.training_rows(table)), ["doc_id"]).collect()
    got = [(str(r.doc_id), r.lang_pred, r.score) for r in got]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-3)


def test_least_scores(spark, sample):
    prototypes = language_id.learn(language_id.training_rows(sample))
    least = language_id.least_scores(language_id.training_rows(sample), prototypes)
    kept = language_id.accepted(sample, prototypes, least)
    assert kept.count() == language_id.accepted(sample, prototypes).count()  # clean texts stay
    rnd = random.Random(7)
    noise = spark.createDataFrame([(i, "".join(rnd.choices("qxzjkvwyptgbhfd0123456789+/", k=3000))) for i in range(20)], "doc_id long, text string")
    assert language_id.accepted(noise, prototypes, least).count() == 0
    assert language_id.accepted(noise, prototypes).count() == 20 and language_id.accepted(noise, {}, least).count() == 20


def test_profiles_bundle_all_trigrams():
    letters = language_id.Letters()
    text = "Straße, straße! 12 étés"
    points = letters.blanked(text)
    assert "".join(map(chr, points)) == " straße straße étés "
    by_hand = np.zeros(language_id.DIMENSIONS)
    for a, b, c in zip(points[:-2], points[1:-1], points[2:], strict=True):
        x, y, z = language_id.letter_vectors(np.array([a, b, c]))
        by_hand += np.roll(x, 2) * np.roll(y, 1) * z
    assert (language_id.profiles([text, "", "abc"], letters)[0] == by_hand).all()


def test_licences(docs, sample, none):
    grant = next(text for _, text in license_scan.TEMPLATES if text == license_scan.GRANT)
    full = "Some prose here.\n" + grant.replace("free of charge", "at no charge") + "\n\nOther prose."
    scanner = license_scan.Scanner()
    (found,) = [r for r in scanner.scan(full) if r[3] > 0.5]
    assert found[1] == "MIT" and found[0] == 17 and "free" in found[4]
    assert all(r[1] is None for r in scanner.scan("No license is given here and none is meant.\nNext line."))
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(none).count() == 0
    clash = docs.withColumnsRenamed({"lang": "start", "source": "licence", "keep_id": "saved"})
    assert license_scan.scan(clash).columns == [x.split()[0] for x in license_scan.SCHEMA.split(", ")]
    named = license_scan.scan(docs.sparkSession.createDataFrame([(None, "Released under the MIT License."), (1, None), (1, "")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start, r.licence) for r in named] == [(None, 0, "MIT")]


def exact_places(text):
    """(place, licence) of every template's wording, word for word, by looking at every word of a text; of overlapping ones the longest."""
    words = [(license_scan.spelled(m.group()), m.start(), m.end()) for m in license_scan.WORD.finditer(text)]
    have, out = [w for w, _, _ in words], []
    for i, (name, template) in enumerate(license_scan.TEMPLATES):
        want = license_scan.normal(template)
        out += [(-len(want), i, words[at][1], words[at + len(want) - 1][2], name) for at in range(len(have) - len(want) + 1) if have[at : at + len(want)] == want]
    taken = []
    for _, _, low, high, name in sorted(out):
        if all(high <= a or low >= b for a, b, _ in taken):
            taken.append((low, high, name))
    return sorted((low, name) for low, _, name in taken)


def test_licences_equal_brute_force(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    filler = "Prose of the world, its licence and its words. "
    for i, (_, text) in enumerate(license_scan.TEMPLATES):
        mark = ("\n", "\n # ", "\n// ", " ")[i % 4]
        other = license_scan.TEMPLATES[(7 * i + 3) % len(license_scan.TEMPLATES)][1]
        rows.append((10**6 + i, filler * (i % 5) + mark + mark.join(textwrap.wrap(text, 60 + i)) + "\n\n" + filler + other + (" " + text) * (i % 2)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in license_scan.scan(table).collect():
        if r.licence and not r.missing and not r.extra:
            got[r.doc_id].append((r.start, r.licence))
    assert {d: sorted(x) for d, x in got.items()} == {d: x for d, t in rows if (x := exact_places(t or ""))}


def test_licences_with_changed_words():
    scanner, rnd = license_scan.Scanner(), random.Random(3)
    for name, text in license_scan.TEMPLATES:
        words = text.split()
        most = int(license_scan.MOST_DIFFERENT * len(license_scan.normal(text)))
        single = [i for i, w in enumerate(words) if i and len(license_scan.normal(w)) == 1 and not re.search(license_scan.CUES, w)]  # a notice without a cue is not looked at
        for changed in range(0, most // 2 + 1, max(1, most // 4)):  # a changed word is one missing and one strange word
            other = list(words)
            for i in rnd.sample(single, changed):
                other[i] = rnd.choice(["alpha", "beta"])
            assert (6, name) in [(r[0], r[1]) for r in scanner.scan("Name.\n" + textwrap.fill(" ".join(other), 70))]
    strange = license_scan.BSD_1_2.split()
    assert all(r[1] is None for r in scanner.scan("license " + " ".join(w if i % 5 else "other" for i, w in enumerate(strange))))


def test_licences_across_lines_and_segments():
    scanner = license_scan.Scanner()
    found = lambda text: [(r[0], r[1]) for r in scanner.scan(text) if r[1]]
    assert found("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.") == [(0, "MPL-2.0")]
    isc = license_scan.ISC.replace(" any purpose", "\nany purpose").replace("above copyright", "above\ncopyright")
    assert found("Name\n\n" + isc) == [(6, "ISC")]
    for name, text in (("MIT", "Released under the MIT License."), ("BSD-3-Clause", license_scan.BSD), ("Apache-2.0", license_scan.APACHE)):
        for at in range(1990 - len(text), 2010, 3 if len(text) > 100 else 1):
            assert found("a " * (at // 2) + "b" * (at % 2) + f"\t{text} " + "c " * 900) == [(at + 1, name)]
    for name, text in license_scan.TEMPLATES:
        long = "Prose of the world and its words. " * 200
        assert found(long + text + " " + long) == [(len(long), name)]
        assert found(text.replace(" ", "\n # ")) == [(0, name)]
    every = "\n".join(text for _, text in license_scan.TEMPLATES)
    assert [name for _, name in found(every)] == [name for name, _ in license_scan.TEMPLATES]
    assert [name for _, name in found(every.replace("\n", " "))] == [name for name, _ in license_scan.TEMPLATES]
    assert found("x" * 5000 + " Released under the MIT License. " + "y " * 4000) == [(5001, "MIT")]


def test_least_scores_of_rare_lengths(spark, sample):
    """A class with a single, typical text does not set its own limit."""
    prototypes = language_id.learn(language_id.training_rows(sample))
    rows = language_id.training_rows(sample).select("text", "lang").filter("lang = 'en' AND length(text) > 200").limit(40).collect()
    long = " ".join(r.text for r in rows)
    known = spark.createDataFrame([(long[:4000], "en"), (rows[0].text[:9], "en"), (rows[1].text[:900], "en")], "text string, lang string")
    one = language_id.predict(known, prototypes).filter("lang_pred = lang").withColumn("class", language_id.length_class())
    alone = {r["class"]: r.score for r in one.collect()}
    got = {r["class"]: r.least for r in language_id.least_scores(known, prototypes).collect()}
    want = {c: 0.5 * min(s for k, s in alone.items() if abs(k - c) <= language_id.NEAR) for c in alone}
    assert alone and got == pytest.approx(want)
