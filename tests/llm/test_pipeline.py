import hashlib
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_dedup import components_by_hand, fingerprint_by_hand
from test_native import goals_by_hand

import corpus_pipeline


def test_stages(spark, docs, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mix", "sentencepiece"]
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf)
        assert step.columns == docs.columns
    last = corpus_pipeline.STAGES[-1][1](spark, step, sf)
    assert last.count() == step.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def by_hand(rows, accepted):
    """The pipeline without Spark. rows: (doc_id, text, source); accepted: doc_ids that language ID keeps."""
    rows = [r for r in rows if r[0] in accepted]
    last = {}
    for d, text, _ in rows:
        last[text] = max(d, last.get(text, d))
    rows = [r for r in rows if last[r[1]] == r[0]]
    prints = {d: fingerprint_by_hand(text) for d, text, _ in rows}
    part, first = components_by_hand(prints.values()), {}
    for d, p in prints.items():
        first[part[p]] = min(d, first.get(part[p], d))
    rows = [r for r in rows if first[part[prints[r[0]]]] == r[0]]
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", text)) for d, text, _ in rows}
    sizes = Counter()
    for d, _, source in rows:
        sizes[source] += size[d]
    goal, out = goals_by_hand(sizes), []
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for source in sizes:
        copies = int(goal[source] // sizes[source])
        rest = int(goal[source] - copies * sizes[source])
        key = lambda r: hashlib.md5(f"mix-1:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
        for d, text, _ in sorted((r for r in rows if r[2] == source), key=key):
            ids = model.encode(text)
            out += [(d, len(ids), hexed(",".join(map(str, ids))), hexed(model.decode(ids)))] * (copies + (rest > 0 and size[d] > 0))
            rest -= size[d]
    return sorted(out)


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = spark.conf.get(corpus_pipeline.BATCH)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert spark.conf.get(corpus_pipeline.BATCH) == before
    accepted = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf).collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert accepted <= lettered and len(accepted) >= 0.99 * len(lettered)
    assert got == by_hand([(r.doc_id, r.text or "", r.source) for r in docs.collect()], accepted)


def test_no_labels_drop_nothing_but_letterless_texts(spark, docs, sf):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(spark, unlabelled, sf)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 2, 6, 7, 8, 9, 10]
