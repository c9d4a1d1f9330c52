import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from talus.llm import sentencepiece_bpe, token_counts
from talus.llm.queries import BYTE_PAIRS, PIECES, digests, op7_sentencepiece

ALPHABET = ["a", "b", "the", "ing", " ", "  ", "▁", "\n", "\t", "\x1c", "\x85", "é", "中", "😀", "\x00", "<s>", "</s>", "<|endoftext|>", "<|endof", "'s", "it's", "0", "1", "!!", "aaaa", "<0x0A>", "ab" * 40, " " * 20, "x" * 100, "​", "　", "ß", "of", "th", "he"]


def strange_texts(n=1500):
    rnd = random.Random(3)
    out = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 50))) for _ in range(n)]
    return out + ["".join(rnd.choice("thaeinors") for _ in range(rnd.randint(50, 900))) for _ in range(200)] + ["", " ", "▁", " ▁", "\n", "  a"]


def test_sentencepiece_matches_library():
    path = public_tokenizers.path(PIECES)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.model(path)
    texts = strange_texts()
    ids, counts = own.encode(texts)
    edges = np.r_[0, np.cumsum(counts)]
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == library.encode(texts)
    assert own.decode(ids.astype(np.int64), counts) == [library.decode(x) for x in library.encode(texts)]


def test_sentencepiece_documents(docs, sample, none):
    path = public_tokenizers.path(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for table in (docs, sample.limit(60)):
        got = sorted(repr(tuple(r)) for r in digests(sentencepiece_bpe.decode(sentencepiece_bpe.encode(table, path), path)).collect())
        want = []
        for r in table.collect():
            ids = library.encode(r.text or "")
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.append(repr((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))))
        assert got == sorted(want)
    assert sentencepiece_bpe.decode(sentencepiece_bpe.encode(none, path), path).count() == 0


def test_sentencepiece_needs_one_worker_a_task(spark, docs, sample, none, sf):
    """Two Python workers a task, each with a model, took an executor beyond its memory."""
    for df in (op7_sentencepiece(spark, sf), corpus_pipeline.encode_pieces(spark, docs, sf)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path = public_tokenizers.path(PIECES)
    for table in (docs, sample, none):
        apart, together = sentencepiece_bpe.decode(sentencepiece_bpe.encode(table, path), path), sentencepiece_bpe.encode_and_decode(table, path)
        assert together.schema == apart.schema
        assert sorted(map(repr, together.collect())) == sorted(map(repr, apart.collect()))


def test_counts_match_library(docs, sample, none):
    path = public_tokenizers.path(BYTE_PAIRS)
    library = Tokenizer.from_file(path)
    texts = strange_texts()
    assert token_counts.Counter(path).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for table in (docs, sample.limit(60)):
        got = sorted(repr(tuple(r)) for r in token_counts.token_counts(table, path).collect())
        want = []
        for r in table.collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            want.append(repr((r.doc_id, len((r.text or "").encode()), n, n > 1024)))
        assert got == sorted(want)
    assert token_counts.token_counts(none, path).count() == 0
