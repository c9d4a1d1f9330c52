"""The stored text index against the scans it stands for."""

import pytest

from talus.operators import fulltext, lineage, search, text_index

WORDS = ["license", "licensed", "Licensing", "releases", "released", "relay", "étude", "étude", "the", "of", "tpc_c", "src1", "42", "中文", "studies"]


@pytest.fixture(scope="module")
def notes(spark):
    import random

    rng = random.Random(2)
    rows = [(i * 7 - 300, " ".join(rng.choices(WORDS, k=rng.randint(0, 9))), rng.choice(["src1", "a/b.license", "the", None]), rng.choice(["en, src1", "fr", "", None])) for i in range(200)]
    rows += [(9000, None, None, None), (9001, "", "", ""), (9002, "license " * 5000, "src1", "en")]
    return spark.createDataFrame(rows, "id long, content string, project string, tags string").repartition(3)


@pytest.fixture(scope="module", params=[50_000, 20])
def index(spark, notes, request, tmp_path_factory):
    before, text_index.SHARD_ROWS = text_index.SHARD_ROWS, request.param
    yield text_index.build(notes, str(tmp_path_factory.mktemp("index")), "id", {"content": "B"}, {"project": "A", "tags": "C"}, ["content"])
    text_index.SHARD_ROWS = before


def scores(df):
    return sorted((r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("query", ["licenses", "Licensing the RELEASES", "en SRC1", "etude", "b license", "中文 42", "absent"])
def test_search_and_top_equal_the_scan(spark, notes, index, query):
    want = scores(fulltext.matches(notes, query, {"content": "B"}, {"project": "A", "tags": "C"}))
    assert scores(text_index.search(spark, index, query)) == want
    for k in (1, 7, 1000) if query == "en SRC1" else (7,):
        assert scores(text_index.top(spark, index, query, k)) == sorted(sorted(want, key=lambda r: (-r[1], r[0]))[:k])


@pytest.mark.parametrize("few", [1000, 1])
def test_misspelt_words_equal_the_scan(spark, notes, index, monkeypatch, few):
    monkeypatch.setattr(text_index, "FEW_WORDS", few)
    for query in ("relesed license", "tpcc", "the of", "zzqq xkcd"):
        want = sorted(r.id for r in search.text_matches(notes, query, text="content").collect())
        assert sorted(r.id for r in text_index.misspelt_matches(spark, index, query).collect()) == want


def test_phrases(spark, notes, index):
    rows = {r.id: text_index.X.folded_word(r.content or "").split() for r in notes.collect()}
    stems = {i: [text_index.X.stem_of(w) for w in ws] for i, ws in rows.items()}
    for query, want in (("licensed releases", ["licens", "releas"]), ("Licensing of the releases", ["licens", None, None, "releas"])):
        times = {i: sum(all(w is None or ws[j + k] == w for k, w in enumerate(want)) for j in range(len(ws) - len(want) + 1)) for i, ws in stems.items()}
        assert {r.id: r.times for r in text_index.phrase(spark, index, query).collect()} == {i: n for i, n in times.items() if n}


def test_shards_are_bounded_by_words(spark, notes, monkeypatch, tmp_path):
    """No list is grouped over all documents, and many small shards give the same."""
    monkeypatch.setattr(text_index, "SHARD_WORDS", 60)
    short = notes.filter("id <> 9002")  # the note of 5000 words
    small = text_index.build(short, str(tmp_path / "index"), "id", {"content": "B"}, {"project": "A", "tags": "C"}, ["content"])
    most = small.postings(spark, text_index.STEM).selectExpr("max(n)", "max(size(positions))", "count(distinct shard)").first()
    assert most[0] < 60 and most[1] <= 60 and most[2] > 10
    assert scores(text_index.top(spark, small, "en SRC1", 7)) == sorted(sorted(scores(fulltext.matches(short, "en SRC1", {"content": "B"}, {"project": "A", "tags": "C"})), key=lambda r: (-r[1], r[0]))[:7])
    plan = text_index.postings(short, "id", [(text_index.STEM, "content", "B")])._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_only_asked_postings_are_read(spark, index):
    plan = text_index._read(spark, index, text_index.STEM, ["licens"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "In(term, [licens])" in plan.replace("EqualTo(term,licens)", "In(term, [licens])")


def test_ids_are_stored_as_differences(spark, index):
    """Nothing to search for is an error; the files pack differences."""
    with pytest.raises(ValueError):
        text_index.search(spark, None, " ")
    import glob

    import pyarrow.parquet as pq

    found = {e for f in glob.glob(f"{index.path}/postings/*/*/*.parquet") for g in [pq.ParquetFile(f).metadata.row_group(0)] for i in range(g.num_columns) for e in g.column(i).encodings if g.column(i).path_in_schema.startswith(("ids", "positions"))}
    assert "DELTA_BINARY_PACKED" in found


def test_stored_results_follow_their_files(spark, tmp_path):
    source, built = str(tmp_path / "t"), []
    spark.range(3).write.parquet(source)
    put = lambda folder: (built.append(folder), spark.read.parquet(source).write.mode("overwrite").parquet(f"{folder}/rows"))
    first = lineage.stored(spark, "rows", source, put)
    assert lineage.stored(spark, "rows", source, put) == first and len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert spark.read.parquet(f"{lineage.stored(spark, 'rows', source, put)}/rows").count() == 5 and len(built) == 2
