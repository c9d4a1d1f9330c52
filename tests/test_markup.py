"""Chunkers as table functions."""

import random

from pyspark.sql import functions as F

from talus.operators import markup


def rows(df):
    return [tuple(r) for r in df.orderBy("id", "chunk_index").collect()]


def test_sections_keep_code_whole(spark):
    code = "```\n# no header\n" + "x = 1\n" * 400 + "```"
    text = f"intro\n\n# A\npara one\npara two\n\n{code}\n\nafter\n## B\nshort\n```\nopen to the end\n# still code"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n\t"), (5, "# only a header")], "id int, md string").withColumn("start", F.lit("clash"))
    got = rows(markup.markdown_chunks(df, "id", "md"))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, 0, "", []), (1, 1, "A", ["A"]), (1, 2, "A", ["A"]), (1, 3, "A", ["A"]), (1, 4, "B", ["A", "B"]), (5, 0, "only a header", ["only a header"])]
    assert got[1][7] == "# A\n\npara one\npara two" and got[2][7].endswith(code) and got[2][6] and not got[1][6]
    assert got[2][7].startswith("# A\n\npara one\npara two\n\n```")  # the end of the chunk before
    assert got[3][7] == "# A\n\n" + code[-markup.TAIL :] + "\n\nafter" and "# still code" in got[4][7]
    assert all(text[r[4] : r[5]].strip() for r in got[:5])


def test_nothing_is_lost_and_chunks_are_bounded(spark):
    """Texts of random parts: without tails, the chunks' bodies are the parts in order, cut only where one is too long."""
    rnd = random.Random(4)

    def part():
        kind = rnd.random()
        if kind < 0.2:
            return "#" * rnd.randint(1, 6) + f" h{rnd.randint(0, 99)}"
        if kind < 0.4:
            return "~~~\n" + "# c\n\n" * rnd.randint(0, 60) + "~~~"
        return " ".join(rnd.choices(["word", "end.", "Why?", "longerword"], k=rnd.randint(1, 400)))

    texts = ["\n\n".join(part() for _ in range(rnd.randint(1, 30))) for _ in range(30)] + ["w" * 20_000, "a. " * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, md string")
    found = {}
    for r in markup.markdown_chunks(df, "id", "md", 600, 0).orderBy("id", "chunk_index").collect():
        found.setdefault(r.id, []).append(r)
    for i, text in enumerate(texts):
        squeeze = lambda s: "".join(s.split())
        bodies = []
        for n, r in enumerate(found[i]):
            lines = r.text.split("\n\n")
            first = r.header != "" and (n == 0 or found[i][n - 1].path != r.path or r.start != found[i][n - 1].start)
            bodies.append(r.text if first or not r.header else "\n\n".join(lines[1:]))
            assert r.has_code or len(r.text.replace("\n\n", "")) <= 600 + len(lines[0])
        assert squeeze("".join(bodies)) == squeeze(text)


def windows_by_hand(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            places = [i for i in range(end - max(1, int(size * 0.2)), end - 1) if text[i : i + 2] == ". "]
            end = places[-1] + 1 if places else end
        if text[start:end].strip():
            out.append((start, end))
        if end - max(1, int(size * overlap)) <= start:
            break
        start = end - max(1, int(size * overlap))
    return out


def test_windows_and_pages(spark):
    rnd = random.Random(1)
    docs = [[" ".join(rnd.choices(["one", "two.", "three"], k=rnd.randint(0, 60))) for _ in range(rnd.randint(1, 9))] for _ in range(12)] + [[], ["", ""], [None, "abc"], [" " * 500]]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, pages array<string>").union(spark.createDataFrame([(99, None)], "id int, pages array<string>"))
    got = {}
    for r in markup.page_windows(df, "id", F.col("pages"), 120, 0.25).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.page))
    for i, pages in enumerate(docs):
        ends = [sum(len(p or "") for p in pages[: k + 1]) for k in range(len(pages))]
        want = [(a, b, next(k + 1 for k, e in enumerate(ends) if a < e)) for a, b in windows_by_hand("".join(p or "" for p in pages), 120, 0.25)]
        assert got.get(i, []) == want
    assert 99 not in got


def test_sql(spark):
    markup.register(spark)
    spark.createDataFrame([(1, "# A\nx\n## B\ny")], "id int, t string").createOrReplaceTempView("marked")
    got = spark.sql("SELECT id, c.header, c.text FROM marked, LATERAL markdown_chunks(t) c ORDER BY chunk_index").collect()
    assert [tuple(r) for r in got] == [(1, "A", "# A\n\nx"), (1, "B", "## B\n\ny")]
