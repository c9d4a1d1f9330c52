"""Density topics, k-means and the vector index against brute force, in any partitioning."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import density, search, taxonomy, vector_index


def blobs(seed, sizes, width=6, noise=10):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(len(sizes), width))
    rows = [c + 0.08 * rng.normal(size=width) for c, n in zip(centers, sizes, strict=True) for _ in range(n)]
    return [r.tolist() for r in [*rows, *rng.normal(size=(noise, width))]]


def table(spark, rows, parts):
    return spark.createDataFrame(rows, "id long, collection string, embedding array<double>").repartition(parts)


def brute_tree(ids, vectors, least):
    """Prim's tree over all pairs; (w, smaller end, larger end) decides."""
    v = np.array(vectors)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = np.round(np.sqrt(np.maximum(((v[:, None] - v[None]) ** 2).sum(2), 0)), 7)
    core = np.sort(far, axis=1)[:, min(least, len(ids)) - 1]
    reach = np.maximum(np.maximum(far, core[:, None]), core[None])
    edge = lambda i, j: (reach[i, j], min(ids[i], ids[j]), max(ids[i], ids[j]))
    inside, out = {0}, []
    while len(inside) < len(ids):
        best = min(((edge(i, j), j) for i in inside for j in range(len(ids)) if j not in inside))
        out.append(best[0])
        inside.add(best[1])
    return sorted(out)


def brute_topics(tree, least, cap):
    """Clusters by definition: at each level from the top, the parts of the tree without its longer edges."""
    points = sorted({p for _, a, b in tree for p in (a, b)})

    def parts(edges, members):
        left, out = set(members), []
        near = {}
        for _, a, b in edges:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        while left:
            todo, seen = [min(left)], set()
            while todo:
                p = todo.pop()
                if p not in seen:
                    seen.add(p)
                    todo += [q for q in near.get(p, []) if q in members]
            out.append(seen)
            left -= seen
        return out

    def grow(members, edges, born):
        """(points, stability, clusters below) of a cluster that appears at `born`."""
        now, total = set(members), 0.0
        for i in range(len(edges) - 1, -1, -1):
            level = 1 / max(edges[i][0], density.NEAREST)
            pieces = parts([e for e in edges[:i] if e[1] in now and e[2] in now], now)
            large = [p for p in pieces if len(p) >= least]
            if edges[i][1] not in now or edges[i][2] not in now:
                continue
            if len(large) == 2:
                total += len(now) * (level - born)
                return set(members), total, [grow(p, [e for e in edges[:i] if e[1] in p and e[2] in p], level) for p in large]
            keep = large[0] if large else set()
            total += (len(now) - len(keep)) * (level - born)
            now = keep
            if not now:
                break
        return set(members), total, []

    def choose(cluster, top=False):
        members, stability, below = cluster
        under = [choose(c) for c in below]
        value = sum(u[0] for u in under)
        if top or (below and value > stability) or len(members) > cap:
            return value, [m for u in under for m in u[1]]
        return stability, [members]

    found = sorted(choose(grow(set(points), tree, 0.0), True)[1], key=min)
    return {p: next((i for i, m in enumerate(found) if p in m), density.NOISE) for p in points}


@pytest.mark.parametrize("seed, sizes", [(1, (30, 25, 40)), (2, (60, 8, 20, 12))])
def test_density_topics_equal_brute_force(spark, monkeypatch, seed, sizes):
    """Several cells, ties among repeated vectors, and the same answer from 1 and 7 partitions."""
    monkeypatch.setattr(density, "BLOCK", 40)
    monkeypatch.setattr(density, "FLOOR", 45)
    vectors = blobs(seed, sizes)
    vectors += [vectors[0]] * 6 + [vectors[35]] * 3
    rows = [(i * 3 + 1, "a", v) for i, v in enumerate(vectors)] + [(5000 + i, None, v) for i, v in enumerate(vectors[:40])] + [(9000, "alone", vectors[0]), (9001, "a", None)]
    got = [{(r.collection, r.id): r.topic_id for r in taxonomy.discover(table(spark, rows, parts), "collection").collect()} for parts in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == len(rows) - 1
    for name in ("a", None):
        mine = [(i, v) for i, c, v in rows if c == name and v is not None]
        tree = brute_tree([i for i, _ in mine], [v for _, v in mine], density.LEAST)
        edges = density.spanning_tree(density.points(table(spark, [r for r in rows if r[1] == name], 3), "collection", "id", "embedding"))
        assert sorted((r.w, r.a, r.b) for r in edges.collect()) == [(float(w), a, b) for w, a, b in tree]
        want = brute_topics(tree, density.LEAST, max(len(mine) // density.SHARE, 45))
        assert {i: t for (c, i), t in got[0].items() if c == name} == want
    assert got[0]["alone", 9000] == density.NOISE


def test_density_topics_take_few_jobs(spark):
    """However many rounds of joining a collection's points would take."""
    rows = [(i, "ab"[i % 2], v) for i, v in enumerate(blobs(3, (150,) * 6, noise=300))]
    spark.sparkContext.setJobGroup("density", "topics of 1200 points")
    try:
        assert density.topics(table(spark, rows, 3), "collection").count() == len(rows)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("density")) < 25
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_means_equal_brute_force(spark, monkeypatch):
    """Collections beyond the size for density; sums are exact, so 1 and 7 partitions agree."""
    monkeypatch.setattr(density, "BLOCK", 30)
    vectors = blobs(7, (40, 40, 30))
    rows = [(i, "a", v) for i, v in enumerate(vectors)] + [(1000 + i, "b", v) for i, v in enumerate(vectors[:3])]
    got = [{r.id: r.topic_id for r in taxonomy.discover(table(spark, rows, parts), "collection", dense=4).collect()} for parts in (1, 7)]
    assert got[0] == got[1] and set(got[0]) == {r[0] for r in rows} and {got[0][i] for i in (1000, 1001, 1002)} == {density.NOISE}
    hashes = {r.id: r.h for r in spark.range(len(vectors)).select("id", F.xxhash64("id").alias("h")).collect()}
    v = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    means = v[sorted(hashes, key=lambda i: (hashes[i], i))[:10]]
    for _ in range(10):
        own = ((v[:, None] - means[None]) ** 2).sum(2).round(9).argmin(1)
        means = np.array([v[own == t].mean(0) if (own == t).any() else means[t] for t in range(len(means))])
    own = ((v[:, None] - means[None]) ** 2).sum(2).round(9).argmin(1)
    assert [got[0][i] for i in range(len(vectors))] == own.tolist()


def found(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    """Random and clustered vectors, a third of all rows the same one, a zero vector, a missing one."""
    rng = np.random.default_rng(4)
    rows = [(i, "xyz"[i % 3], v) for i, v in enumerate([*rng.normal(size=(150, 20)).tolist(), *blobs(5, (40, 40), 20, 0)])]
    rows += [(1000 + i, "w", rows[3][2]) for i in range(120)] + [(2000, "x", [0.0] * 20), (2001, "x", None)]
    return rows


@pytest.mark.parametrize("parts, part_rows, share", [(1, 50_000, 10_000), (7, 25, 4)])
def test_index_exact_equals_comparing_all(spark, monkeypatch, tmp_path, vectors, parts, part_rows, share):
    monkeypatch.setattr(vector_index, "PART_ROWS", part_rows)
    monkeypatch.setattr(vector_index, "SHARE", share)
    rows = table(spark, vectors, parts)
    index = vector_index.build(rows, str(tmp_path / "index"), keep=["collection"])
    assert sum(index.rows.values()) == len(vectors) - 1
    asked = rows.filter("id % 20 = 0 OR id = 2000 OR id = 2001").withColumnRenamed("id", "query_id")
    for where in (None, F.col("collection") == "w", F.col("collection") == "x"):
        want = search.nearest(asked.filter("embedding IS NOT NULL"), rows.filter(where) if where is not None else rows, 7)
        assert found(vector_index.search(index, asked, 7, where, exact=True)) == found(want)
    assert vector_index.search(index, asked, 5, F.col("collection") == "absent").count() == 0


def test_index_recall_and_widening(spark, tmp_path, vectors, capsys):
    rows = table(spark, vectors, 3)
    index = vector_index.build(rows, str(tmp_path / "index"), keep=["collection"])
    vector_index.save(spark, index)
    again = vector_index.load(spark, index.path)
    assert again.rows == index.rows and np.array_equal(again.centroids, index.centroids)
    asked = rows.filter("id % 20 = 0 AND embedding IS NOT NULL").withColumnRenamed("id", "query_id")
    for where in (None, F.col("collection") == "z"):
        got = vector_index.search(again, asked, 10, where, probes=1)
        truth = search.nearest(asked, rows.filter(where) if where is not None else rows, 10)
        hits = vector_index.recall(got, truth).agg(F.sum("found") / F.sum("wanted")).first()[0]
        with capsys.disabled():
            print(f"\nrecall at 10: {hits:.3f}")
        assert hits >= 0.9
        assert all(len(list(g)) == 10 for _, g in itertools.groupby(found(got), key=lambda r: r[0]))


def test_index_of_nothing(spark, tmp_path):
    rows = table(spark, [], 1)
    index = vector_index.build(rows, str(tmp_path / "index"))
    assert vector_index.search(index, rows, 3, query_key="id").count() == 0
