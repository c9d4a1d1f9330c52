"""Metadata maps in stored form, and the two passes of assignments."""

import pytest
from pyspark.sql import functions as F

from talus.functions import metadata
from talus.operators import taxonomy

ALLOWED = ["title", "bib_year", "bib_venue", "source"]


def test_maps_are_brought_to_form(spark):
    rows = [({"title": "a", "cargo": "x", "bib_year": "0", "bib_venue": ""}, "pdf"), ({"bib_year": "1999", "bib_venue": ""}, "code"), ({"source": "file", "content_type": "old"}, "prose"), ({"source": "web", "title": None}, "markdown"), (None, "pdf"), ({}, "pdf")]
    df = spark.createDataFrame(rows, "m map<string,string>, t string")
    got = [r[0] for r in df.select(metadata.normalized(F.col("m"), F.col("t"), ALLOWED, ["bib_year", "bib_venue"], {"source": ("", "file")})).collect()]
    assert got == [{"title": "a", "content_type": "pdf"}, {"bib_year": "1999", "bib_venue": "", "content_type": "code"}, {"content_type": "prose"}, {"source": "web", "title": None, "content_type": "markdown"}, {"content_type": "pdf"}, {"content_type": "pdf"}]
    with pytest.raises(Exception, match="no content type"):
        df.select(metadata.normalized(F.col("m"), F.lit("video"), ALLOWED)).collect()
    bad = spark.createDataFrame([({"content_type": "pdf"},), ({"b": "1", "a": "1", "content_type": "pdf"},), ({"title": "x"},), ({f"k{i}": "v" for i in range(33)},)], "m map<string,string>")
    assert [r[0] for r in bad.select(metadata.fault(F.col("m"), ALLOWED)).collect()] == [None, "unknown key: a", "no content type", "too many keys"]


def test_own_and_cross_passes(spark):
    chunks = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [0.6, 0.8]), (4, "c", [1.0, 0.0]), (5, "a", None)], "id long, collection string, embedding array<double>")
    centroids = spark.createDataFrame([(10, "a", [1.0, 0.0]), (11, "a", [2.0, 0.0]), (20, "b", [0.0, 1.0])], "topic_id int, collection string, embedding array<double>")
    own = sorted(tuple(r) for r in taxonomy.assign_own(chunks, centroids).select("id", "topic_id").collect())
    assert own == [(1, 10), (2, 10), (3, 20)]  # no limit, ties to the smaller topic, nothing for a collection without topics
    none = spark.createDataFrame([], "id long, topic_id int, similarity double, assigned_by string, source_collection string")
    first = taxonomy.assign_passes(chunks, centroids, none, 0.7)
    rows = lambda df: sorted((r.id, r.topic_id, r.assigned_by, None if r.similarity is None else round(r.similarity, 6)) for r in df.collect())
    assert rows(first) == [(1, 10, "centroid", None), (2, 10, "centroid", None), (2, 20, "projection", 1.0), (3, 20, "centroid", None), (4, 10, "projection", 1.0), (4, 11, "projection", 1.0)]
    assert rows(taxonomy.assign_passes(chunks, centroids, first, 0.7)) == rows(first)
    moved = spark.createDataFrame([(1, 11, 0.5, "manual", "a")], none.schema)
    again = rows(taxonomy.assign_passes(chunks, centroids, moved, 2.0))
    assert again == [(1, 11, "manual", 0.5), (2, 10, "centroid", None), (3, 20, "centroid", None)]  # the first write stays
    assert rows(taxonomy.assign_passes(chunks, centroids.limit(0), none, 0.7)) == []
