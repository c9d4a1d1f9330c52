"""Text search over several fields: stems in prose, words as they are in identifiers, field weights."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import lineage

# What a term counts in a field of each class.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def terms(query: str) -> tuple[list[str], list[str]]:
    """The stems of a query's words that are no stopwords, and all its words as they are; both folded, in order, distinct."""
    words = list(dict.fromkeys(re.findall(r"\w+", X.folded_word(query))))
    return list(dict.fromkeys(X.stem_of(w) for w in words if w not in X.STOPWORDS)), words


def _stems_in(field: Column, wanted: list[str]) -> Column:
    """The wanted stems that a field has. Only words that begin like one leave the text: endings go, and a `y` replaces them at most."""
    starts = sorted({re.escape(t[:-1] if t.endswith("y") else t) for t in wanted})
    near = F.regexp_extract_all(X.folded(field), F.lit(f"(?<!{X.WORD})(?:{'|'.join(starts)}){X.WORD}*"), 0)
    return F.array_intersect(F.transform(near, X.stem), F.lit(wanted))


def _words_in(field: Column, wanted: list[str]) -> Column:
    near = F.regexp_extract_all(X.folded(field), F.lit(f"(?<!{X.WORD})(?:{'|'.join(sorted(map(re.escape, wanted)))})(?!{X.WORD})"), 0)
    return F.array_distinct(near)


def _score(found: list[tuple[Column, float]], wanted: list[str]) -> Column:
    """The mean over the terms of the heaviest field that has them; 0 if some term is in no field."""
    best = [F.greatest(F.lit(0.0), *(F.when(F.array_contains(there, t), F.lit(w)).otherwise(0.0) for there, w in found)) for t in wanted]
    return F.when(reduce(and_, (b > 0 for b in best)), reduce(add, best) / len(wanted)).otherwise(0.0)


def matches(docs: DataFrame, query: str, prose: dict[str, str] | None = None, plain: dict[str, str] | None = None, score: str = "score") -> DataFrame:
    """Rows whose prose fields together have all stems of the query, or whose plain fields together have all its words, with a score.

    `prose` and `plain` give each field's class of weight, A to D. Prose leaves out stopwords and compares stems; plain
    fields (tags, projects, paths) compare words, stopwords too. Case and marks of letters never count; words end at any
    character that is no letter, digit or underscore, so that parts of dotted titles and of paths are found. The
    score is the mean over the terms of the heaviest class among the fields that have the term, and the larger one of both ways.

    A query without words is an error; one of stopwords alone can match plain fields only, and is an error if there are
    none. A null field is empty. Repeated rows are rows; no row order is defined; a column named like
    `score` is replaced. One scan; nothing is shuffled but a small table, which is dealt out over the cores.
    """
    stems, words = terms(query)
    if not words or not (stems and prose) and not plain:
        raise ValueError(f"nothing to search for: {query!r}")
    fields = {f"p{i}": (_stems_in(F.col(c), stems), w) for i, (c, w) in enumerate((prose or {}).items())} if stems else {}
    fields |= {f"q{i}": (_words_in(F.col(c), words), w) for i, (c, w) in enumerate((plain or {}).items())}
    name = "found"
    while name in map(str.lower, docs.columns):
        name += "_"
    # An array of one, exploded: the filter on the score can't be merged with what finds the terms, which then runs once a field.
    there = F.explode(F.array(F.struct(*(found.alias(f) for f, (found, _) in fields.items())))).alias(name)
    ways = [_score([(F.col(name)[f], WEIGHTS[w]) for f, (_, w) in fields.items() if f[0] == way], wanted) for way, wanted in (("p", stems), ("q", words)) if any(f[0] == way for f in fields)]
    scored = lineage.spread(docs).select("*", there).withColumn(score, F.greatest(*ways, F.lit(0.0)))
    return scored.filter(F.col(score) > 0).drop(name)
