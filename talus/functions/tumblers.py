"""Document addresses of the form store.owner.document[.chunk]: compared number by number, never as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(tumbler: Column) -> Column:
    """ARRAY<INT>; arrays compare element by element and a parent comes before its children. Null if a part is no number."""
    good = tumbler.rlike(r"^\d+(\.\d+)*$")
    return F.when(good, F.transform(F.split(tumbler, r"\."), lambda x: x.cast("int")))


def depth(tumbler: Column) -> Column:
    return F.size(F.split(tumbler, r"\."))


def ancestors(tumbler: Column) -> Column:
    """All prefixes, the shortest first, the address itself last."""
    parts = F.split(tumbler, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def is_prefix(prefix: Column, tumbler: Column) -> Column:
    """True for the address itself and all below it."""
    return (prefix == tumbler) | F.startswith(tumbler, F.concat(prefix, F.lit(".")))


def common_ancestor(a: Column, b: Column) -> Column:
    """The longest common prefix; null if there is none."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    most = F.least(F.size(x), F.size(y))
    same = F.filter(F.sequence(F.lit(1), most), lambda n: F.slice(x, 1, n) == F.slice(y, 1, n))
    return F.when(F.size(same) > 0, F.array_join(F.slice(x, 1, F.array_max(same)), "."))


def spans_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)


def span_parts(span: Column) -> Column:
    """Kind and numbers of a span: `lines` 42-57, `chunk` 3:100-250, `hash` chash:<64 hex>[:start-end] or bare 64 or 32 hex digits."""
    lines, chunk, digest = r"^(\d+)-(\d+)$", r"^(\d+):(\d+)-(\d+)$", r"^(?:chash:)?([0-9a-f]{64}|[0-9a-f]{32})(?::(\d+)-(\d+))?$"

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(span, pattern, group).try_cast("bigint")

    return (
        F.when(span.rlike(lines), F.struct(F.lit("lines").alias("kind"), F.lit(None).cast("string").alias("of"), number(lines, 1).alias("start"), number(lines, 2).alias("end")))
        .when(span.rlike(chunk), F.struct(F.lit("chunk").alias("kind"), F.regexp_extract(span, chunk, 1).alias("of"), number(chunk, 2).alias("start"), number(chunk, 3).alias("end")))
        .when(span.rlike(digest), F.struct(F.lit("hash").alias("kind"), F.regexp_extract(span, digest, 1).alias("of"), number(digest, 2).alias("start"), number(digest, 3).alias("end")))
    )


def span_text(span: Column, text: Column) -> Column:
    """The part of a chunk's text that a span names by characters (from 0, the end left out), the whole text if it names none."""
    parts = span_parts(span)
    start, end = parts["start"].cast("int"), parts["end"].cast("int")
    return F.when(start.isNull(), text).otherwise(F.substr(text, start + 1, F.greatest(end - start, F.lit(0))))
