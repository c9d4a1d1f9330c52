"""Metadata maps in stored form: known keys only, no placeholders, a bounded number of keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of content, and how many keys a record may have.
CONTENT_TYPES = ("code", "pdf", "markdown", "prose")
MOST_KEYS = 32
#: What stands for nothing in a map of texts.
PLACEHOLDERS = ("", "0", "false")


def _empty(metadata: Column, key: str) -> Column:
    return F.coalesce(F.lower(metadata[key]).isin(*PLACEHOLDERS), F.lit(True))


def normalized(metadata: Column, content_type: Column, allowed: list[str], together: list[str] = (), defaults: dict[str, tuple[str, ...]] | None = None) -> Column:
    """A map<string, string> with the allowed keys and `content_type`; a content type that is none is an error.

    Keys of `together` go if all of them are placeholders or missing, and stay all if one says something. A key of `defaults` goes if its value is
    one of those, or null. A null map is an empty one.
    """
    given = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    known = F.map_filter(given, lambda k, v: k.isin(*allowed))
    if together:
        idle = reduce(and_, (_empty(known, k) for k in together))
        known = F.map_filter(known, lambda k, v: ~(k.isin(*together) & idle))
    for key, values in (defaults or {}).items():
        known = _without(known, key, values)
    kind = F.when(content_type.isin(*CONTENT_TYPES), content_type).otherwise(F.raise_error(F.concat(F.lit("no content type: "), F.coalesce(content_type, F.lit("null")))))
    return F.map_concat(F.map_filter(known, lambda k, v: k != "content_type"), F.create_map(F.lit("content_type"), kind))


def _without(metadata: Column, key: str, values: tuple[str, ...]) -> Column:
    return F.map_filter(metadata, lambda k, v: ~((k == key) & F.coalesce(v.isin(*values), F.lit(True))))


def fault(metadata: Column, allowed: list[str], most: int = MOST_KEYS) -> Column:
    """Why a stored map can't be written: `too many keys`, `unknown key: ...` or `no content type`; null if it can."""
    unknown = F.array_sort(F.filter(F.map_keys(metadata), lambda k: ~k.isin(*allowed, "content_type")))
    return F.when(F.size(metadata) > most, "too many keys").when(F.size(unknown) > 0, F.concat(F.lit("unknown key: "), F.get(unknown, F.lit(0)))).when(~F.coalesce(metadata["content_type"].isin(*CONTENT_TYPES), F.lit(False)), "no content type")
