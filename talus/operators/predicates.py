"""Metadata predicates: small dictionaries become column expressions that Spark pushes down."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
# Comparison signs of the short form, longest first.
SIGNS = {"!=": "$ne", "<=": "$lte", ">=": "$gte", "=": "$eq", "<": "$lt", ">": "$gt"}
NUMBER = r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$"


# Fields that hold numbers, so that 07 and 7.0 equal 7.
NUMERIC_FIELDS = ("bib_year", "bib_citation_count", "page_number", "page_count", "chunk_index", "chunk_count", "chunk_start_char", "chunk_end_char")


def _number(name: str, value):
    """The value as a number where the field holds numbers and it is one."""
    if name in NUMERIC_FIELDS and isinstance(value, str) and re.fullmatch(r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?", value):
        return float(value) if re.search("[.eE]", value) else int(value)
    return value


def _scalar(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if not isinstance(value, str | int | float):
        raise ValueError(f"not a scalar: {value!r}")
    return str(value)


def _one(field: Column, op: str, value) -> Column:
    """A missing field is null: `$ne` and `$nin` hold for it, everything else doesn't."""
    if op == "$eq":
        return F.coalesce(field == _scalar(value), F.lit(False))
    if op == "$ne":
        return ~field.eqNullSafe(F.lit(_scalar(value)))
    if op == "$in":
        return F.coalesce(field.isin([_scalar(v) for v in value]), F.lit(False)) if value else F.lit(False)
    if op == "$nin":
        return field.isNull() | ~field.isin([_scalar(v) for v in value]) if value else F.lit(True)
    if op in RANGES:
        if isinstance(value, bool) or not isinstance(value, str | int | float):
            raise ValueError(f"{op} takes a number or a text: {value!r}")
        if isinstance(value, str):
            return F.coalesce(getattr(field, RANGES[op])(F.lit(value)), F.lit(False))
        # Only a field that is a number compares with a number.
        return F.coalesce(F.when(field.rlike(NUMBER), getattr(field.try_cast("double"), RANGES[op])(F.lit(float(value)))), F.lit(False))
    raise ValueError(f"unknown operator {op}")


def where(conditions: dict | None, field_of: Callable[[str], Column]) -> Column:
    """{"field": value}, {"field": {"$op": value}}, {"$and": [...]}, {"$or": [...]}; all of several entries must hold."""
    out = F.lit(True)
    for name, value in (conditions or {}).items():
        if name in ("$and", "$or"):
            parts = [where(x, field_of) for x in value]
            if not parts:
                raise ValueError(f"{name} of nothing")
            joined = parts[0]
            for part in parts[1:]:
                joined = joined & part if name == "$and" else joined | part
            out = out & joined
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        elif isinstance(value, dict):
            if len(value) != 1:
                raise ValueError("one operator for a field")
            ((op, operand),) = value.items()
            out = out & _one(field_of(name), op, operand)
        else:
            out = out & _one(field_of(name), "$eq", value)
    return out


def conditions_of(pairs: list[str]) -> dict:
    """`key=value`, `key!=value`, `key>=3` ... as a dictionary for `where`; a number after a range sign compares as a number."""
    parts: list[dict] = []
    equal: set[str] = set()
    for pair in pairs:
        m = re.fullmatch(r"([A-Za-z_][\w.]*)(!=|<=|>=|=|<|>)(.+)", pair.strip(), re.S)
        if not m:
            raise ValueError(f"not a condition: {pair!r}")
        key, op, value = m[1], SIGNS[m[2]], m[3]
        if op == "$eq":
            if key in equal:
                raise ValueError(f"{key} is asked for twice")
            equal.add(key)
        if op in RANGES and re.match(NUMBER, value):
            value = float(value)
        elif len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        elif op not in RANGES:
            value = _number(key, value)
        parts.append({key: {op: value}})
    return {"$and": parts} if parts else {}


def in_map(column: str) -> Callable[[str], Column]:
    return lambda name: F.col(column)[name]


def in_json(column: str) -> Callable[[str], Column]:
    """Fields of a JSON text, at any depth by dots."""
    return lambda name: F.get_json_object(F.col(column), "$." + name)
