"""Identifiers and addresses of sources: DOIs, arXiv numbers, URIs, file names, scopes and dates as sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns, URI schemes that have a reader by default, endings of minified files.
DOI = r"10\.\d{4,9}/[-._;()/:a-zA-Z0-9]+"
DOI_LABEL = r"(?i)(?:doi[:\s]+|https?://(?:dx\.)?doi\.org/)"
ARXIV = r"\d{4}\.\d{4,5}"
SCHEMES = ("file", "https")
MINIFIED = (".min.js", ".min.mjs", ".min.cjs", ".min.css", ".bundle.js", ".bundle.mjs")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group)
    return F.when(found != "", found)


def doi(text: Column) -> Column:
    """The first DOI behind a label or in a link, else the first of all, without punctuation at its end; null if there is none."""
    return F.regexp_replace(F.coalesce(_first(text, f"{DOI_LABEL}({DOI})"), _first(text, rf"\b({DOI})")), r"[.,;:)\]]+$", "")


def arxiv(text: Column) -> Column:
    """The arXiv number in a file name, behind `arXiv:`, or with a version; null if there is none."""
    return F.coalesce(_first(text, rf"(?i)(?:^|[/\-_])({ARXIV})(?:v\d+)?\.pdf$"), _first(text, rf"(?i)\barxiv[: ]\s*({ARXIV})(?:v\d+)?\b"), _first(text, rf"(?i)\b({ARXIV})v\d+\b"))


def source_uri(uri: Column, path: Column, root: Column) -> Column:
    """The given URI, else `file://` and the path, below the root if it is relative; empty if there is neither."""
    absolute = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path))
    return F.when(F.coalesce(uri, F.lit("")) != "", uri).when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("file://"), absolute)).otherwise("")


def uri_fault(uri: Column, schemes: tuple[str, ...] = SCHEMES) -> Column:
    """Why a URI can't be registered: `no scheme`, or `unknown scheme` if it is none of those that have a reader; null if it can."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(uri == "", None).when(scheme == "", "no scheme").when(~scheme.isin(*schemes), "unknown scheme")


def is_minified(name: Column) -> Column:
    out = F.lit(False)
    for ending in MINIFIED:
        out = out | F.endswith(F.lower(name), F.lit(ending))
    return out


def has_shebang(text: Column) -> Column:
    return F.startswith(text, F.lit("#!"))


def scope_tags(tags: Column) -> Column:
    """A list of scopes in stored form: without globs and 8-digit hash endings, without `all`, sorted and distinct."""
    one = lambda t: F.when(F.endswith(t, F.lit("*")), F.regexp_replace(t, r"-?\*$", "")).otherwise(F.regexp_replace(t, "-[0-9a-fA-F]{8}$", ""))
    given = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), lambda t: (t != "") & (t != "all"))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(given, one), lambda t: t != ""))), ",")


def newest_first(timestamp: Column) -> Column:
    """A text that sorts later timestamps first: every digit d of the ISO form becomes 9 - d."""
    return F.translate(timestamp, "0123456789", "9876543210")
