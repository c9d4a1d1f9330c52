"""Text expressions: tokens, trigrams, sentences and reference extraction."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning of their own in a query or a note.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have", "how", "in", "is", "it",
    "its", "not", "of", "on", "or", "that", "the", "their", "there", "these", "this", "to", "was", "were", "what", "when", "which",
    "who", "will", "with", "you",
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and underscore, in order, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), 1)


def content_words(text: Column, longer_than: int = 2) -> Column:
    """Distinct tokens that are longer than `longer_than` and no stopwords."""
    return F.array_except(F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > longer_than)), F.array(*map(F.lit, STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all elements of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigrams(word: Column) -> Column:
    """Distinct trigrams of a word with two blanks before and one behind it."""
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def overlap_share(query: Column, other: Column) -> Column:
    """Share of the query's distinct tokens that the other text has."""
    return F.size(F.array_intersect(query, other)) / F.greatest(F.size(query), F.lit(1))


def sentences(text: Column) -> Column:
    """Pieces that end in a full stop, question or exclamation mark before white space, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def tag_list(tags: Column) -> Column:
    """A comma-separated list of tags as a sorted array of distinct trimmed tags."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")))


def squeezed(text: Column) -> Column:
    """Lower-cased, trimmed, white space collapsed."""
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def query_from(raw: str, most: int = 500) -> str:
    """The part of a long pasted prompt to search for, `most` characters at most.

    Up to 200 characters pass as they are. Else it is the last line that ends in a question mark (also a full-width one),
    else the last sentence before one, if that has ten characters; else the last line of ten characters or more; else the end.
    """
    text = raw.strip()
    if len(text) <= 200:
        return text
    lines = [line.strip() for line in text.splitlines() if line.strip()]
    asked = [line for line in lines if re.search(r"[?？]\s*[\"']?\s*$", line)]
    asked = asked or [m[0].strip() for m in re.finditer(r"[^.!?。！？\n]+[?？]", text)]
    long = [line for line in lines if len(line) >= 10]
    best = asked[-1:] if asked and len(asked[-1]) >= 10 else long[-1:]
    return (best or [text])[0][-most:].strip()


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: `*` and `**` match any characters, `?` one."""
    return "^" + "".join(".*" if p in ("*", "**") else "." if p == "?" else re.escape(p) for p in re.split(r"(\*\*|\*|\?)", glob)) + "$"


def salient(text: Column, seeds: list[str], first: int = 3, longest: int = 600) -> Column:
    """The `first` sentences of a text that are most like one of the seed queries, in their own order.

    A sentence ends at `.`, `!` or `?` before white space and a capital, bracket or mark, and counts `longest` characters at
    most. It scores the largest share of a seed's words that it has; ties go to the earlier one.
    """
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z(\[`*_])"), lambda s: F.substr(F.trim(s), F.lit(1), F.lit(longest))), lambda s: s != "")
    wanted = [F.array(*map(F.lit, dict.fromkeys(re.findall("[a-z0-9_]+", q.lower())))).cast("array<string>") for q in seeds]
    best = lambda s: F.greatest(*(overlap_share(w, tokens(s)) for w in wanted), F.lit(0.0))
    scored = F.transform(parts, lambda s, i: F.struct((-F.round(best(s), 9)).alias("s"), i.alias("i"), s.alias("t")))
    kept = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, first), lambda x: F.struct(x["i"], x["t"])))
    return F.transform(kept, lambda x: x["t"])


def _marked_letters() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters with marks, and the letters they are without them."""
    both = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x530), *range(0x1E00, 0x2000))]
    both = [(c, d[0]) for c, d in both if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in both), "".join(d for _, d in both)


#: Letters with marks and their bases, by rule; combining marks of their own follow, which have no counterpart and go.
MARKED, BARE = _marked_letters()
MARKS = "".join(map(chr, range(0x300, 0x370)))

#: A word in any script, once letters are folded.
WORD = r"[\p{L}\p{N}_]"

#: Rules that take English endings off a word of more than three letters, in this order.
ENDINGS = (
    (r"^(.{2,})(?:ies|ied)$", "$1y"),
    (r"sses$", "ss"),
    (r"^(.{2,}[^su])s$", "$1"),
    (r"^(.*[aeiouy].*[^e]|.*[aiouy])(?:ingly|edly|ing|ed)$", "$1"),
    (r"([bdfgmnprt])\1$", "$1"),
    (r"^(.{3,})e$", "$1"),
)


def folded(text: Column) -> Column:
    """Lower-cased, without the marks of Latin, Greek and Cyrillic letters; null is empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED + MARKS, BARE)


def folded_word(word: str) -> str:
    """`folded` of a word of a query."""
    return word.lower().translate({ord(c): d for c, d in zip(MARKED, BARE, strict=True)} | {ord(c): None for c in MARKS})


def stem(word: Column) -> Column:
    """A word without the endings of English plurals and verb forms; words of three letters, with digits or in another script stay."""
    out = word
    for pattern, left in ENDINGS:
        out = F.regexp_replace(out, pattern, left)
    return F.when(word.rlike("^[a-z]{4,}$"), out).otherwise(word)


def stem_of(word: str) -> str:
    """`stem` of a word of a query."""
    if not re.fullmatch("[a-z]{4,}", word):
        return word
    for pattern, left in ENDINGS:
        word = re.sub(pattern, left.replace("$1", r"\1"), word)
    return word
