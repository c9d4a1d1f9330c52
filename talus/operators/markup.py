"""Chunkers as table functions: Markdown by sections with whole code blocks, and page texts by windows.

Each is a Python UDTF for lateral joins and, once registered, for SQL:
    docs.lateralJoin(markdown_chunks(F.col("text").outer()))
    register(spark); spark.sql("SELECT ... FROM docs, LATERAL markdown_chunks(text)")
A text is read line by line by a state machine; a task holds one text and the chunk it is at. A null, empty or blank text has no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Characters of a chunk (512 tokens of 3.3), and of the end of the last chunk that the next one begins with.
CHUNK, TAIL = int(512 * 3.3), int(50 * 3.3)
#: Characters of a window of pages, and the share by which windows overlap; a window may end early by LATE of its length.
WINDOW, OVERLAP, LATE = 1500, 0.2, 0.2

HEADER = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")


def parts_of(text: str) -> Iterator[tuple[str, int, str, int, int]]:
    """(kind, level, text, start, end) of the parts in order: headers, code blocks with their fences, and paragraphs; places in characters.

    Inside a fence nothing is a header. A fence ends at one of the same sign that is as long, or with the text. A paragraph with a
    line of = or - under it is a header of level 1 or 2.
    """
    fence, held, start = None, [], 0
    at = 0
    for raw in text.splitlines(keepends=True):
        line, begin = raw.rstrip("\r\n\v\f\x1c\x1d\x1e\x85  "), at
        at += len(raw)
        mark = FENCE.match(line)
        if fence is not None:
            held.append(line)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                yield "code", 0, "\n".join(held), start, at
                fence, held = None, []
            continue
        opens = mark and not (mark[1][0] == "`" and "`" in mark[2])
        header, under = HEADER.match(line), UNDERLINE.match(line)
        if held and under:
            yield "header", 1 if "=" in under[1] else 2, " ".join(h.strip() for h in held), start, at
            held = []
        elif opens or header or not line.strip():
            if held:
                yield "text", 0, "\n".join(held), start, begin
                held = []
            if opens:
                fence, held, start = mark[1], [line], begin
            elif header:
                yield "header", len(header[1]), (header[2] or "").strip(), begin, at
        else:
            if not held:
                start = begin
            held.append(line)
    if held:
        yield "code" if fence is not None else "text", 0, "\n".join(held), start, at


def sections(text: str) -> Iterator[tuple[int, str, list[str], str]]:
    """(level, header, path, text below it); what stands before the first header, if anything does, is of level 0."""
    stack, body, open_ = [], [], (0, "")
    for kind, depth, part, _, _ in parts_of(text):
        if kind == "header":
            if body or open_[0]:
                yield *open_, [h for _, h in stack], "\n\n".join(body)
            stack, body, open_ = [(d, h) for d, h in stack if d < depth] + [(depth, part)], [], (depth, part)
        else:
            body.append(part)
    if body or open_[0]:
        yield *open_, [h for _, h in stack], "\n\n".join(body)


def pieces(text: str, most: int) -> Iterator[str]:
    """A paragraph in pieces of at most `most` characters, cut behind a sentence, else behind white space, else anywhere."""
    while len(text) > most:
        head = text[:most]
        cut = max(head.rfind(". ") + 1, head.rfind("? ") + 1, head.rfind("! ") + 1) or max(head.rfind(" "), head.rfind("\n")) + 1 or most
        yield text[:cut].rstrip()
        text = text[cut:].lstrip()
    if text:
        yield text


def markdown(text: str, most: int = CHUNK, tail: int = TAIL) -> Iterator[tuple[int, str, list[str], int, int, bool, str]]:
    """(index, header, path, start, end, has_code, text) of a text's chunks.

    A section is a header with what follows it up to the next; its path has the headers above it, its own last. A section of more than
    `most` characters is several chunks: each begins with the header and the last `tail` characters of the one before, and parts are
    added while they fit. Code blocks stay whole, however long; longer paragraphs are cut.
    """
    index, stack, header, level = 0, [], "", 0
    body: list[tuple[str, bool]] = []
    begin = end = 0

    def section() -> Iterator[tuple[int, str, list[str], int, int, bool, str]]:
        nonlocal index
        title = [f"{'#' * level} {header}".rstrip()] if level else []
        now, lead, code, length = [], [], False, sum(map(len, title))
        for part, is_code in [(p, c) for b, c in body for p in ([b] if c else pieces(b, most))]:
            if now and length + len(part) > most:
                yield index, header, [h for _, h in stack], begin, end, code, "\n\n".join([*title, *lead, *now])
                index += 1
                last = "\n\n".join(now)[-tail:] if tail else ""
                now, lead, code = [], [last] if last else [], False
                length = sum(map(len, title)) + len(last)
            now.append(part)
            code |= is_code
            length += len(part)
        if now or level:
            yield index, header, [h for _, h in stack], begin, end, code, "\n\n".join([*title, *lead, *now])
            index += 1

    for kind, depth, part, start, stop in parts_of(text):
        if kind == "header":
            yield from section()
            stack = [(d, h) for d, h in stack if d < depth] + [(depth, part)]
            header, level, body, begin, end = part, depth, [], start, stop
        else:
            if not body and not level:
                begin = start
            body.append((part, kind == "code"))
            end = stop
    yield from section()


def windows(text: str, size: int = WINDOW, overlap: float = OVERLAP) -> Iterator[tuple[int, int, int, str]]:
    """(index, start, end, text): windows of `size` characters that overlap; one that would end inside ends behind the last `. ` of its last fifth, if there is one. Blank windows are left out."""
    back, start, index = max(1, int(size * overlap)), 0, 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            stop = text.rfind(". ", end - max(1, int(size * LATE)), end)
            end = stop + 1 if stop != -1 else end
        part = text[start:end].strip()
        if part:
            yield index, start, end, part
            index += 1
        if end - back <= start:
            return
        start = end - back


@udtf(returnType="chunk_index long, header string, path array<string>, start long, end long, has_code boolean, text string", useArrow=True)
class MarkdownChunks:
    def eval(self, text: str, most: int = CHUNK, tail: int = TAIL):
        if text and text.strip():
            yield from markdown(text, int(most), int(tail))


@udtf(returnType="chunk_index long, start long, end long, page long, text string", useArrow=True)
class PageWindows:
    def eval(self, pages: list[str], size: int = WINDOW, overlap: float = OVERLAP):
        """Windows over the texts of all pages, one after the other; `page` counts from 1 and is that of the window's first character."""
        texts = [p or "" for p in pages] if pages is not None else []
        page, reached = 1, len(texts[0]) if texts else 0
        for index, start, end, part in windows("".join(texts), int(size), float(overlap)):
            while start >= reached and page < len(texts):
                reached += len(texts[page])
                page += 1
            yield index, start, end, page, part


def register(spark: SparkSession) -> None:
    """`markdown_chunks(text[, most, tail])` and `page_windows(pages[, size, overlap])` in SQL."""
    spark.udtf.register("markdown_chunks", MarkdownChunks)
    spark.udtf.register("page_windows", PageWindows)


def markdown_chunks(docs: DataFrame, key: str, text: str, most: int = CHUNK, tail: int = TAIL) -> DataFrame:
    """(key, chunk_index, header, path, start, end, has_code, text)."""
    from_docs = docs.select(key, F.col(text).alias("__text"))
    return from_docs.lateralJoin(MarkdownChunks(F.col("__text").outer(), F.lit(most), F.lit(tail))).drop("__text")


def page_windows(docs: DataFrame, key: str, pages: Column, size: int = WINDOW, overlap: float = OVERLAP) -> DataFrame:
    """(key, chunk_index, start, end, page, text) of an array of page texts."""
    from_docs = docs.select(key, pages.alias("__pages"))
    return from_docs.lateralJoin(PageWindows(F.col("__pages").outer(), F.lit(size), F.lit(overlap))).drop("__pages")
