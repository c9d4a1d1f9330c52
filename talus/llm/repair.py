"""Repair of conversations by generalised LR parsing over the grammar of roles.

A conversation is right if it is empty or its role initials are (s?(ua)+). Edits are K, keep a row (0); R, rerole it to user or assistant
(1); D, delete it (2); and I, insert an empty row of user or assistant (5). A row that is blank (no character but white space) or a
duplicate (role and text were seen earlier) must go; a truncated one (its last character other than white space is none of . ! ?)
costs 5 more if it stays.

The parser reads a conversation's rows with a graph-structured stack whose tops are states of the role grammar. Each row extends
each top by every edit that the state has a shift for, insertions before it included; tops of equal state are merged to the one
of least (cost, audit), the audit being the edits' initials so far. That is exact: the grammar is regular, so a state alone says what
may follow, and at equal cost no audit is the beginning of another, since each ends with the edit of the same row. Where a stack
stands, relative to its cheapest top, has few forms, so steps are remembered.

Rows that repeat in all columns are one row with a count before anything is sorted, and texts are shuffled by a digest of the whole row,
so that neither repeated rows nor a long conversation gather texts in one task. What is sorted by conversation are digests and
marks, some hundred bytes a row. A task parses conversations one after the other and holds these of one conversation; the edits
go back to the texts by digest. (`summaries` has a hash of each repaired conversation and so its text in one row.)

Defined results: a null role or text is one blank. Rows stand by turn, null turns first, then by role, then by the digest of the row.
A role of no character has no initial. A null conv_id is a conversation of its own. Texts of any length are treated whole. An empty
table gives no rows. Columns other than conv_id, turn, role and text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: The role grammar: state, what may be shifted, next state. 0: nothing yet, 1: after s, 2: after u, 3: after a.
SHIFTS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPT = (0, 3)
RIGHT_PAIRS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Edits as they are written for a row: K, D, U and A for a new role, u and a for an inserted row before or after it.
INITIALS = str.maketrans("UAua", "RRII")
FULL = {"u": "user", "a": "assistant"}
OPENING = ((0, 0, 0),)


@cache
def _inserts(state: int) -> tuple[tuple[str, int], ...]:
    """What may be inserted in a state, each next state once, by the fewest rows; nothing comes first."""
    found = {state: ""}
    while True:
        more = {to: letters + role for at, letters in found.items() for role, to in SHIFTS[at].items() if role in FULL and to not in found}
        if not more:
            return tuple((letters, to) for to, letters in found.items())
        found |= more


@cache
def step(tops: tuple[tuple[int, int, int], ...], initial: str, must_go: bool, truncated: bool) -> tuple[int, tuple, tuple]:
    """What is added to the least cost, the next tops (state, cost above the least, rank of the audit), and for each the (earlier place, edits)."""
    best: dict[int, tuple] = {}

    def offer(state: int, cost: int, rank: int, letters: str, place: int) -> None:
        new = (cost, rank, letters.translate(INITIALS), letters, place)
        if state not in best or new < best[state]:
            best[state] = new

    for place, (state, cost, rank) in enumerate(tops):
        offer(state, cost + DELETE, rank, "D", place)  # an insertion before it would be later in order if after it
        for inserted, at in () if must_go else _inserts(state):
            spent = cost + INSERT * len(inserted) + TRUNCATED * truncated
            for role, to in SHIFTS[at].items():
                if role == initial:
                    offer(to, spent, rank, inserted + "K", place)
                if role in FULL:
                    offer(to, spent + REROLE, rank, inserted + role.upper(), place)
    least = min(b[0] for b in best.values())
    ordered = sorted(best.items(), key=lambda b: b[1][1:3])
    ranks = {state: i for i, (state, _) in enumerate(ordered)}
    return least, tuple((s, b[0] - least, ranks[s]) for s, b in ordered), tuple((b[4], b[3]) for _, b in ordered)


class Parser:
    """Reads one conversation's rows (initial, must go, truncated); keeps for each row how its tops came about."""

    def __init__(self) -> None:
        self.tops, self.cost, self.links = OPENING, 0, []

    def push(self, initial: str, must_go: bool, truncated: bool) -> None:
        added, self.tops, back = step(self.tops, initial, must_go, truncated)
        self.cost += added
        self.links.append(back)

    def finish(self) -> tuple[int, list[str], str]:
        """The least cost, the edits of each row, and what is inserted at the end."""
        ends = [(cost + INSERT * len(letters), rank, place, letters) for place, (state, cost, rank) in enumerate(self.tops) for letters, to in _inserts(state) if to in ACCEPT]
        cost, _, place, tail = min(ends)
        edits = []
        for back in reversed(self.links):
            place, letters = back[place]
            edits.append(letters)
        return self.cost + cost, edits[::-1], tail


def distinct_rows(turns: DataFrame) -> DataFrame:
    """Each distinct row once: digest, conv_id, turn, role, text, n (how often)."""
    filled = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    numbers = [F.coalesce(F.hex(F.col(c).cast("string")), F.lit("null")) for c in ("conv_id", "turn")]
    digest = F.sha2(F.concat_ws("\n", *numbers, F.hex("role"), "text"), 256)
    return filled.groupBy(digest.alias("digest")).agg(*[F.first(c).alias(c) for c in ("conv_id", "turn", "role", "text")], F.count("*").alias("n"))


def _marks(rows: DataFrame) -> DataFrame:
    """Digests of the rows in the order of their conversations, with what the parser reads and counts that add up over a conversation.

    Of equal rows, `must_go` and the row's own fault are the first one's; the others are blank or duplicates, go for DELETE each, and
    make pairs of equal roles, which the grammar doesn't have.
    """
    last = F.right(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", ""), F.lit(1))
    said = F.sha2(F.concat_ws("\n", F.hex("role"), "text"), 256)
    marks = rows.select("digest", "conv_id", "turn", "role", "n", said.alias("said"), last.alias("last"), F.left("role", F.lit(1)).alias("initial"))
    order = [F.asc_nulls_first("turn"), "role", "digest"]
    earlier = F.row_number().over(Window.partitionBy("conv_id", "said").orderBy(*order)) > 1
    again, blank, duplicate = F.col("n") - 1, F.col("last") == "", F.col("duplicate")
    marks = marks.withColumn("duplicate", ~blank & earlier).withColumn("truncated", ~blank & ~duplicate & ~F.col("last").isin(".", "!", "?"))
    here = Window.partitionBy("conv_id").orderBy(*order)
    pair, before = F.concat(F.lag("initial").over(here), F.col("initial")), F.lag("turn").over(here)
    return marks.repartition("conv_id").select(
        "digest", F.row_number().over(here).cast("long").alias("place"), "initial", (blank | duplicate).alias("must_go"), F.col("truncated").alias("cut_off"),
        F.when(blank, F.col("n")).otherwise(0).alias("blank"),
        F.when(blank, 0).otherwise(again + duplicate.cast("long")).alias("duplicate"),
        F.col("truncated").cast("long").alias("truncated"),
        (again + F.coalesce(~pair.isin(*RIGHT_PAIRS), F.lit(False)).cast("long")).alias("illegal"),
        F.when(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(before), 1).otherwise(0).cast("long").alias("turns"),
        (DELETE * again).alias("cost"),
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "cost")


def edits(rows: DataFrame) -> DataFrame:
    """digest, place, `edits` of the first of equal rows (the others are deleted), the `tail` inserted after them, and counts.

    The cost of the parse stands with a conversation's first row.
    """
    kept = ["digest", "place", *COUNTS]

    def repaired(held: list[pa.RecordBatch], parser: Parser) -> Iterator[pa.RecordBatch]:
        cost, letters, tail = parser.finish()
        done = 0
        for rows in held:
            n = rows.num_rows
            tails = [""] * n
            costs = rows.column("cost").to_pylist()
            if not done:
                costs[0] += cost
            done += n
            if done == len(letters):
                tails[-1] = tail
            columns = [rows.column(c) for c in kept[:-1]] + [pa.array(costs, pa.int64()), pa.array(letters[done - n : done]), pa.array(tails)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "edits", "tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parser = [], Parser()
        for batch in batches:
            lo = 0
            for i, (place, *row) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("place", "initial", "must_go", "cut_off")], strict=True)):
                if place == 1:
                    if i > lo:
                        held.append(batch.slice(lo, i - lo))
                    yield from repaired(held, parser)
                    held, parser, lo = [], Parser(), i
                parser.push(*row)
            held.append(batch.slice(lo))
        yield from repaired(held, parser)

    types = {"digest": "string"}
    schema = ", ".join(f"{c} {types.get(c, 'long')}" for c in kept)
    return _marks(rows).mapInArrow(run, f"{schema}, edits string, tail string")


def repair(turns: DataFrame) -> DataFrame:
    """Distinct rows with their edits, and `output`: the rows (role, text) that come of each."""
    rows = cut(distinct_rows(turns))  # read twice
    joined = rows.join(edits(rows), "digest")
    letters = F.split(F.concat("edits", "tail"), "")
    kept = F.filter(letters, lambda x: (x != "D") & (x != ""))

    def line(x: Column) -> Column:
        spoken = F.when(F.lower(x) == "u", F.lit("user")).when(F.lower(x) == "a", F.lit("assistant")).otherwise(F.col("role"))
        return F.struct(spoken.alias("role"), F.when(x.isin("u", "a"), F.lit("")).otherwise(F.col("text")).alias("text"))

    return joined.withColumn("output", F.transform(kept, line))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, part, role, text): the rows of the repaired conversations, in the order of place and part."""
    return repair(turns).select("conv_id", "place", F.posexplode("output").alias("part", "o")).select("conv_id", "place", "part", "o.role", "o.text")


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults, by the crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its . ! ? away, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    changed = rows.select(
        "conv_id", "turn", kind.alias("kind"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    )
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1))
    return changed.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def summaries(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each of `conversations` (conv_id): gaps between its turns, their faults, the cheapest repair, and the hash of the repaired text."""
    done = repair(turns)
    audit = F.translate(F.concat("edits", F.repeat(F.lit("D"), (F.col("n") - 1).cast("int")), "tail"), "UAua", "RRII")
    lines = F.transform("output", lambda o: F.concat(o["role"], F.lit(":"), o["text"]))
    each = done.select("conv_id", "turn", "blank", "duplicate", "truncated", "illegal", "turns", "cost", F.struct("place", audit.alias("audit"), lines.alias("lines")).alias("part"))
    whole = each.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.sum("turns")).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_sort(F.collect_list("part")).alias("parts"),
    )
    repaired = F.array_join(F.flatten(F.transform("parts", lambda p: p["lines"])), "\n")
    found = whole.select(F.col("conv_id").alias("of"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"), F.sha2(repaired, 256).alias("repaired_sha256"))
    every = conversations.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ORACLE = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (  -- crc32 of the name, a bit at a time: -1 stands for a shift
  SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(name, ''), lambda c: [CAST(unicode(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS kind FROM named),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
    sha256(concat_ws(chr(10), coalesce(hex(CAST(conv_id AS VARCHAR)), 'null'), coalesce(hex(CAST(turn AS VARCHAR)), 'null'), hex(role), text)))),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
flagged AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, last = '' AS blank, last <> '' AND seen > 1 AS duplicate,
         last <> '' AND seen = 1 AND last NOT IN ('.', '!', '?') AS truncated, i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM numbered),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM flagged GROUP BY conv_id),
shifts(state, role, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(state, k, lines, next) AS (
  SELECT state, 0, '', state FROM (VALUES (0), (1), (2), (3)) v(state)
  UNION ALL SELECT state, 1, CASE role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10), next FROM shifts WHERE role <> 's'
  UNION ALL SELECT state, 2, 'user:' || chr(10) || 'assistant:' || chr(10), 3 FROM (VALUES (0), (1), (3)) v(state)),
moves AS (
  SELECT state, 0 AS k, '' AS lines, 'D' AS kind, '' AS role, state AS next FROM (VALUES (0), (1), (2), (3)) v(state)
  UNION ALL SELECT i.state, k, lines, 'K', role, s.next FROM inserts i JOIN shifts s ON i.next = s.state
  UNION ALL SELECT i.state, k, lines, 'R', CASE role WHEN 'u' THEN 'user' ELSE 'assistant' END, s.next FROM inserts i JOIN shifts s ON i.next = s.state WHERE role <> 's'),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'repaired': ''} AS top FROM counts
  UNION ALL
  SELECT w.conv_id, r.i, m.next, min({
    'cost': w.top.cost + 5 * k + CASE kind WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN truncated AND kind <> 'D' THEN 5 ELSE 0 END,
    'audit': w.top.audit || repeat('I', k) || kind,
    'repaired': w.top.repaired || CASE kind WHEN 'D' THEN '' ELSE lines || CASE kind WHEN 'K' THEN r.role ELSE m.role END || ':' || r.text || chr(10) END})
  FROM walk w JOIN flagged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
  JOIN moves m ON m.state = w.state AND (kind = 'D' OR NOT blank AND NOT duplicate AND (kind = 'R' OR m.role = initial))
  GROUP BY w.conv_id, r.i, m.next),
ends AS (
  SELECT w.conv_id, min({'cost': top.cost + 5 * k, 'audit': top.audit || repeat('I', k), 'repaired': top.repaired || lines}) AS top
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts s ON s.state = w.state WHERE s.next IN (0, 3) GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(top.cost, 0) AS cost, coalesce(top.audit, '') AS audit, sha256(coalesce(left(top.repaired, length(top.repaired) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
