"""Structure repair of conversations by weighted interval parsing.

What a repaired conversation looks like is a language over role initials: nothing, or an optional s and then one or more of ``ua``. Its
automaton has four states: 0 (nothing yet), 1 (after s), U and A; 0 and A may end. The repair grammar is in Chomsky normal form over
spans of rows: a nonterminal [p, q] says that a span, edited, leads from state p to q. Its binary rules are [p, q] -> [p, r] [r, q]; its
terminal rules edit one row (Keep 0, Rerole 1, Delete 2, both of the first two 5 more on a truncated row; blank and repeated rows can only
go), closed under insertions (5 each) before and after. A cell of a span holds, for every nonterminal, the least (cost, audit) of all its
derivations, the audit being the edits' initials in order and ties going to the ASCII-least. Cells are combined bottom-up by span length.

Two facts keep that linear where a general grammar is cubic. First, as every pair of states has a nonterminal, any derivation of a span can
be bracketed anew at any inner split, so one split of a span finds the same cell as all of them (tested against all splits). Second, of two audits
of equal cost over the same rows neither is a proper prefix of the other, as an extra letter would be an insertion and cost; so least
parts make the least whole. Lengths therefore double: neighbours combine to spans of 2, 4, ... rows of a block, then 32 blocks to a block of the next round.

On Spark: rows are ranked by turn within their conversation as ranges (``ranks.ranked``), so no task holds a long conversation. Blocks of ``BLOCK``
rows become cells in one task each, of two letters a row and without texts. Texts move twice: when rows are ranked and when the edits are joined to them.
The digest of a repaired conversation is a stream over its sorted rows, as SHA-256 is sequential: the longest conversation bounds that one step's time, not its memory.

Nulls in role and text (in ids and turns where the query hashes them) are one space. Rows of equal turn are ordered by a hash of role and text;
rows of a null turn come first. Repeated rows are duplicates. A null id is a conversation. Empty input gives no rows; a conversation
that has lost all rows has zeros, an empty audit and the digest of the empty string. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import table
from docloom.llm.merkle import group_name
from docloom.llm.ranks import ranked
from docloom.llm.registry import register
from docloom.session import materialized

BLOCK, FAN = 1024, 32
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = ("su", "ua", "au")

# -- the grammar --------------------------------------------------------------------------------

STATES = "01UA"
START, ENDS = "0", "0A"
#: where a role initial leads
MOVES = {("0", "s"): "1", ("0", "u"): "U", ("1", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
#: nonterminals: pairs of states of which the first can reach the second
PAIRS = [(p, q) for p in STATES for q in STATES if p == q or (q != "0" and (p == "0" or q != "1"))]
AT = {pair: i for i, pair in enumerate(PAIRS)}
RULES = [[(AT[p, r], AT[r, q]) for r in STATES if (p, r) in AT and (r, q) in AT] for p, q in PAIRS]

Cell = list  # of (cost, audit) or None, by PAIRS


def combined(x: Cell, y: Cell) -> Cell:
    """The cell of a span from those of its two parts."""
    out = []
    for rules in RULES:
        best = None
        for i, j in rules:
            a, b = x[i], y[j]
            if a is not None and b is not None:
                cost = a[0] + b[0]
                if best is None or cost < best[0]:
                    best = (cost, a[1] + b[1])
                elif cost == best[0]:
                    best = min(best, (cost, a[1] + b[1]))
        out.append(best)
    return out


def inserted() -> Cell:
    """Insertion closure: the cell of an empty span."""
    once: Cell = [None] * len(PAIRS)
    for p in STATES:
        once[AT[p, p]] = (0, "")
    for (p, initial), q in MOVES.items():
        if initial != "s":
            once[AT[p, q]] = (INSERT, "I")
    closed = combined(once, once)
    while closed != once:
        once, closed = closed, combined(closed, closed)
    return closed


EMPTY = inserted()


def terminal(code: str) -> Cell:
    """The cell of one row: its role initial (? for any other) and its fault (b, d, t or -)."""
    initial, fault = code
    cell: Cell = [None] * len(PAIRS)

    def offer(pair: tuple[str, str], cost: int, letter: str) -> None:
        now = cell[AT[pair]]
        cell[AT[pair]] = (cost, letter) if now is None else min(now, (cost, letter))

    for p in STATES:
        offer((p, p), DELETE, "D")
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        for (p, x), q in MOVES.items():
            if x == initial:
                offer((p, q), KEEP + more, "K")
            if x != "s":
                offer((p, q), REROLE + more, "R")
    return combined(combined(EMPTY, cell), EMPTY)


TERMINALS = {a + b: terminal(a + b) for a in "sua?" for b in "bdt-"}


def parsed(cells: list[Cell]) -> Cell:
    """The cell of all spans in a row; spans of one length at a time."""
    while len(cells) > 1:
        pairs = [combined(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0] if cells else EMPTY


def chosen(cell: Cell) -> tuple[int, str]:
    return min(cell[AT[START, q]] for q in ENDS if cell[AT[START, q]] is not None)


# -- rows to codes ------------------------------------------------------------------------------


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) with pos, from 0 by turn, and code: role initial and first fault."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    plain = rows.select("conv", "turn", role.alias("role"), text.alias("text")).withColumn("same", key)
    placed = materialized(ranked(plain, "conv", ["turn", "same"], "dialogue"), "dialogue-rows")
    again = placed.groupBy("conv", "same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    left = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(left == "", "b")
        .when(F.col("pos") > F.col("first"), "d")
        .when(~F.substring(left, -1, 1).isin(".", "!", "?"), "t")
        .otherwise("-")
    )
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("?"), fault)
    return placed.join(again.drop("n"), ["conv", "same"], "left").select("conv", "pos", "turn", "role", "text", code.alias("code"))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
SPAN = [
    ("conv", pa.string()),
    ("block", pa.int64()),
    *[(c, pa.int64()) for c in COUNTS],
    ("first", pa.string()),
    ("last", pa.string()),
    ("cost", pa.list_(pa.int64())),
    ("audit", pa.list_(pa.string())),
]
SPAN_KINDS = "conv string, block long, blank long, duplicate long, truncated long, illegal long, first string, last string, cost array<long>, audit array<string>"


def _span(conv: str, block: int, counts: list[int], first: str, last: str, cell: Cell) -> tuple:
    return (conv, block, *counts, first, last, [x and x[0] for x in cell], [x and x[1] for x in cell])


def _batch(spans: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], kind) for i, (_, kind) in enumerate(SPAN)], [n for n, _ in SPAN])


def _of_codes(batches):
    """Blocks of rows, as strings of codes, to spans."""
    for batch in batches:
        spans = []
        for row in batch.to_pylist():
            initials, faults = row["codes"][::2], row["codes"][1::2]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            cell = parsed([TERMINALS[a + b] for a, b in zip(initials, faults)])
            counts = [faults.count(f) for f in "bdt"] + [illegal]
            spans.append(_span(row["conv"], row["block"], counts, initials[0], initials[-1], cell))
        yield _batch(spans)


def _of_spans(batches):
    """Neighbouring spans of a conversation to one."""
    for batch in batches:
        spans = []
        for row in batch.to_pylist():
            parts = row["parts"]
            counts = [sum(p[c] for p in parts) for c in COUNTS]
            counts[3] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
            cells = [[None if c is None else (c, a) for c, a in zip(p["cost"], p["audit"])] for p in parts]
            spans.append(_span(row["conv"], row["block"], counts, parts[0]["first"], parts[-1]["last"], parsed(cells)))
        yield _batch(spans)


def spans_of(rows: DataFrame, block_rows: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One span for each conversation of ``rows`` (conv, pos, code)."""
    cut = rows.select("conv", "pos", "code", F.floor(F.col("pos") / block_rows).alias("block"))
    inside = F.array_sort(F.collect_list(F.struct("pos", "code")))
    blocks = cut.groupBy("conv", "block").agg(F.array_join(F.transform(inside, lambda x: x["code"]), "").alias("codes"))
    spans = materialized(blocks.mapInArrow(_of_codes, SPAN_KINDS), "dialogue-spans")
    most = spans.agg(F.max("block")).first()[0] or 0
    while most:
        parts = F.array_sort(F.collect_list(F.struct("block", *COUNTS, "first", "last", "cost", "audit")))
        near = spans.groupBy("conv", F.floor(F.col("block") / fan).alias("up")).agg(parts.alias("parts"))
        spans = materialized(near.withColumnRenamed("up", "block").mapInArrow(_of_spans, SPAN_KINDS), "dialogue-spans")
        most //= fan
    return spans


# -- from audits to repaired rows ---------------------------------------------------------------


def _edits(batches):
    """(conv, audit) to a row per edit: pos of the row it takes, place in the repaired conversation, the role there."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            audits = [x.encode() for x in part.column(1).to_pylist()]
            size = np.array([len(a) for a in audits])
            letters = np.frombuffer(b"".join(audits), np.uint8)
            own = np.repeat(np.arange(len(audits)), size)
            takes, gives = letters != ord("I"), letters != ord("D")

            def within(mask, own=own, n=len(audits)):
                total = np.bincount(own, mask, minlength=n).astype(np.int64)
                return np.cumsum(mask) - 1 - (np.cumsum(total) - total)[own], total

            pos, _ = within(takes)
            place, kept = within(gives)
            user = (place - (kept % 2)[own]) % 2 == 0  # an odd number of rows begins with a system row
            conv = part.column(0).take(pa.array(own))
            edit = pa.array([chr(x) for x in letters.tolist()], pa.string())
            role = pa.array(np.where(user, "user", "assistant").tolist(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [conv, pa.array(pos, mask=~takes), pa.array(place, mask=~gives), edit, role], ["conv", "pos", "place", "edit", "due"]
            )


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, place, role, text, edit of every row of the repaired conversations, from ``rows`` as ``coded`` gives them."""
    edits = audits.select("conv", "audit").mapInArrow(_edits, "conv string, pos long, place long, edit string, due string")
    kept = edits.where("place IS NOT NULL").join(rows.select("conv", "pos", "role", "text"), ["conv", "pos"], "left")
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("due"))
    return kept.select("conv", "place", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def _digests(batches):
    """Rows sorted by (conv, place), to one digest each; a conversation may go on in the next batch."""
    now, sha = None, None
    for batch in batches:
        done = []
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if conv != now:
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = conv, hashlib.sha256(line.encode())
            else:
                sha.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["conv", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["conv", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """conv and the SHA-256 of the lines ``role:text``."""
    lines = repaired.repartition("conv").sortWithinPartitions("conv", "place")
    lines = lines.select("conv", F.concat_ws(":", "role", "text").alias("line"))
    return lines.mapInArrow(_digests, "conv string, repaired_sha256 string")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report of every conversation of ``rows`` (conv, turn, role, text; conv not null) and its repaired rows."""
    marked = materialized(coded(rows), "dialogue-coded")
    spans = spans_of(marked)
    sure = [F.struct(F.element_at("cost", i + 1).alias("cost"), F.element_at("audit", i + 1).alias("audit")) for i in (AT[START, q] for q in ENDS)]
    best = F.array_min(F.filter(F.array(*sure), lambda x: x["cost"].isNotNull()))
    spans = spans.select("conv", *COUNTS, best.alias("best")).select("conv", *COUNTS, "best.cost", "best.audit")
    turns = marked.where("turn IS NOT NULL").select("conv", "turn").distinct()
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    report = spans.join(turns.groupBy("conv").agg(span.alias("gaps")), "conv", "left")
    report = materialized(report.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))), "dialogue-report")
    return report, repaired_rows(marked, report)


# -- the query ----------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with a fifth of them or so dropped, emptied, cut, repeated or given another role."""

    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text, role = name("text"), name("role")
    text = F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(case == 4, "user").otherwise(role)
    times = F.array_repeat(F.lit(1), F.when(case == 0, 0).when(case == 3, 2).otherwise(1))
    out = rows.select(group_name(F.col("conv_id")).alias("conv"), "turn", role.alias("role"), text.alias("text"), F.explode(times))
    return out.drop("col")


_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({_KEY})),
  lambda i: ord(substr({_KEY}, i + 1, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
_STRIP = "rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"

SQL = f"""
WITH RECURSIVE cases AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS d FROM conversations),
hurt AS (
  SELECT conv_id, coalesce('=' || conv_id, '') AS conv, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM cases, range(2) c(i) WHERE d <> 0 AND (i = 0 OR d = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
    {_STRIP} AS bare FROM hurt),
copies AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) AS copy FROM placed),
marked AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN copy > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    left(role, 1) AS ini, lead(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) AS next FROM copies),
counted AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (next IS NOT NULL AND ini || next NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv),
moves(p, ini, q) AS (VALUES ('0', 's', '1'), ('0', 'u', 'U'), ('1', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')),
closure(p, q, cost, letters) AS (VALUES ('0', '0', 0, ''), ('1', '1', 0, ''), ('U', 'U', 0, ''), ('A', 'A', 0, ''),
  ('0', 'U', 5, 'I'), ('0', 'A', 10, 'II'), ('1', 'U', 5, 'I'), ('1', 'A', 10, 'II'), ('U', 'A', 5, 'I'), ('A', 'U', 5, 'I')),
edits(p, q, ini, letter, cost) AS (
  SELECT p, p, NULL, 'D', 2 FROM (VALUES ('0'), ('1'), ('U'), ('A')) s(p)
  UNION ALL SELECT p, q, ini, 'K', 0 FROM moves
  UNION ALL SELECT p, q, NULL, 'R', 1 FROM moves WHERE ini <> 's'),
dp AS (
  SELECT c.conv, 0::BIGINT AS pos, x.q AS state, lpad(x.cost::VARCHAR, 9, '0') || x.letters AS best FROM counted c, closure x WHERE x.p = '0'
  UNION ALL
  SELECT dp.conv, dp.pos + 1, x.q,
    min(lpad((left(dp.best, 9)::BIGINT + e.cost + x.cost + CASE WHEN e.letter <> 'D' AND m.fault = 't' THEN 5 ELSE 0 END)::VARCHAR, 9, '0')
      || substr(dp.best, 10) || e.letter || x.letters)
  FROM dp JOIN marked m ON m.conv = dp.conv AND m.pos = dp.pos JOIN edits e ON e.p = dp.state AND (e.ini IS NULL OR e.ini = m.ini)
    JOIN closure x ON x.p = e.q
  WHERE e.letter = 'D' OR m.fault NOT IN ('b', 'd') GROUP BY dp.conv, dp.pos, x.q),
best AS (
  SELECT c.conv, left(min(best), 9)::BIGINT AS cost, substr(min(best), 10) AS audit
  FROM dp JOIN counted c ON c.conv = dp.conv AND c.n = dp.pos WHERE dp.state IN ('0', 'A') GROUP BY c.conv),
letters AS (SELECT conv, i, substr(audit, i::INT, 1) AS letter FROM best, unnest(range(1, length(audit) + 1)) r(i)),
steps AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w - 1 AS pos, count(*) FILTER (letter <> 'D') OVER w - 1 AS place,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv) AS kept
  FROM letters WINDOW w AS (PARTITION BY conv ORDER BY i)),
mended AS (
  SELECT s.conv, sha256(string_agg(CASE WHEN s.letter = 'K' THEN m.role WHEN (s.place - s.kept % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN s.letter = 'I' THEN '' ELSE m.text END, chr(10) ORDER BY s.place)) AS digest
  FROM steps s LEFT JOIN marked m ON m.conv = s.conv AND m.pos = s.pos AND s.letter <> 'I' WHERE s.letter <> 'D' GROUP BY s.conv)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost,
  coalesce(b.audit, '') AS audit, coalesce(e.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS conv FROM conversations) o
LEFT JOIN counted c ON c.conv = o.conv LEFT JOIN best b ON b.conv = o.conv LEFT JOIN mended e ON e.conv = o.conv
"""


def repair_report(conversations: DataFrame) -> DataFrame:
    """A row per original conversation: faults, gaps, cost, audit and digest of its repair after damage."""
    report, mended = repaired(damaged(conversations))
    every = conversations.select("conv_id", group_name(F.col("conv_id")).alias("conv")).distinct()
    out = every.join(report, "conv", "left").join(digests(mended), "conv", "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS, "cost")]
    empty = F.sha2(F.lit(""), 256)
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


@register("op12_dialogue", SQL)
def op12(spark, sf_dir):
    return repair_report(table(spark, sf_dir, "conversations"))
