"""Conversation repair against full CYK with every split, against all edit sequences, and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from docloom.llm import dialogue

GOOD = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def every_split(codes):
    """Textbook CYK: all spans by length, all splits."""
    n = len(codes)
    cells = {(i, i + 1): dialogue.TERMINALS[c] for i, c in enumerate(codes)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            found = [dialogue.combined(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)]
            cells[i, i + length] = [min((f[p] for f in found if f[p] is not None), default=None) for p in range(len(dialogue.PAIRS))]
    return cells[0, n]


def all_edits(codes, inserts=2):
    """The cheapest audit by trying every edit of every row and up to ``inserts`` insertions in every gap."""
    best = None
    row_edits = [["D"] if c[1] in "bd" else ["D", "K", "Ru", "Ra"] for c in codes]
    gaps = [g for k in range(inserts + 1) for g in itertools.product("ua", repeat=k)]
    for edits in itertools.product(*row_edits):
        for filled in itertools.product(gaps, repeat=len(codes) + 1):
            roles, audit, cost = "", "", 0
            for k, gap in enumerate(filled):
                roles, audit, cost = roles + "".join(gap), audit + "I" * len(gap), cost + 5 * len(gap)
                if k < len(codes):
                    e = edits[k]
                    roles += "" if e == "D" else codes[k][0] if e == "K" else e[1]
                    audit += e[0]
                    cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 if e != "D" and codes[k][1] == "t" else 0)
            if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_cells_equal_all_splits_and_all_edits():
    r = random.Random(2)
    kinds = list(dialogue.TERMINALS)
    for n in (1, 2, 3):
        for _ in range(25 if n < 3 else 12):
            codes = [r.choice(kinds) for _ in range(n)]
            assert dialogue.chosen(dialogue.parsed([dialogue.TERMINALS[c] for c in codes])) == all_edits(codes, 2 if n < 3 else 1), codes
    for _ in range(60):
        codes = [r.choice(kinds) for _ in range(r.randint(2, 14))]
        assert dialogue.parsed([dialogue.TERMINALS[c] for c in codes]) == every_split(codes), codes


def plain(rows):
    """The whole contract again, in plain Python: a shortest path over (row, state) with least audits."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            say = lambda v: " " if v is None else str(v)
            d = zlib.crc32(f"{say(c)}:{say(turn)}".encode()) % 20
            role, text = say(role), say(text)
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            kept += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        key = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, key(x)))
        faults, seen = "", set()
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        moves = {("0", "s"): "1", ("0", "u"): "U", ("1", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}

        def better(best, state, value):
            if state not in best or (value[0], value[1]) < (best[state][0], best[state][1]):
                best[state] = value
                return True
            return False

        def closed(best):
            todo = list(best)
            while todo:
                p = todo.pop()
                for (a, x), q in moves.items():
                    if a == p and x != "s":
                        cost, audit, lines = best[p]
                        if better(best, q, (cost + 5, audit + "I", lines + [("user" if x == "u" else "assistant") + ":"])):
                            todo.append(q)
            return best

        best = closed({"0": (0, "", [])})
        for (_, role, text), f in zip(kept, faults):
            now = {}
            for p, (cost, audit, lines) in best.items():
                better(now, p, (cost + 2, audit + "D", lines))
                if f in "bd":
                    continue
                more = 5 if f == "t" else 0
                for (a, x), q in moves.items():
                    if a == p and x == role[:1]:
                        better(now, q, (cost + more, audit + "K", lines + [f"{role}:{text}"]))
                    if a == p and x != "s":
                        better(now, q, (cost + 1 + more, audit + "R", lines + [("user" if x == "u" else "assistant") + f":{text}"]))
            best = closed(now)
        cost, audit, lines = min((best[s] for s in "0A" if s in best), key=lambda v: v[:2])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.fixture(scope="module")
def talk():
    r = random.Random(8)
    texts = ["Yes.", "No!", "Why? ", "and so", "  ", "", None, "É\t."]
    rows = []
    for conv in [None, *range(120)]:
        for t in range(r.randint(1, 9)):
            turn = None if r.random() < 0.1 else t * r.choice([1, 1, 3])
            rows.append((conv, turn, r.choice(["system", "user", "assistant", "tool", "", None, "user", "assistant"]), r.choice(texts) or None))
    rows += [(500, t, ["user", "assistant"][t % 2], f"turn {t}." if t % 11 else "cut") for t in range(3000)]
    rows += [(501, 0, "user", "x" * 1_000_000 + "."), (501, 1, "assistant", "word " * 100_000)]
    rows += [(502, 5, "user", "Again.")] * 40
    return rows


def test_reports_equal_a_plain_search(spark, talk):
    df = spark.createDataFrame(talk, SCHEMA).selectExpr("*", "'?' conv", "'?' block", "1 pos", "'?' code", "'?' audit", "'?' same")
    assert found(dialogue.repair_report(df.repartition(5))) == plain(talk)


def test_long_conversations_are_parsed_in_blocks(spark, talk):
    rows = spark.createDataFrame(talk, SCHEMA).where("conv_id = 500")
    marked = dialogue.coded(dialogue.damaged(rows)).cache()
    whole = dialogue.spans_of(marked, block_rows=100_000).drop("block").collect()
    assert whole == dialogue.spans_of(marked, block_rows=64, fan=4).drop("block").collect()


def test_empty_and_dropped(spark):
    assert dialogue.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    report = found(dialogue.repair_report(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)))
    assert report == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
