"""Conversation repair against all edits in order, on random conversations, and on nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib

from venuelake.llm import role_repair
from venuelake.llm.role_repair import BLANK, CUT, DUPLICATE, FINE

NAMES = {"s": "system", "u": "user", "a": "assistant"}


def cheapest(rows, bound):
    """(cost, audit, roles) by trying every edit; ``rows``: (initial, fault)."""
    best = None

    def go(i, cost, audit, kept):
        nonlocal best
        if cost > bound or (best and cost > best[0]):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", kept):
            best = min(best, (cost, audit, kept)) if best else (cost, audit, kept)
        if not re.fullmatch("s?(ua)*u?", kept):
            return
        for role in "ua":
            go(i, cost + 3, audit + "I", kept + role)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", kept)
            if fault not in (BLANK, DUPLICATE):
                more = 3 if fault == CUT else 0
                if initial in "sua":
                    go(i + 1, cost + more, audit + "K", kept + initial)
                for role in "ua":
                    go(i + 1, cost + 3 + more, audit + "R", kept + role)

    go(0, 0, "", "")
    return best


def test_parser_against_all_edits():
    rng = random.Random(5)
    for n in (0, 1, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3, 3, 4):
        for _ in range(6):
            rows = [(rng.choice("suaua "), rng.choice((FINE, FINE, BLANK, DUPLICATE, CUT))) for _ in range(n)]
            cost, audit = role_repair.parse(b"".join(bytes((ord(i), f)) for i, f in rows))
            want = cheapest(rows, 4 * n)
            edits = list(role_repair.letters(audit))
            assert (cost, "".join(e for e, _ in edits)) == want[:2], rows
            assert "".join(r for e, r in edits if e != "D") == want[2]


def test_long_conversation_is_linear():
    """200,000 rows: items begin in the first column only."""
    cost, audit = role_repair.parse(bytes((ord("u"), FINE, ord("a"), FINE)) * 100_000)
    assert cost == 0 and sum(1 for e, _ in role_repair.letters(audit) if e == "K") == 200_000


def plain(rows):
    """The contract's row of one conversation; ``rows``: (turn, role, text) after damage."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes = set(), []
    for _, role, text in rows:
        bare = text.strip("\x20\t\n\x0b\f\r")
        fault = BLANK if not bare else DUPLICATE if (role, text) in seen else CUT if bare[-1] not in ".!?" else FINE
        seen.add((role, text))
        codes.append((role[:1] if role[:1] in ("s", "u", "a") else " ", fault))
    cost, audit, kept = cheapest(codes, 4 * len(rows))
    out, i, k = [], 0, 0
    for e in audit:
        row = None
        if e != "I":
            row, i = rows[i], i + 1
        if e != "D":
            out.append((row[1] if e == "K" else NAMES[kept[k]]) + ":" + (row[2] if row else ""))
            k += 1
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a + b for (a, _), (b, _) in zip(codes, codes[1:])]
    count = [sum(f == x for _, f in codes) for x in (BLANK, DUPLICATE, CUT)]
    return (gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string, there string, pos long, _copy int, fault string"


def test_repair(spark):
    rows = [
        (1, 0, "system", "Be short."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello."), (2, 0, "assistant", "No question."), (2, 5, "user", "cut off"),
        (3, 0, "user", "same."), (3, 0, "user", "same."), (3, 0, "assistant", "tie."), (3, 1, None, None), (4, None, "user", "no turn?"), (4, None, "tool", "é."),
        (4, -3, "assistant", "x" * 300_000 + "."), (None, 0, "user", "nobody?"), (None, 0, "assistant", "Nobody!"), (5, 0, "user", ""), (5, 1, "user", "\n \t"), (6, 3, "", "no role."),
    ]
    df = spark.createDataFrame([(*r, "t", 7, 1, "f") for r in rows], SCHEMA).repartition(3)
    ids = spark.createDataFrame([(1,), (9,), (None,)], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in role_repair.repair(df, ids).collect()}
    assert got == {c: plain([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows} | {9}}
    assert got[1][5:7] == (0, "KKK") and got[9] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert role_repair.repair(df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"A. b! {c}?") for c in range(40) for t in range(3)] + [(None, 1, "system", "a."), (7, None, None, None)]
    df = spark.createDataFrame([(*r, "t", 7, 1, "f") for r in rows], SCHEMA)
    want = []
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text or " ") if f == 2 else " " if text is None else text
        want += [(c, t, "user" if f == 4 else role or " ", text)] * (0 if f == 0 else 2 if f == 3 else 1)
    assert sorted(map(repr, map(tuple, role_repair.damaged(df).collect()))) == sorted(map(repr, want))
