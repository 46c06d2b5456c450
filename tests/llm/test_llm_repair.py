"""Repaired conversations against a search over all edits and a plain walk over the rows."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from parlance.llm import repair
from parlance.llm.oracle import REPAIR


def every_repair(codes):
    """Cost and audit of all edit sequences that end in the grammar, by plain recursion."""
    grammar = {"": 1, "s": 0, "su": 0, "u": 0, "ua": 1}  # prefixes up to the first pair, whether complete

    @lru_cache(None)
    def rest(i, state, inserts):
        ways = [(0, "")] if i == len(codes) and grammar[state] else []
        letters = {"": "su", "s": "u", "su": "a", "u": "a", "ua": "u"}[state]
        then = lambda c: {"": c, "s": "su", "su": "ua", "u": "ua", "ua": "u"}[state]
        if inserts < 2 * len(codes) + 2:
            ways += [(5 + c, "I" + a) for x in letters if x != "s" for c, a in [rest(i, then(x), inserts + 1)] if c < 10**6]
        if i < len(codes):
            c, a = rest(i + 1, state, inserts)
            ways.append((2 + c, "D" + a))
            if codes[i] != "d":
                extra = 5 if codes[i].isupper() else 0
                for x in letters:
                    c, a = rest(i + 1, then(x), inserts)
                    if codes[i].lower() == x:
                        ways.append((extra + c, "K" + a))
                    if x != "s":
                        ways.append((1 + extra + c, "R" + a))
        return min(ways, default=(10**6, ""))

    return rest(0, "", 0)


def test_both_tables_find_the_cheapest_least_audit():
    rng = random.Random(3)
    for _ in range(1500):
        codes = "".join(rng.choice("suaxSUAXdua") for _ in range(rng.randint(0, 9)))
        want = every_repair(codes)
        assert repair.align(codes) == want
        assert repair._folded(codes) == want
    for _ in range(10):
        codes = "".join(rng.choice("suaxSUAXduauauaua") for _ in range(rng.randint(50, repair.LONG)))
        assert repair.align(codes) == repair._folded(codes)
    long = "ua" * 20000 + "dxUA" + "ua" * 20000
    assert repair.align(long) == (8, "K" * 40000 + "DDDD" + "K" * 40000)


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"), (1, 2, "assistant", "Hello!"), (1, 5, "user", "cut off"),
    (2, None, "user", "No turn."), (2, None, None, None), (2, 3, "tool", " \t\n"), (2, 4, "assistant", "Yes?\x0b "),
    (None, 0, "user", "No conversation."), (None, 1, "assistant", "Right."), (3, 7, "", "x."), (3, 8, "user", ""), (3, 9, "user", "x" * 100000 + "."),
] + [(c, t, r, f"{x}.") for c in range(10, 60) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "user", "user"][c % 2 :], "abcba"))]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as TURN_", "role as copies_")


def by_hand(rows):
    """Report and repaired lines of damaged rows ``(turn, role, text)`` in order."""
    codes, seen, counts, illegal = "", set(), {"b": 0, "d": 0, "t": 0}, 0
    for i, (_, role, text) in enumerate(rows):
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        counts.update({fault: counts.get(fault, 0) + 1})
        code = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "d" if fault in ("b", "d") else code.upper() if fault == "t" else code
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    cost, audit = every_repair(codes)
    odd, lines, todo = (len(audit) - audit.count("D")) % 2, [], list(rows)
    for edit in audit:
        row = todo.pop(0) if edit != "I" else None
        if edit != "D":
            at = len(lines) - odd
            role = row[1] if edit == "K" else ("user", "assistant")[at % 2]
            lines.append(f"{role}:{row[2] if row else ''}")
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, lines


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def damaged_by_hand(rows):
    out = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: in_order(r) for c, r in out.items()}


def test_report_and_turns_match_a_plain_walk(turns):
    damaged = repair.damage(turns.repartition(5))
    want = {c: by_hand(r) for c, r in damaged_by_hand(ROWS).items()}
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(damaged, copies_col="copies").collect()}
    assert got == {c: (*w[:-1], hashlib.sha256("\n".join(w[-1]).encode()).hexdigest()) for c, w in want.items()}
    lines = defaultdict(list)
    for r in repair.repaired_turns(damaged, copies_col="copies").orderBy("conv_id", "place").collect():
        if r.edit != "D":
            lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {c: w[-1] for c, w in want.items() if w[-1]}


def test_undamaged_rows_dropped_rows_and_none(spark, turns):
    got = {r.conv_id: r for r in repair.repair_report(turns).collect()}
    assert (got[1].audit, got[1].duplicate, got[1].gaps) == (by_hand(in_order([(t, r, x) for c, t, r, x in ROWS if c == 1]))[6], 1, 2)
    gone = spark.createDataFrame([(7, 1, "user", "x", 0), (7, 2, "user", "y", None)], "conv_id long, turn long, role string, text string, copies int")
    assert [tuple(r) for r in repair.repair_report(gone, "copies").collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_report(gone.limit(0)).count() == 0


def test_sql_twin_agrees_on_awkward_rows(turns):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    want = con.execute(REPAIR).fetchall()
    got = [tuple(r) for r in repair.repair_report(repair.damage(turns), copies_col="copies").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
