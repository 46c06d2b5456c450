"""Conversations repaired to the grammar ``(s?(ua)+)?`` of role initials at the least cost.

Every feasible length has one target string: none, ``ua`` repeated, or that after an ``s``. A
conversation's rows are aligned to each by Wagner and Fischer's table, the closest lengths
first. The cheapest alignment so far bounds the band of the table (Ukkonen): a cell is left
out when the rows and letters on either side of it already cost more. Audits of equal cost are
compared after the way back through the table. Beyond ``LONG`` rows the table is folded: a
target repeats itself every two letters, so all lengths share four columns, which gives the
same audit in time proportional to the rows.

Two streams keep memory flat for any conversation. The first sorts rows without their texts
(a digest stands in) and holds a byte per row of the conversation at hand; the second runs
over rows with their texts in the same order and applies the audit as it goes. Repetitions of
a text within a conversation are found by an aggregate and a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.store import bounded_batches, pick

#: Prices of the edits, and what a truncated row costs unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a conversation up to which every length has a table of its own.
LONG = 128
BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}

REPORT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "conv long, place long, edit string, turn long, role string, text string"

# A row's code: its letter (s, u, a, or x for any other), capital if truncated; d must go.


def _feasible(n: int, limit: int) -> list[str]:
    """Targets that ``n`` rows can reach at a cost of at most ``limit``, the closest lengths first."""
    most = n + limit // INSERT
    lengths = [0, *(m for m in range(max(2, n - limit // DELETE), most + 1))]
    return ["s" * (m % 2) + "ua" * (m // 2) for m in sorted(set(lengths), key=lambda m: (abs(m - n), m))]


def _options(code: str, letter: str) -> tuple[str, int] | None:
    """Edit and price of turning a row into a letter of the target."""
    if code == "d":
        return None
    extra = TRUNCATED if code.isupper() else 0
    if code.lower() == letter:
        return "K", extra
    return None if letter == "s" else ("R", REROLE + extra)


def _to_target(codes: str, target: str, limit: int) -> tuple[int, str] | None:
    """Cost and least audit of turning rows into ``target``, unless it costs more than ``limit``."""
    n, m = len(codes), len(target)
    shift = m - n
    spare = limit - (INSERT * shift if shift > 0 else -DELETE * shift)
    if spare < 0:
        return None
    slack = spare // (INSERT + DELETE)
    low, high = min(shift, 0) - slack, max(shift, 0) + slack  # diagonals of the band
    never = limit + 1
    rest: dict[tuple[int, int], int] = {(n, m): 0}
    for i in range(n, -1, -1):
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            if (i, j) == (n, m):
                continue
            best = never
            if i < n:
                best = min(best, DELETE + rest.get((i + 1, j), never))
                turned = _options(codes[i], target[j]) if j < m else None
                if turned:
                    best = min(best, turned[1] + rest.get((i + 1, j + 1), never))
            if j < m and target[j] != "s":
                best = min(best, INSERT + rest.get((i, j + 1), never))
            if best < never:
                rest[i, j] = best
    if (0, 0) not in rest:
        return None
    audit, i, j = [], 0, 0
    while (i, j) != (n, m):  # D, I, K, R: the first edit that keeps the cost
        left = rest[i, j]
        if i < n and rest.get((i + 1, j), never) + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and rest.get((i, j + 1), never) + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append(_options(codes[i], target[j])[0])
            i, j = i + 1, j + 1
    return rest[0, 0], "".join(audit)


#: The folded target: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant.
_STEPS = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}


def _folded(codes: str) -> tuple[int, str]:
    """Cost and least audit over all targets at once, in four columns."""
    price = {c: [[_options(c, letter) for letter, _ in _STEPS[s]] for s in range(4)] for c in set(codes)}

    def inserted(row: list[int]) -> list[int]:
        for _ in range(3):
            row = [min(row[0], INSERT + row[2]), min(row[1], INSERT + row[2]), min(row[2], INSERT + row[3]), min(row[3], INSERT + row[2])]
        return row

    far = 1 << 60
    rows = [inserted([0, far, far, 0])]
    for code in reversed(codes):
        after, here = rows[-1], []
        for s in range(4):
            ways = [DELETE + after[s]]
            ways += [p[1] + after[to] for p, (_, to) in zip(price[code][s], _STEPS[s]) if p]
            here.append(min(ways))
        rows.append(inserted(here))
    rows.reverse()
    audit, i, s = [], 0, 0
    while i < len(codes) or rows[i][s]:
        left = rows[i][s]
        if i < len(codes) and DELETE + rows[i + 1][s] == left:
            audit.append("D")
            i += 1
            continue
        grown = 3 if s == 2 else 2
        if INSERT + rows[i][grown] == left:
            audit.append("I")
            s = grown
            continue
        for edit, turned, to in sorted((p[0], p[1], to) for p, (_, to) in zip(price[codes[i]][s], _STEPS[s]) if p):
            if turned + rows[i + 1][to] == left:
                audit.append(edit)
                i, s = i + 1, to
                break
    return rows[0][0], "".join(audit)


@lru_cache(maxsize=1 << 14)
def _aligned(codes: str) -> tuple[int, str]:
    best = (DELETE * len(codes), "D" * len(codes))
    for target in _feasible(len(codes), best[0]):
        found = _to_target(codes, target, best[0])
        if found:
            best = min(best, found)
    return best


def align(codes: str) -> tuple[int, str]:
    """The least cost of repairing rows with these codes, and the ASCII-least audit that has it."""
    return _aligned(codes) if len(codes) <= LONG else _folded(codes)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First stream: rows of a conversation in order to one line of its report."""
    held, out = None, []

    def closed() -> tuple:
        conv, codes, _, turns, n_turns, faults, illegal = held
        cost, audit = align("".join(codes))
        gaps = turns[1] - turns[0] + 1 - n_turns if n_turns else 0
        return conv, gaps, *faults, illegal, cost, audit

    def lines() -> pa.RecordBatch:
        names = [c.split()[0] for c in REPORT.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in REPORT.split(", ")]
        columns = list(zip(*out)) if out else [[] for _ in names]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for conv, turn, role, digest, copies, blank, truncated, later in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held[0] != conv:
                if held is not None:
                    out.append(closed())
                held = [conv, [], None, [None, None], 0, [0, 0, 0], 0]
            for _ in range(copies):
                row = (turn, role, digest)
                before = held[2]
                initial = role[:1]
                if before is not None and before[1][:1] + initial not in ("su", "ua", "au"):
                    held[6] += 1
                if turn is not None and (before is None or before[0] != turn):
                    held[3] = [turn if held[3][0] is None else held[3][0], turn]
                    held[4] += 1
                fault = 0 if blank else 1 if later or row == before else 2 if truncated else None
                if fault is not None:
                    held[5][fault] += 1
                code = initial if initial and initial in "sua" else "x"
                held[1].append("d" if fault in (0, 1) else code.upper() if fault == 2 else code)
                held[2] = row
        if len(out) >= 1000:
            yield lines()
            out = []
    if held is not None:
        out.append(closed())
    yield lines()


class _Walk:
    """Applies an audit to the rows of its conversation, one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.made = audit, 0, 0
        self.system = (len(audit) - audit.count("D")) % 2

    def _letter(self) -> str:
        self.made += 1
        return "s" if self.made <= self.system else "ua"[(self.made - self.system - 1) % 2]

    def inserted(self) -> Iterator[tuple]:
        """``(place, edit, role, text)`` of the turns to insert here."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.at - 1, "I", ROLES[self._letter()], ""

    def row(self, role: str, text: str) -> tuple:
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            letter = self._letter()
            role = role if edit == "K" else ROLES[letter]
        return self.at - 1, edit, role, text


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Second stream: ``("open", report)``, ``("edit", conv, turn, edit)`` and ``("close",)`` in order."""
    walk, conv = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if walk:
                    yield from (("edit", conv, None, e) for e in walk.inserted())
                    yield ("close",)
                walk, conv = _Walk(row["audit"]), row["conv"]
                yield "open", row
                continue
            for _ in range(row["copies"]):
                yield from (("edit", conv, None, e) for e in walk.inserted())
                yield "edit", conv, row["turn"], walk.row(row["role"], row["text"])
        yield ("pause",)
    if walk:
        yield from (("edit", conv, None, e) for e in walk.inserted())
        yield ("close",)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = f"{REPORT}, repaired_sha256 string".split(", ")
    kinds = {c.split()[0]: pa.string() if c.endswith("string") else pa.int64() for c in schema}
    out, report, state, any_ = [], None, None, False
    for event in _walked(batches):
        if event[0] == "open":
            report, state, any_ = event[1], hashlib.sha256(), False
        elif event[0] == "edit":
            _, edit, role, text = event[3]
            if edit != "D":
                state.update(f"{chr(10) if any_ else ''}{role}:{text}".encode())
                any_ = True
        elif event[0] == "close":
            out.append({**{k: report.get(k) for k in kinds}, "repaired_sha256": state.hexdigest()})
        if out and (event[0] == "pause" or len(out) >= 1000):
            yield pa.RecordBatch.from_pylist(out, pa.schema(list(kinds.items())))
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, pa.schema(list(kinds.items())))


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in TURNS.split(", ")])
    out = []
    for event in _walked(batches):
        if event[0] == "edit":
            place, edit, role, text = event[3]
            out.append({"conv": event[1], "place": place, "edit": edit, "turn": event[2], "role": role, "text": text})
        if out and (event[0] == "pause" or len(out) >= 1000):
            yield pa.RecordBatch.from_pylist(out, kinds)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, kinds)


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` of turns damaged by a hash of conversation and turn.

    Of twenty hash values 0 drops a row (no copies), 1 empties its text, 2 takes out its
    ``[.!?]``, 3 repeats it (two copies) and 4 makes it the user's. A null counts as one blank
    in the hash, and as a role or a text; ids and turns themselves stay null.
    """
    rows = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(named) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _rows(turns: DataFrame, copies_col: str | None) -> DataFrame:
    bounded_batches(turns.sparkSession)
    extra = {"copies": copies_col} if copies_col else {}
    rows = pick(turns, conv="conv_id", turn="turn", role="role", text="text", **extra)
    copies = F.coalesce(F.col("copies").cast("int"), F.lit(0)) if copies_col else F.lit(1)
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(
        F.col("conv").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), copies.alias("copies"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )


_ORDER = ["conv", "turn", "role", "digest"]  # nulls first


def _report(rows: DataFrame) -> DataFrame:
    """The first stream over all conversations."""
    last = F.rtrim(F.col("text"), F.lit(BLANKS))
    lean = rows.select(
        "conv", "turn", "role", "digest", "copies", (last == "").alias("blank"), (~F.substring(last, -1, 1).isin(".", "!", "?")).alias("truncated")
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = lean.where("copies > 0").groupBy("conv", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    seen = seen.where("n > 1").select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    later = F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first"))
    marked = lean.join(seen, same, "left").withColumn("later", later).drop("_c", "_r", "_d", "first")
    return marked.repartition("conv").sortWithinPartitions(*_ORDER).mapInArrow(_measure, REPORT)


def _together(rows: DataFrame, report: DataFrame) -> DataFrame:
    """Every conversation's report and then its rows, in order within a partition."""
    empty = [F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("copies", "int"), ("digest", "binary"))]
    head = report.select("*", *empty)
    more = [c.split() for c in REPORT.split(", ")[1:]]
    body = rows.where("copies > 0").select("conv", *[F.lit(None).cast(k).alias(c) for c, k in more], "turn", "role", "text", "copies", "digest")
    both = head.unionByName(body).withColumn("body", F.col("audit").isNull())
    return both.repartition("conv").sortWithinPartitions("conv", "body", *_ORDER[1:]).drop("digest", "body")


def repair_report(turns: DataFrame, copies_col: str | None = None) -> DataFrame:
    """One row per ``conv_id``: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost``, ``audit`` and ``repaired_sha256`` of the repaired ``role:text`` lines.

    Rows go by turn (nulls first), then role and the text's SHA-256, so the order of ties is
    defined. A null role or text is one blank, which no target has; rows without a conversation
    form one. With ``copies_col`` a row counts so often; at 0 or null it only names its
    conversation. A conversation without rows has zeros, no audit and the hash of nothing. An
    empty table gives no rows; other columns are ignored.
    """
    rows = _rows(turns, copies_col)
    names = ["conv_id", *[c.split()[0] for c in REPORT.split(", ")[1:]], "repaired_sha256"]
    return _together(rows, _report(rows)).mapInArrow(_hash, f"{REPORT}, repaired_sha256 string").toDF(*names)


def repaired_turns(turns: DataFrame, copies_col: str | None = None) -> DataFrame:
    """Every edit: ``conv_id``, ``place`` in the audit, ``edit``, ``turn``, new ``role`` and ``text``.

    Rows with another edit than D, by place, are the repaired conversation. Inserted turns have
    no ``turn``. Nulls and ties as in :func:`repair_report`.
    """
    rows = _rows(turns, copies_col)
    return _together(rows, _report(rows)).mapInArrow(_edit, TURNS).withColumnRenamed("conv", "conv_id")
