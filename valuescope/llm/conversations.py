"""Repair of the turn structure of conversations by dynamic programming on a grammar.

A conversation's rows are symbols: the role's initial (s, u, a or another) and the
fault. An edit keeps, reroles or deletes a row or inserts one; the kept and new
roles must read (s?(ua)+)?, a machine of four states. A symbol's transfer matrix
says for each pair of states the least cost and, of the cheapest edits, the ASCII-least
audit (initials of the edits; inserts belong to the row that follows them).

1. Equal rows of a conversation and turn are one row with a count, so copies are
   summed before anything is dealt. A role and text that an earlier turn has is a
   duplicate; only those that stand in several turns are joined back.
2. Rows are dealt by ranges of (conversation, turn, role, digest) and sorted, so that
   a long conversation spans many tasks. A task cuts its rows into segments of at
   most SEGMENT rows; conversations that begin and end in it are whole.
3. The symbol sequences of a batch become a grammar by Re-Pair: the most frequent pair
   is a new symbol until no pair repeats. Each rule has one min-plus product of the
   two matrices of its pair, with a rope instead of a text for the audit. Matrices are
   made bottom-up once and shared by all conversations of the batch; equal sequences
   are solved once.
4. Two audits from one state to two states differ, neither begins with the other (each
   ends with the edit of the last row, and edits fix the states), so a matrix needs
   only the order of its audits: ropes are never compared, only written at the end.
5. Whole conversations are finished there. Of others the segments' matrices (numbers
   only) meet to find the states between segments; each segment then writes its part,
   and a task per conversation reads the parts in order for the digest, holding one.

Nulls in conv_id and turn read as one space where a row's damage is drawn; a null conv_id
is a conversation like any other, null turns go first. Null role and text are one space.
Rows of one turn go by role, then by the digest of role and text. Repeated rows are
duplicates. A role whose initial is not s, u or a (an empty role too) cannot be kept. An empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuescope.llm.common import saved

START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
INITIALS = "sua"
MUST = 0  # symbol of a row that has to go; others are 1 + 2 * initial + truncated
LEGAL = {"su", "ua", "au"}
#: States that inserts lead to, with their number.
INSERTED = {START: {START: 0, AFTER_U: 1, AFTER_A: 2}, AFTER_S: {AFTER_S: 0, AFTER_U: 1, AFTER_A: 2},
            AFTER_U: {AFTER_U: 0, AFTER_A: 1}, AFTER_A: {AFTER_A: 0, AFTER_U: 1}}
KEPT = ({START: AFTER_S}, {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, {AFTER_U: AFTER_A}, {})
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
ENDS = {START: 0, AFTER_S: 2, AFTER_U: 1, AFTER_A: 0}
#: Rows and characters of a segment, and of what a task solves at once.
SEGMENT, SEGMENT_CHARS, BATCH, BATCH_CHARS = 4096, 1 << 22, 1 << 16, 1 << 24

#: (cost, order of the audit among those of its row of the matrix, rope) or None; a rope is a text or a pair of ropes.
Cell = tuple[int, int, object]
Matrix = tuple[tuple[Cell | None, ...], ...]


def ordered(found: list[tuple[int, object, object] | None]) -> tuple[Cell | None, ...]:
    """Cells of (cost, sort key, rope): the keys of a row are all different."""
    place = {k: n for n, k in enumerate(sorted(x[1] for x in found if x))}
    return tuple(x and (x[0], place[x[1]], x[2]) for x in found)


def of_symbol(symbol: int) -> Matrix:
    initial, cut = divmod(symbol - 1, 2)
    rows = []
    for q in range(4):
        best: list = [None] * 4
        for r, n in INSERTED[q].items():
            steps = [(DELETE, "D", r)]
            if symbol != MUST:
                steps.append((REROLE + CUT * cut, "R", NEXT[r]))
                if r in KEPT[initial]:
                    steps.append((KEEP + CUT * cut, "K", KEPT[initial][r]))
            for cost, letter, to in steps:
                x = (cost + INSERT * n, "I" * n + letter)
                if best[to] is None or x < best[to]:
                    best[to] = x
        rows.append(ordered([x and (x[0], x[1], x[1]) for x in best]))
    return tuple(rows)


def step(row: tuple[Cell | None, ...], m: Matrix) -> tuple[Cell | None, ...]:
    """A row of a matrix times a matrix."""
    best: list = [None] * 4
    for r, left in enumerate(row):
        if left:
            for to, right in enumerate(m[r]):
                if right:
                    x = (left[0] + right[0], left[1], right[1], left[2], right[2])
                    if best[to] is None or x[:2] < best[to][:2]:
                        best[to] = x
    return ordered([x and (x[0], x[1:3], (x[3], x[4])) for x in best])


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(step(row, b) for row in a)


UNIT: Matrix = tuple(tuple((0, 0, "") if q == r else None for r in range(4)) for q in range(4))


def written(rope: object) -> str:
    out, open_ = [], [rope]
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            open_ += [x[1], x[0]]
    return "".join(out)


def re_pair(sequences: list[str]) -> tuple[list[str], dict[str, str]]:
    """The sequences with repeated pairs as new characters, and the pair of each new character in order of making."""
    text, rules, free = "\n".join(sequences), {}, 0x100
    while True:
        pairs = Counter(zip(text, text[1:]))
        pair, n = min(((p, n) for p, n in pairs.items() if "\n" not in p), key=lambda x: (-x[1], x[0]), default=(None, 0))
        both = "".join(pair or "")
        if n < 2 or text.count(both) < 2:  # the first count sees aaa as two pairs
            return text.split("\n"), rules
        if free == 0xD800:
            free = 0xE000
        rules[chr(free)] = both
        text, free = text.replace(both, chr(free)), free + 1


class Grammar:
    """Matrices of the symbols and rules of some sequences of symbols 0 to 8."""

    def __init__(self, sequences: list[str]):
        self.short, rules = re_pair(sequences)
        self.matrix = {chr(FIRST + s): of_symbol(s) for s in range(9)}
        for c, (a, b) in rules.items():
            self.matrix[c] = times(self.matrix[a], self.matrix[b])

    def row(self, k: int) -> tuple[Cell | None, ...]:
        """From START through sequence k."""
        row = UNIT[START]
        for c in self.short[k]:
            row = step(row, self.matrix[c])
        return row

    def whole(self, k: int) -> Matrix:
        m = UNIT
        for c in self.short[k]:
            m = times(m, self.matrix[c])
        return m


FIRST = 0x30  # symbols as characters


def ending(row: tuple[Cell | None, ...]) -> tuple[int, int]:
    """(cost, state) of the best end; where costs are equal, the audits' order decides."""
    found = [(x[0] + INSERT * ENDS[q], x[1], q) for q, x in enumerate(row) if x]
    cost, _, q = min(found)
    return cost, q


def repaired(audit: str, rows: list[tuple[str, str]], state: int) -> tuple[list[str], int]:
    """``role:text`` of what the edits leave, from a state on, and the state after; ``rows`` are those before the edits."""
    out, rest = [], iter(rows)
    for letter in audit:
        role, text = next(rest) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[INITIALS.index(role[0])][state]
        else:
            state = NEXT[state]
            role = "assistant" if state == AFTER_A else "user"
        out.append(f"{role}:{text}")
    return out, state


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (2 where the row is repeated), digest, blank, cut."""
    space = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    d = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), space("role").alias("role"),
                    space("text").alias("text"), F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20)).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                  F.when(kind == 3, 2).otherwise(1).alias("n"))
    own = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role"), "role", "text")
    return d.withColumns({"digest": F.unhex(F.sha2(own, 256)), "blank": ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")),
                          "cut": ~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))})


def marked(d: DataFrame) -> DataFrame:
    """Equal rows of a conversation and turn once, with ``copies``, and ``again``: an earlier turn of the conversation has this role and text."""
    at = F.struct(F.col("turn").isNotNull(), "turn")
    first = d.groupBy("digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    rows = d.groupBy("conv_id", "turn", "role", "text", "digest", "blank", "cut").agg(F.sum("n").alias("copies"))
    again: Column = F.coalesce(~at.eqNullSafe(F.col("first")), F.lit(False)) & F.col("first").isNotNull()
    return rows.join(first.drop("last"), "digest", "left").withColumn("again", again)


STATS = ("blank", "duplicate", "truncated", "illegal")
PIECE = ("conv_id long, done boolean, seg long, low long, high long, turns long, head string, tail string, "
         + ", ".join(f"{c} long" for c in STATS)
         + ", cost long, audit string, repaired_sha256 string, costs array<long>, orders array<long>, audits array<string>, "
         "roles array<string>, texts array<string>")
NAMES = [c.split()[0] for c in PIECE.split(", ")]
ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
TYPES = [ARROW[c.split()[1]] for c in PIECE.split(", ")]


class Segment:
    def __init__(self, conv: int | None):
        self.conv, self.low, self.high, self.turns, self.head, self.tail = conv, None, None, 0, None, None
        self.symbols, self.rows, self.chars = [], [], 0
        self.stats = dict.fromkeys(STATS, 0)

    def add(self, turn: int | None, role: str, text: str, copy: bool, again: bool, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        if self.tail is None:
            self.head = initial
        else:
            self.stats["illegal"] += self.tail + initial not in LEGAL
        self.tail = initial
        gone = blank or again or copy
        if gone or cut:
            self.stats["blank" if blank else "duplicate" if gone else "truncated"] += 1
        self.symbols.append(chr(FIRST + (MUST if gone else 1 + 2 * (INITIALS.find(initial) if initial and initial in INITIALS else 3) + cut)))
        self.rows.append(("", "") if gone else (role, text))
        self.chars += 0 if gone else len(text)

    @property
    def sequence(self) -> str:
        return "".join(self.symbols)

    def line(self, done: bool, seg: int, **more) -> tuple:
        x = {"conv_id": self.conv, "done": done, "seg": seg, "low": self.low, "high": self.high, "turns": self.turns, "head": self.head,
             "tail": self.tail} | self.stats | more
        return tuple(x.get(n) for n in NAMES)


def solve(held: list[tuple[Segment, bool, int]]) -> pa.RecordBatch:
    """Lines of segments (segment, whole conversation, number): results of whole ones, matrices of others."""
    place = {s: k for k, s in enumerate(dict.fromkeys(x[0].sequence for x in held))}
    g, known, lines = Grammar(list(place)), {}, []
    for s, whole, seg in held:
        k = place[s.sequence]
        if whole:
            if k not in known:
                row = g.row(k)
                cost, q = ending(row)
                known[k] = cost, written(row[q][2]) + "I" * ENDS[q]
            cost, audit = known[k]
            text = "\n".join(repaired(audit, s.rows, START)[0])
            lines.append(s.line(True, seg, cost=cost, audit=audit, repaired_sha256=hashlib.sha256(text.encode()).hexdigest()))
        else:
            m = [x for row in g.whole(k) for x in row]
            lines.append(s.line(False, seg, costs=[x[0] if x else None for x in m], orders=[x[1] if x else None for x in m],
                                audits=[written(x[2]) if x else None for x in m], roles=[r for r, _ in s.rows], texts=[t for _, t in s.rows]))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), TYPES, strict=True)], names=NAMES)


def segments(batches: Iterator[pa.RecordBatch], segment: int, batch: int) -> Iterator[pa.RecordBatch]:
    """Lines of the sorted rows (conv_id, turn, role, text, copies, again, blank, cut) of a task."""
    held, last, cut, number = [], None, True, TaskContext.get().partitionId() << 32
    size = chars = 0

    def close(whole: bool) -> None:
        nonlocal number, size, chars
        held.append((last, whole, number))
        number, size, chars = number + 1, size + len(last.symbols), chars + last.chars

    for b in batches:
        for conv, turn, role, text, copies, again, blank, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if last is None:
                last = Segment(conv)  # what came before is another task's: not known to be whole
            elif conv != last.conv:
                close(not cut)
                last, cut = Segment(conv), False
            for k in range(copies):
                if len(last.symbols) >= segment or last.chars >= SEGMENT_CHARS:
                    close(False)
                    last, cut = Segment(conv), True
                last.add(turn, role, text, k > 0, again, blank, end)
            if size >= batch or chars >= BATCH_CHARS:
                yield solve(held)
                held, size, chars = [], 0, 0
    if last is not None:
        close(False)
    if held:
        yield solve(held)


SUMMARY = "conv_id long, gaps long, " + ", ".join(f"{c} long" for c in STATS) + ", cost long, segs array<long>, ends array<int>"


def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of conversations in several segments: sums, the cost, and the state after each segment. One at a time; numbers only."""

    def finish(some: list[dict]) -> tuple:
        row, back = UNIT[START], []
        for s in some:
            m = [[None if s["costs"][4 * q + r] is None else (s["costs"][4 * q + r], s["orders"][4 * q + r], (q, r)) for r in range(4)] for q in range(4)]
            row = tuple(x and (x[0], x[1], x[2][1]) for x in step(row, m))
            back.append([x and x[2][0] for x in row])
        cost, q = ending(row)
        ends = []
        for states in reversed(back):
            ends.append(q)
            q = states[q]
        low = min((s["low"] for s in some if s["low"] is not None), default=None)
        high = max((s["high"] for s in some if s["high"] is not None), default=None)
        turns = sum(s["turns"] for s in some) - sum(a["high"] is not None and a["high"] == b["low"] for a, b in zip(some, some[1:]))
        stats = [sum(s[c] for s in some) for c in STATS]
        stats[-1] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(some, some[1:]))
        return some[0]["conv_id"], 0 if low is None else high - low + 1 - turns, *stats, cost, [s["seg"] for s in some], ends[::-1]

    def out(lines: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * (len(STATS) + 3) + [pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), types, strict=True)],
                                          names=[c.split()[0] for c in SUMMARY.split(", ")])

    some: list[dict] = []
    for b in batches:
        lines = []
        for s in b.to_pylist():
            if some and s["conv_id"] != some[0]["conv_id"]:
                lines.append(finish(some))
                some = []
            some.append(s)
        if lines:
            yield out(lines)
    if some:
        yield out([finish(some)])


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, seg, audit, text of each segment between its states; the last one has the inserts at the end."""
    for b in batches:
        for s in b.to_pylist():
            audit = s["audits"][4 * s["before"] + s["after"]] + "I" * (ENDS[s["after"]] if s["last"] else 0)
            lines, _ = repaired(audit, list(zip(s["roles"], s["texts"], strict=True)), s["before"])
            yield pa.RecordBatch.from_arrays([pa.array([s["conv_id"]], pa.int64()), pa.array([s["seg"]], pa.int64()), pa.array([audit], pa.string()),
                                              pa.array(["\n".join(lines) if lines else None], pa.string())], names=["conv_id", "seg", "audit", "text"])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, audit, repaired_sha256 of the parts in order; one part of the text is held at a time."""

    def out(conv: int | None, audit: list[str], sha) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])],
                                          names=["conv_id", "audit", "repaired_sha256"])

    conv, audit, sha, begun = None, None, None, False
    for b in batches:
        for k in range(b.num_rows):
            c, _, letters, text = (x[k].as_py() for x in b.columns)
            if audit is None or c != conv:
                if audit is not None:
                    yield out(conv, audit, sha)
                conv, audit, sha, begun = c, [], hashlib.sha256(), False
            audit.append(letters)
            if text is not None:
                sha.update(("\n" if begun else "").encode() + text.encode())
                begun = True
    if audit is not None:
        yield out(conv, audit, sha)


RESULT = ("conv_id", "gaps", *STATS, "cost", "audit", "repaired_sha256")


def repair(rows: DataFrame, segment: int = SEGMENT, batch: int = BATCH) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    d = marked(damaged(rows)).select("conv_id", "turn", "role", "text", "copies", "again", "blank", "cut", "digest")
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest")]
    lines = d.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest")
    lines = saved(lines.mapInArrow(functools.partial(segments, segment=segment, batch=batch), PIECE))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    done = lines.where("done").withColumn("gaps", gaps).select(*RESULT)

    open_ = lines.where("not done")
    dealt = lambda x: x.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "seg")
    met = saved(dealt(open_.drop("done", "cost", "audit", "repaired_sha256", "audits", "roles", "texts")).mapInArrow(between, SUMMARY))
    states = met.select(F.posexplode(F.arrays_zip("segs", "ends")).alias("k", "x"), F.col("ends").alias("all")).select(
        F.col("x.segs").alias("seg"), F.when(F.col("k") > 0, F.element_at("all", F.greatest("k", F.lit(1)))).otherwise(START).alias("before"),
        F.col("x.ends").alias("after"), (F.col("k") == F.size("all") - 1).alias("last"))
    part = open_.select("conv_id", "seg", "audits", "roles", "texts").join(states, "seg").mapInArrow(
        parts, "conv_id long, seg long, audit string, text string")
    text = dealt(part).mapInArrow(joined, "conv_id long, audit string, repaired_sha256 string")
    rest = met.join(text.withColumnRenamed("conv_id", "same"), F.col("conv_id").eqNullSafe(F.col("same"))).select(*RESULT)

    found = done.unionByName(rest)
    every = rows.select(rows["conv_id"].cast("long").alias("conv_id")).distinct()
    none = every.join(found.select(F.col("conv_id").alias("same")), F.col("conv_id").eqNullSafe(F.col("same")), "left_anti")
    zeros = [F.lit(0).cast("long").alias(c) for c in RESULT[1:-2]]
    return found.unionByName(none.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))
