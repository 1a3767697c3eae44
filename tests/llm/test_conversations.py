"""Conversation repair: the grammar against all edits, and the operator against plain Python, whole and in segments."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from valuescope.llm import conversations as cv

ROLES = re.compile(r"(s?(ua)+)?\Z")


def cheapest(symbols):
    """(cost, audit, roles) by a search over (place, roles so far as a state): plain Dijkstra over whole audits."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}  # last role and next role
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, last = heapq.heappop(heap)
        if (k, last) in done:
            continue
        done.add((k, last))
        if k == len(symbols) and last in ("", "a"):
            return cost, audit
        for c in "ua":
            if (last, c) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", k, c))
        if k < len(symbols):
            initial, fault = symbols[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, last))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (last, initial) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, initial))
                for c in "ua":
                    if (last, c) in step:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", k + 1, c))


SYMBOL = st.tuples(st.sampled_from("suax"), st.sampled_from(["", "truncated", "blank"]))


def code(symbols):
    return "".join(chr(cv.FIRST + (0 if f == "blank" else 1 + 2 * "suax".index(i) + (f == "truncated"))) for i, f in symbols)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(SYMBOL, max_size=12), min_size=1, max_size=8))
def test_grammar_against_a_search_over_audits(some):
    g = cv.Grammar([code(x) for x in some])
    for k, x in enumerate(some):
        for row in (g.row(k), g.whole(k)[cv.START]):
            cost, q = cv.ending(row)
            assert (cost, cv.written(row[q][2]) + "I" * cv.ENDS[q]) == cheapest(x)


def test_re_pair_keeps_the_sequences():
    some = ["1212121", "1111", "", "3", "12345" * 9]
    short, rules = cv.re_pair(some)
    for c in reversed(rules):
        short = [x.replace(c, rules[c]) for x in short]
    assert short == some and len(cv.re_pair(["1" * 64])[0][0]) == 2


def plain(rows):
    """conv_id -> the columns of the result, by the words of the contract."""
    n = lambda x: " " if x is None else str(x)
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]  # noqa: B018
        kind, role, text = zlib.crc32(f"{n(conv)}:{n(turn)}".encode()) % 20, n(role), n(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, some in convs.items():
        digest = lambda r: hashlib.sha256(f"{n(conv)}:{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()  # noqa: E731, B023
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        seen, symbols = set(), []
        for _, role, text in some:
            low = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not low else "duplicate" if (role, text) in seen else "" if low[-1] in ".!?" else "truncated"
            seen.add((role, text))
            symbols.append((role[:1], fault))
        cost, audit = cheapest(symbols)
        roles, lines, rest = [], [], iter(some)
        for e in audit:
            _, role, text = next(rest) if e != "I" else (None, None, "")
            if e in "RI":
                role = "assistant" if roles and roles[-1] == "u" else "user"
            if e != "D":
                roles.append(role[:1])
                lines.append(f"{role}:{text}")
        assert ROLES.match("".join(roles))
        turns = {r[0] for r in some} - {None}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == k for _, f in symbols) for k in ("blank", "duplicate", "truncated")),
                     sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(df):
    assert df.columns == list(cv.RESULT)
    rows = df.collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


ROWS = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Hi?"),
        (1, 9, "assistant", "  \t"), (2, None, "user", "No turn."), (2, None, "user", "No turn."), (2, 5, None, None), (2, 6, "", "x."),
        (None, 0, "user", "a"), (None, None, "tool", "b!"), (None, 1, "assistant", "c."), (4, 0, "assistant", "Only\n"), (5, 1, "user", "Ask."),
        (5, 1, "user", "Ask again."), (5, 1, "assistant", "Tied."), (6, 3, "system", "s."), (6, 4, "system", "t. \n"), (7, 0, "ünder", "é."),
        *((k, t, "user" if (t + k) % 3 else "assistant", f"turn {t % 7}" + ".?! "[k % 4]) for k in range(10, 40) for t in range(k % 9)),
        *((50, t, ("user", "assistant", "system")[t % (2 + t % 2)], f"long {t % 60}.") for t in range(300)), *[(51, 4, "user", "same.")] * 70]


@pytest.fixture(scope="module")
def table(spark):
    more = [(*r, "z", 1) for r in ROWS]
    return spark.createDataFrame(more, "conv_id long, turn int, role string, text string, audit string, seg int").repartition(3)


def test_repair_against_plain_python(table):
    assert rows_of(cv.repair(table)) == plain(ROWS)


@pytest.mark.parametrize("size", [1, 3, 50])
def test_repair_in_segments(table, size):
    assert rows_of(cv.repair(table, segment=size, batch=40)) == plain(ROWS)


def test_repair_of_the_given_table(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(cv.repair(df)) == plain(rows)


def test_repair_of_an_empty_table(table):
    assert rows_of(cv.repair(table.limit(0))) == {}
