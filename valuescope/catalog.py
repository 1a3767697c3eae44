"""Registry of jobs: name → (Spark job, DuckDB twin or None).

Jobs register themselves with ``@job(name, sql=...)`` when their module is
imported; ``load_all()`` imports every module.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    fn: Job
    sql: str | None
    family: str


REGISTRY: dict[str, Entry] = {}

MODULES = [
    "valuescope.operators.core",
    "valuescope.operators.segments",
    "valuescope.operators.cohorts",
    "valuescope.operators.temporal",
    "valuescope.operators.stats",
    "valuescope.operators.contrast",
    "valuescope.operators.evaluation",
    "valuescope.operators.seeds",
    "valuescope.operators.splits",
    "valuescope.operators.exports",
    "valuescope.operators.windows",
    "valuescope.operators.ml",
    "valuescope.operators.text",
    "valuescope.streaming.streams",
]


def _matching(s: str, i: int) -> int:
    depth = 0
    q = False
    for j in range(i, len(s)):
        ch = s[j]
        if ch == "'":
            q = not q
        elif not q and ch == "(":
            depth += 1
        elif not q and ch == ")":
            depth -= 1
            if depth == 0:
                return j
    raise ValueError("unbalanced parentheses in SQL")


def rewrite_round6(sql: str) -> str:
    """ROUND(x, 6) → FLOOR(x*1e6 + 0.5)/1e6, the same IEEE steps as ``exprs.r6``."""
    out, i = [], 0
    key = "ROUND("
    while True:
        k = sql.find(key, i)
        if k < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:k])
        end = _matching(sql, k + len(key) - 1)
        inner = sql[k + len(key):end]
        # split off the top-level ", 6"
        depth, q, cut = 0, False, -1
        for j, ch in enumerate(inner):
            if ch == "'":
                q = not q
            elif not q and ch == "(":
                depth += 1
            elif not q and ch == ")":
                depth -= 1
            elif not q and ch == "," and depth == 0:
                cut = j
        if cut >= 0 and inner[cut + 1:].strip() == "6":
            arg = rewrite_round6(inner[:cut])
            out.append(f"(FLOOR(CAST({arg} AS DOUBLE) * 1000000.0 + 0.5) / 1000000.0)")
        else:
            out.append(key + rewrite_round6(inner) + ")")
        i = end + 1


def job(name: str, sql: str | None = None, family: str = ""):
    def deco(fn: Job) -> Job:
        if name in REGISTRY:
            raise ValueError(f"duplicate job {name}")
        REGISTRY[name] = Entry(name, fn, rewrite_round6(sql) if sql else None,
                               family or fn.__module__.rsplit(".", 1)[-1])
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    for m in MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != m:
                raise
    return REGISTRY
