"""Main text of web pages by minimum-cut labelling.

1. A page is cut into blocks (runs of text between block-level tags). Scripts,
   styles, comments and the head give no text.
2. A logistic classifier of each block (link share, length, marks, the tags and
   the class and id names above it) gives its costs of being content and of
   being boilerplate; these become the terminal capacities.
3. Adjacent blocks are joined by a smoothness edge, weaker the more tags lie
   between them; blocks under one parent are joined through a node of that
   parent, so the number of edges is linear in the number of blocks.
4. The minimum cut (push along shortest augmenting paths) labels the blocks.

Where the cut leaves no content, the blocks stay that neither a tag, a name nor links
speak against. Content blocks are joined in page order by one line feed; white space inside a
block (line breaks too) becomes one space; character references are decoded.
Null and empty html give an empty text and 0. Repeated rows, null ids and null
urls are returned as they are; other columns are not looked at. One page is one
unit of work: no shuffle.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element names of HTML.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "textarea", "select", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "label", "br",
          "wbr", "img", "nobr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
            "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure", "details"}
#: Weights (log odds of boilerplate) of tags above a block and of words in their class, id and role.
TAGS = {"nav": 6.0, "footer": 6.0, "aside": 6.0, "form": 6.0, "button": 6.0, "menu": 6.0, "dialog": 6.0, "header": 4.0, "head": 8.0,
        "article": -3.0, "main": -2.0, "p": -1.0, "blockquote": -0.5, "pre": -0.5, "h1": -1.0, "h2": -0.5, "h3": -0.5, "li": 0.5,
        "address": 1.0, "fieldset": 4.0, "optgroup": 4.0}
WORDS = {"nav": 6.0, "navbar": 6.0, "navigation": 6.0, "menu": 6.0, "breadcrumb": 6.0, "breadcrumbs": 6.0, "footer": 6.0, "header": 4.0,
         "masthead": 5.0, "sidebar": 6.0, "aside": 5.0, "widget": 5.0, "ad": 6.0, "ads": 6.0, "advert": 6.0, "adverts": 6.0,
         "advertisement": 6.0, "advertising": 6.0, "banner": 5.0, "sponsor": 6.0, "sponsored": 6.0, "promo": 6.0, "promotion": 6.0,
         "cookie": 6.0, "cookies": 6.0, "consent": 6.0, "gdpr": 6.0, "notice": 6.0, "popup": 6.0, "modal": 6.0, "alert": 5.0,
         "newsletter": 6.0, "subscribe": 6.0, "subscription": 6.0, "signup": 6.0, "login": 6.0, "search": 2.0, "share": 6.0,
         "sharing": 6.0, "social": 6.0, "related": 6.0, "recommended": 6.0, "recommendations": 6.0, "trending": 6.0, "comment": 6.0,
         "comments": 6.0, "reply": 6.0, "replies": 6.0, "respond": 6.0, "disqus": 6.0, "reviews": 5.0, "pagination": 6.0, "pager": 6.0,
         "toolbar": 5.0, "copyright": 6.0, "legal": 2.0, "disclaimer": 2.0, "hidden": 5.0, "contentinfo": 6.0, "complementary": 6.0,
         "article": -2.0, "content": -1.5, "main": -1.5, "post": -1.0, "entry": -1.5, "story": -1.5, "body": -0.5}
STICKY = 4.0  # weights at least this high also hold for everything below the element
#: Inherited from a name: at most UNDER below an article or main element, and less by PER_WORD for each word of a block beyond FREE.
UNDER, FREE, PER_WORD = 2.5, 40, 0.04
#: What follows one of BEFORE in a name, and all of a name that ends with one of AFTER, is a state of the page and no evidence.
BEFORE, AFTER = {"has", "no", "not", "with", "without", "open", "show"}, {"open", "closed", "enabled", "disabled"}
#: Elements that leave an open head open.
IN_HEAD = {"head", "html", "base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: A tag ends at its > before the next <; a quoted value is one that ends where a value may end, so that a stray quote opens none.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/><]*)((?:=\s*\"[^\"]*\"(?=[\s/>]|\Z)|=\s*'[^']*'(?=[\s/>]|\Z)|[^<>])*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SMOOTH, SIBLING = 0.8, 0.4


class Block:
    __slots__ = ("text", "linked", "weight", "parent", "tags_before", "named")

    def __init__(self, text, linked, weight, parent, tags_before, named=(0.0, 0.0)):
        self.text, self.linked, self.weight, self.parent, self.tags_before, self.named = text, linked, weight, parent, tags_before, named


def evidence(value: str) -> list[float]:
    """Weights of the words of class, id and role names."""
    found = []
    for name in value.split():
        words = [x for x in re.split(r"[^a-z]+", name) if x]
        if len(words) > 1 and words[-1] in AFTER:
            continue
        cut = next((k for k, x in enumerate(words) if x in BEFORE), len(words))
        found += [WORDS[x] for x in words[:cut] if x in WORDS]
    return found


def weight_of(tag: str, attrs: str) -> tuple[float, float]:
    """(weight of the element itself, weight by a telling name)."""
    w, by_name = TAGS.get(tag, 0.0), 0.0
    if attrs and tag not in ("html", "body"):
        for name, value in NAMED.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                w = max(w, 6.0)
            elif name in ("class", "id", "role"):
                found = evidence(value)
                if found and max(found) >= STICKY:
                    by_name = max(by_name, *found)
                elif found:
                    w += min(found)
    return w, by_name


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order. Unclosed and stray tags are tolerated; depth is not bounded."""
    out: list[Block] = []
    stack: list[tuple[str, float, float, int, float]] = []  # tag, sum of weights, sticky weight, node, sticky weight by name
    depth: Counter[str] = Counter()  # open elements of each name
    text: list[str] = []
    state = {"linked": 0, "links": 0, "tags": 0, "node": 0, "head": 0}

    def pop() -> str:
        tag = stack.pop()[0]
        depth[tag] -= 1
        return tag

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            top = stack[-1] if stack else ("", 0.0, 0.0, 0, 0.0)
            out.append(Block(joined, min(1.0, state["linked"] / len(joined)), top[1], top[3], state["tags"], (top[2], top[4])))
            state["tags"] = 0
        text.clear()
        state["linked"] = 0

    def leave_head() -> None:
        if state["head"]:
            flush()
            while len(stack) >= state["head"]:
                pop()
            state["head"] = 0

    def said(s: str) -> None:
        if state["head"] and s.strip():
            leave_head()
        text.append(s)
        if state["links"]:
            state["linked"] += len(s)

    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            said(page[at:])
            break
        if m.start() > at:
            said(page[at:m.start()])
        at = max(m.end(), m.start() + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[1] and tag not in IN_HEAD:
            leave_head()
        if tag == "br" or tag in ("img", "wbr"):
            said(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                state["links"] = 0 if m[1] else 1
            if not m[1] and m[3] and max(weight_of("", m[3])) >= STICKY or m[1] and any(t == tag and max(s, k) for t, _, s, _, k in stack[-1:]):
                pass  # an inline element with a telling name counts as a block
            else:
                continue
        flush()
        state["tags"] += 1
        if not m[1]:
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else n
                continue
            if tag in VOID or m[3].endswith("/"):
                continue
            state["links"] = 0 if tag in CLOSES_P else state["links"]
            if tag in CLOSES_P and any(t[0] == "p" for t in stack[-3:]):
                while pop() != "p":
                    pass
            elif tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                pop()
            w, by_name = weight_of(tag, m[3])
            _, total, sticky, _, named = stack[-1] if stack else ("", 0.0, 0.0, 0, 0.0)
            if tag in ("article", "main"):
                named = min(named, UNDER)
            state["node"] += 1
            if w >= STICKY:
                sticky = max(sticky, w)
            elif by_name < STICKY:
                total = max(-5.0, min(3.0, total + w))
            stack.append((tag, total, sticky, state["node"], max(named, by_name)))
            depth[tag] += 1
            if tag == "head" and not state["head"]:
                state["head"] = len(stack)
        elif depth[tag]:
            while pop() != tag:
                pass
            if len(stack) < state["head"]:
                state["head"] = 0
    flush()
    return out


def odds(b: Block) -> float:
    """Log odds of boilerplate."""
    words = b.text.count(" ") + 1
    inherited = max(b.named[0], b.named[1] - PER_WORD * max(0, words - FREE))
    z = 0.6 + b.weight + inherited + 3.0 * b.linked - 0.45 * math.log1p(words)
    if b.text[-1:] in ".!?:;\"'”»":
        z -= 0.4
    if words < 40 and re.search(r"©|\(c\) ?\d{4}|all rights reserved|privacy policy|terms of (?:use|service)|cookies", b.text, re.I):
        z += 1.5
    return z


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut (shortest augmenting paths, level by level)."""
    n = len(source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def edge(a: int, b: int, ab: float, ba: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(ab)
        head[b].append(len(to))
        to.append(a)
        cap.append(ba)

    for k in range(n):
        both = min(source[k], sink[k])  # flows straight through
        if source[k] > both:
            edge(s, k, source[k] - both, 0.0)
        if sink[k] > both:
            edge(k, t, sink[k] - both, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                cut = len(path)
                for i, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                    if cap[e] <= eps and i < cut:
                        cut = i
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[u] < len(head[u]):
                e = head[u][nxt[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(head[u]):
                path.append(head[u][nxt[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, blocks, content blocks) of a page."""
    bs = blocks_of(page or "")
    if not bs:
        return "", 0, 0
    keep, drop = [], []  # capacities: cost of calling it boilerplate, cost of calling it content
    for b in bs:
        z = max(-12.0, min(12.0, odds(b)))
        size = min(3.0, 0.5 + 0.25 * math.log1p(len(b.text)))
        drop.append(math.log1p(math.exp(z)) * size)
        keep.append(math.log1p(math.exp(-z)) * size)
    edges, nodes = [], {}
    for k in range(1, len(bs)):
        edges.append((k - 1, k, SMOOTH / (1 + bs[k].tags_before)))
    n = len(bs)
    for k, b in enumerate(bs):
        if b.parent not in nodes:
            nodes[b.parent] = n + len(nodes)
        edges.append((k, nodes[b.parent], SIBLING))
    extra = [0.0] * len(nodes)
    side = min_cut(keep + extra, drop + extra, edges)
    kept = [b.text for b, on in zip(bs, side, strict=False) if on]
    if not kept:  # nothing but short blocks: those that nothing speaks against
        kept = [b.text for b in bs if b.weight <= 0 and max(b.named) < STICKY and b.linked < 0.5]
    return "\n".join(kept), n, len(kept)


SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_content long"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_blocks, n_content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                got = [main_text(h) for h in s.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), s.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()),
                     pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])

    src = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
                       pages[html_col].cast("string").alias("html"))
    return src.mapInArrow(run, SCHEMA)
