"""Main text of raw HTML by minimum-cut labelling of its text blocks.

A page becomes a sequence of text blocks with their place in the DOM. A logistic classifier gives each block
its cost of being content and of being boilerplate (terminal capacities); neighbours in page order and blocks
of the same container are tied by smoothness edges. The minimum cut is the cheapest labelling of the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import map_batches, table

#: Pages whose blocks teach the classifier (the smallest hashes of page_id), the only bound here.
TRAIN_PAGES = 1000
#: Capacity of an edge between neighbours with the same parent, the same grandparent, others; to the container's last block.
SAME, NEAR, FAR, WITHIN = 0.7, 0.3, 0.1, 0.3
TAG_CUE, WORD_CUE, CONTENT_CUE, TEXT_CLIP = -6.0, -5.0, 3.0, 3.0
#: A form may wrap prose: below what text alone can outweigh.
FORM_CUE = -1.0

# Element names of HTML and words usual in class, id and role names.
SKIPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video select option textarea button head title datalist map".split())
RAW = frozenset("script style noscript template svg iframe textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meta link nobr q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements whose end tag may be left out: a start tag (key) ends the nearest open element of the first set that has one, inside the bounds.
ENDS = {
    "li": ["li"], "dt": ["dt dd"], "dd": ["dt dd"], "td": ["td th"], "th": ["td th"], "tr": ["tr", "td th caption colgroup"],
    **dict.fromkeys(("tbody", "thead", "tfoot"), ["tbody thead tfoot", "tr", "td th caption colgroup"]),
    "option": ["option"], "optgroup": ["optgroup", "option"], "button": ["button"], "rt": ["rt rp"], "rp": ["rt rp"],
}
ENDS = {k: [frozenset(x.split()) for x in v] for k, v in ENDS.items()}
BOUNDS = {"li": frozenset("ul ol menu table".split()), "dt": frozenset(("dl", "table")), "dd": frozenset(("dl", "table"))}
IN_HEAD = frozenset("base link meta title noscript noframes style script template head html".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
FORM_TAGS = frozenset("form fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_WORDS = frozenset(
    """ad ads adv advert advertisement advertisements adverts banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright
    disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination
    paywall popup privacy promo promoted promotion recommended register related replies reply respond search share sharing sidebar signup social sponsor sponsored sponsors
    subscribe subscription taboola tags toolbar topbar tracking widget widgets""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
CONTENT_WORDS = frozenset("article articlebody content entry main maincontent post story".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VEILED = re.compile(r"hidden|display\s*:\s*none", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/][^\s=>/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Node:
    parent: int
    tag: str
    words: frozenset[str]
    chars: int = 0
    holds_content: bool = False
    plain: int = 0  # characters outside links
    inside: int = 0  # article and main elements in it, comments apart


@dataclass(slots=True)
class Block:
    node: int
    text: str
    linked: int


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Containers and text blocks of a page in order; broken markup is read as far as it goes."""
    nodes, blocks, path = [Node(-1, "", frozenset())], [], [0]
    words: list[str] = []
    open_at: dict[str, list[int]] = defaultdict(list)  # places of the open elements by tag, so that no tag has to search the path
    solid = [0]  # places of those that aren't inline
    state = {"link": 0, "linked": 0, "veil": 0}  # veil: place in the path of the outermost element that is not shown

    def say(raw: str) -> None:
        if state["veil"] and nodes[path[-1]].tag == "head" and raw.strip():
            cut(len(path) - 1)  # text ends the head
        if raw and not state["veil"]:
            text = html.unescape(raw) if "&" in raw else raw
            words.append(text)
            if state["link"]:
                state["linked"] += len("".join(text.split()))

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            blocks.append(Block(path[state["veil"] - 1], text, state["linked"]))
        state["linked"] = 0

    def push(tag: str, names: frozenset[str] = frozenset()) -> None:
        nodes.append(Node(path[-1], tag, names))
        open_at[tag].append(len(path))
        if tag not in INLINE:
            solid.append(len(path))
        path.append(len(nodes) - 1)

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def cut(k: int) -> None:
        for node in reversed(path[k:]):
            open_at[nodes[node].tag].pop()
        while solid[-1] >= k:
            solid.pop()
        del path[k:]
        if k <= state["veil"]:
            state["veil"] = 0

    def implied(tag: str) -> int:
        """Where a start tag ends open elements that have no end tag, or 0."""
        if open_at.get("head") and tag not in IN_HEAD:
            return open_at["head"][0]
        if open_at.get("select") and (tag in CLOSES_P and tag != "hr" or tag in ("input", "textarea")):
            return open_at["select"][0]
        if tag in CLOSES_P:
            return solid[-1] if nodes[path[solid[-1]]].tag == "p" else 0
        for ended in ENDS.get(tag, ()):
            k = last(ended)
            if k and k >= last(BOUNDS.get(tag, ("table",))):
                return k
        return 0

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        if at == n and not page.endswith(">") and (loose := _LOOSE.match(page, m.start())):  # a quote that never ends
            m, at = loose, loose.end()
        end, tag, rest = m.group(1) == "/", m.group(2).lower(), m.group(3)
        if not end and (state["veil"] or tag not in INLINE) and (k := implied(tag)):
            if k < state["veil"] or not state["veil"]:
                flush()
                state["link"] = 0
            cut(k)
        if not end and tag in RAW:  # its content is no markup
            if not state["veil"] and tag not in INLINE:
                flush()
            if not rest.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if state["veil"]:
            if end:
                k = last((tag,))
                if k and k < state["veil"]:
                    flush()
                    state["link"] = 0
                if k:
                    cut(k)
            elif tag not in VOID and not rest.endswith("/"):
                push(tag)
            continue
        if tag in SKIPPED or (not end and tag not in VOID and hidden(tag, rest)):
            if not end and tag not in VOID and not rest.endswith("/"):
                if tag not in INLINE:
                    flush()
                push(tag)
                state["veil"] = len(path) - 1
            continue
        if tag == "a":
            state["link"] = 0 if end else 1
        if tag == "br":
            words.append(" ")
        if tag in INLINE:
            continue
        flush()
        state["link"] = 0
        if end:
            if k := last((tag,)):
                cut(k)
            continue
        if tag in VOID or rest.endswith("/"):
            continue
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)) if "=" in rest else ""
        push(tag, frozenset(w.lower() for w in _WORD.findall(names)))
    flush()
    return nodes, blocks


def hidden(tag: str, rest: str) -> bool:
    """Whether a start tag's own hidden attribute or style says that it is not shown; whole pages are shown by scripts."""
    if tag in ("html", "body") or not _VEILED.search(rest):
        return False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden" and value.lower() != "false" or name == "style" and _UNSEEN.search(value):
            return True
    return False


def structure(nodes: list[Node], blocks: list[Block]) -> list[float]:
    """What the DOM says of each container: below 0 boilerplate, above 0 content, 0 nothing."""
    for b in blocks:
        nodes[b.node].chars += len(b.text)
        nodes[b.node].plain += max(0, len(b.text) - b.linked)
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[nodes[k].parent]
        up.chars += nodes[k].chars
        up.plain += nodes[k].plain
        up.inside += nodes[k].inside + (nodes[k].tag in CONTENT_TAGS and not nodes[k].words & COMMENT_WORDS and nodes[k].chars > 0)
        if nodes[k].holds_content or nodes[k].tag in CONTENT_TAGS:
            nodes[nodes[k].parent].holds_content = True
    cue = [0.0] * len(nodes)
    over = [0] * len(nodes)  # article and main elements around

    def wraps(k: int) -> bool:
        """Whether an element named as boilerplate wraps the page's content: two of holds articles, none are apart, most of the text."""
        x = nodes[k]
        return (x.inside > 0) + (nodes[0].inside - x.inside - over[k] <= 0) + (2 * x.plain > nodes[0].plain) >= 2

    for k in range(1, len(nodes)):
        x = nodes[k]
        above = cue[x.parent]
        over[k] = over[x.parent] + (x.tag in CONTENT_TAGS and not x.words & COMMENT_WORDS and x.chars > 0)
        if above <= WORD_CUE:
            cue[k] = above
        elif x.tag in FORM_TAGS and not wraps(k):
            cue[k] = min(above, FORM_CUE)
        elif x.tag in BOILER_TAGS - FORM_TAGS and not wraps(k) or x.tag == "header" and above <= 0 and not x.holds_content:
            cue[k] = TAG_CUE
        elif x.words & COMMENT_WORDS and x.tag not in ("html", "body", "main") and not (x.tag == "article" and above == 0) and not wraps(k):
            cue[k] = WORD_CUE
        elif x.words & BOILER_WORDS and x.tag not in ("html", "body", "main", "article", "p", *HEADINGS) and not x.holds_content and 2 * x.chars <= nodes[0].chars:
            cue[k] = WORD_CUE
        elif x.tag in CONTENT_TAGS:
            cue[k] = CONTENT_CUE
        elif x.words & CONTENT_WORDS and x.tag not in ("html", "body"):
            cue[k] = max(above, CONTENT_CUE / 2)
        else:
            cue[k] = above
    return cue


#: What the classifier believes before it is taught: constant, length, links, sentence end, capitals, digits, heading, item, place, sign.
PRIOR = np.array([-1.0, 2.5, -3.0, 0.8, -0.5, -0.5, 0.5, -0.8, 0.0, -2.0])


def text_features(nodes: list[Node], blocks: list[Block]) -> np.ndarray:
    """Of the text alone, so that what semantic elements teach also helps pages without them."""
    out = np.zeros((len(blocks), len(PRIOR)))
    for k, b in enumerate(blocks):
        t, tag = b.text, nodes[b.node].tag
        n = len(t)
        out[k] = (
            1, min(np.log1p(n) / 6, 1.2), min(1.0, b.linked / n), t[-1] in ".!?…:;\"'”’)", sum(map(str.isupper, t)) / n, sum(map(str.isdigit, t)) / n,
            tag in HEADINGS, tag in ("li", "td", "th", "dt"), k / len(blocks), "©" in t or "®" in t,
        )
    return out


def capacities(cue: list[float], nodes: list[Node], blocks: list[Block], weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """For each block log-odds of content (its two terminal capacities less their common part), and the edges."""
    z = np.clip(text_features(nodes, blocks) @ weights, -TEXT_CLIP, TEXT_CLIP) + np.array([cue[b.node] for b in blocks])
    edges, last = [], {}
    for k, b in enumerate(blocks):
        up = nodes[b.node].parent
        if k:
            a = blocks[k - 1].node
            over = nodes[a].parent
            edges.append((k - 1, k, SAME if over == up or a == b.node else NEAR if over >= 0 and up >= 0 and nodes[over].parent == nodes[up].parent else FAR))
        if last.get(up, k - 1) != k - 1:
            edges.append((last[up], k, WITHIN))
        last[up] = k
    return z.tolist(), edges


def minimum_cut(z: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a block is on the content side of a minimum cut.

    -log P(boilerplate) and -log P(content) differ by the log-odds z: what both have is cut anyway, so a
    block keeps an excess z > 0 from the source or -z to the sink. Flow goes by shortest levels.
    """
    n = len(z)
    gain, to, cap = [[] for _ in range(n)], [], []
    for a, b, c in edges:
        for x, y in ((a, b), (b, a)):
            gain[x].append(len(to))
            to.append(y), cap.append(c)
    source, sink = [max(x, 0.0) for x in z], [max(-x, 0.0) for x in z]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(k for k in range(n) if source[k] > tiny)
        for k in queue:
            level[k] = 0
        reached = False
        while queue:
            k = queue.popleft()
            reached |= sink[k] > tiny
            for e in gain[k]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[k] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in range(n):
            while source[s] > tiny:
                # one path from s down the levels to a block with room to the sink
                walk, k = [], s
                while sink[k] <= tiny:
                    while turn[k] < len(gain[k]):
                        e = gain[k][turn[k]]
                        if cap[e] > tiny and level[to[e]] == level[k] + 1:
                            break
                        turn[k] += 1
                    else:
                        if not walk:
                            k = -1
                            break
                        e = walk.pop()
                        k = to[e ^ 1]
                        turn[k] += 1
                        continue
                    walk.append(e)
                    k = to[e]
                if k < 0:
                    break
                flow = min([source[s], sink[k], *(cap[e] for e in walk)])
                source[s] -= flow
                sink[k] -= flow
                for e in walk:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def main_text(page: str, weights: np.ndarray) -> str:
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    z, edges = capacities(structure(nodes, blocks), nodes, blocks, weights)
    return "\n\n".join([b.text for b, keep in zip(blocks, minimum_cut(z, edges), strict=True) if keep])


def train(pages: DataFrame, pages_most: int = TRAIN_PAGES, rounds: int = 12, pull: float = 20.0) -> np.ndarray:
    """Classifier weights from blocks that semantic elements or names already label, drawn to PRIOR by ``pull``."""
    ids = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(pages_most)
    mine = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").where("html is not null")
    size = len(PRIOR)

    def step(batch: pa.RecordBatch) -> dict:
        rows: dict[str, list] = {"label": [], "x": []}
        for page in batch.column("html").to_pylist():
            nodes, blocks = parse(page)
            cue = structure(nodes, blocks)
            seen: dict[tuple, int] = {}
            for b, x in zip(blocks, text_features(nodes, blocks), strict=True):
                c = cue[b.node]
                if c <= WORD_CUE or c >= CONTENT_CUE:
                    key = (c > 0, *np.round(x[1:8], 1))
                    seen[key] = seen.get(key, 0) + 1
                    if seen[key] == 1:  # like blocks of a page teach once
                        rows["label"].append(int(c > 0))
                        rows["x"].append(x.tolist())
        return rows

    got = map_batches(mine, step, "label int, x array<double>").orderBy("x", "label").toArrow()
    y = got.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return PRIOR
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, size)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + pull * (w - PRIOR)
        hess = (x.T * (weight * p * (1 - p))) @ x + pull * np.eye(size)
        w = w - np.linalg.solve(hess, grad)
    return np.clip(w, -12, 12)


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the whole main text, blocks joined by an empty line.

    A null or empty html, or one without content, gives an empty text; repeated rows are worked alike;
    extra columns are ignored; an empty table gives no rows.
    """

    def step(batch: pa.RecordBatch) -> dict:
        text = [main_text(x, weights) if x else "" for x in batch.column("html").to_pylist()]
        text = [x.encode("utf-8", "replace").decode() for x in text]  # &#xD800; is no character
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": text, "n_chars": list(map(len, text))}

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), step, "page_id long, url string, text string, n_chars long")


def op9_html(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
