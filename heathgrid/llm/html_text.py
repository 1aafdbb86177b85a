"""Main text of web pages: a classifier's costs and page structure, settled by a minimum cut.

A page becomes blocks: runs of text between block-level tags. Each block gets log-odds of being content:
a logistic regression over its text (length, links, punctuation, ...) plus what its markup says (inside an
article, a menu, a form, an element named like an advert or comment, ...). They become terminal
capacities; blocks that follow one another and blocks of the same parent are joined by smoothness edges.
A maximum flow then separates content (the source's side) from the rest. Most blocks are decided before
that: one whose own capacity is at least that of all its edges keeps its side in some minimum cut, and
its edges become capacities of its neighbours. What is left goes through Dinic's algorithm.

The regression is trained here: in a bounded sample of pages (SAMPLE, those of the smallest hashes of
page_id) blocks inside unmistakable markup are the labels, their texts the inputs. Its weights are drawn
towards PRIOR, which alone holds where there is nothing to learn from.

Parsing takes time in proportion to the page: unclosed tags, comments and scripts end with it,
and a tag's quoted value is followed for 65,536 characters.

Defined cases: a null or empty page and one of markup alone have an empty text; of equal cuts the one with
less content holds; repeated rows give repeated result rows; an empty table gives no rows; further
columns are ignored; a null page_id or url is passed through.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heathgrid.llm.common import slices, texts_of

SAMPLE = 2000

TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]{0,65536}"|'[^']{0,65536}')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[!?/])""")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden|aria-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# fixed values: elements of HTML by what they do
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
UNSEEN = frozenset("head template svg select button object audio video canvas datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TABLE = frozenset("table caption tbody thead tfoot tr td th body html".split())
CELLS = frozenset(("td", "th", "caption"))
ENDED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# fixed values: markup that names a part of a page
SIDE_TAGS = frozenset("nav aside footer form dialog menu search label fieldset legend".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note status".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs comment comments commenting consent cookie cookies copyright crumbs disclaimer discussion disqus "
    "flyout footer footnav form forms gdpr hidden legal links login masthead menu menubar menus modal nav navbar navigation navigate newsletter notice notices notification notifications overlay pager "
    "pagination paging paywall popular popup privacy promo promoted promotion promotions recommended recommendation recommendations related replies reply respond responses rss search share sharing shares "
    "sidebar signin signup sitemap skip social sponsor sponsored sponsors subscribe subscription toolbar topbar trending warning".split()
)
SIDE_STEMS = ("advert", "breadcrumb", "comment", "cookie", "copyright", "footer", "navbar", "navigation", "newsletter", "pagination", "sidebar", "sponsor", "subscri")
NOT_SIDE = frozenset(("commentary",))
HEAD_WORDS = frozenset(("header", "masthead"))
WRAPPER_WORDS = frozenset("has with no without is not".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article content post entry story prose".split())

#: Log-odds that markup adds, what a text may say at most, smoothness of neighbours, in thousandths when they are capacities.
SIDE, INSIDE, NAMED, OUTSIDE, UNNAMED, MOST = -12.0, 5.0, 1.5, -3.5, -1.0, 4.0
ADJACENT, SIBLING = 0.4, 0.9
#: bias, length, links, punctuation, sentence end, heading, list item, marks of page furniture, digits
PRIOR = (-0.3, 1.2, -4.0, 1.0, 1.0, 2.0, -0.7, -2.5, -1.0)
#: Labelled blocks that weigh as much as PRIOR does.
DRAWN = 20.0


class Block:
    __slots__ = ("inside", "kind", "link_chars", "named", "parent", "side", "text")

    def __init__(self, text: str, link_chars: int, frame: Frame):
        self.text, self.link_chars, self.parent, self.kind = text, link_chars, frame.number, frame.kind
        self.side, self.inside, self.named = frame.side, frame.inside, frame.named


class Frame:
    """An open element, with what it and those around it say."""

    __slots__ = ("flat", "inside", "kind", "named", "number", "side", "tag", "unseen")

    def __init__(self, tag: str, number: int, around: Frame | None, flat: bool = False):
        """flat: an inline element that is only there to meet its end tag."""
        self.tag, self.number, self.flat, self.kind = tag, number, flat, around.kind if flat and around else tag
        self.side, self.inside, self.named, self.unseen = (around.side, around.inside, around.named, around.unseen) if around else (False, False, False, False)


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), value.strip("\"'"))
    return found


def named_like(names: str, inside: bool) -> tuple[bool, bool]:
    """Whether class and id words name a side part of a page, and whether they name its content."""
    side = content = False
    for name in names.split():
        words = [x.lower() for x in NAME_WORD.findall(name)]
        if words and words[0] in WRAPPER_WORDS:
            continue
        holds = any(x in CONTENT_WORDS for x in words)
        side |= any((x in SIDE_WORDS or x.startswith(SIDE_STEMS)) and x not in NOT_SIDE for x in words)
        side |= not inside and not holds and words[:1] != ["page"] and any(x in HEAD_WORDS for x in words)
        content |= holds
    return side, content


def enter(frame: Frame, tag: str, rest: str) -> None:
    """What a start tag says."""
    if tag in CONTENT_TAGS:
        frame.inside = True
    if tag in SIDE_TAGS or (tag == "header" and not frame.inside):
        frame.side = True
    if tag in UNSEEN:
        frame.unseen = True
    if "=" in rest or "hidden" in rest:
        said = attributes(rest)
        if not said or tag in ("html", "body"):
            return
        side, content = named_like(f"{said.get('class', '')} {said.get('id', '')} {said.get('aria-label', '')}", frame.inside)
        gone = "hidden" in said or said.get("aria-hidden", "").lower() == "true" or "display:none" in said.get("style", "").lower().replace(" ", "")
        role = said.get("role", "").lower()
        frame.side |= gone or (side and tag != "main") or role in SIDE_ROLES
        frame.inside |= role in ("main", "article")
        frame.named |= content


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    number = 0
    frames = [Frame("", 0, None)]
    parts: list[str] = []
    linked: list[str] = []
    link = False

    def end_block() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not frames[-1].unseen:
                out.append(Block(text, min(len(text), len(" ".join(entities.unescape("".join(linked)).split()))), frames[-1]))
            parts.clear()
            linked.clear()

    def close(tag: str, limit: set[str] | frozenset[str] = frozenset()) -> None:
        """Close the innermost open tag of that name, if there is one within the limit."""
        nonlocal link
        if not opened.get(tag):
            return
        for k in range(len(frames) - 1, 0, -1):
            if frames[k].tag == tag:
                if not all(x.flat for x in frames[k:]):
                    end_block()
                    link = False
                while len(frames) > k:
                    opened[frames.pop().tag] -= 1
                return
            if frames[k].tag in limit:
                return

    opened: dict[str, int] = {}
    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        m = TAG.search(page, at) if at <= last else None
        start = m.start() if m else size
        if start > at:
            text = page[at:start]
            if not m and (cut := re.search(r"<[a-zA-Z/!?]", text)):
                text = text[: cut.start()]  # a tag that the page's end cut off
            parts.append(text)
            if link:
                linked.append(text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            stop, step = (page.find("-->", start + 2), 3) if m[0] == "<!--" else (page.find(">", start + 2), 1)
            at = stop + step if stop >= 0 else size
            continue
        tag, ending, rest = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            if tag == "a":
                link = False
            if tag == "p" and not opened.get("p"):
                end_block()
            elif tag in opened:
                close(tag, frozenset() if tag in TABLE else CELLS)
            elif tag in BLOCKS:
                end_block()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            at = stop.start() if stop else size
            if tag in ("iframe", "textarea"):
                parts.append(" ")
            continue
        if tag == "a":
            link = True
        if tag == "br":
            parts.append(" ")
        if tag in VOID and tag != "hr":
            continue
        if tag == "hr":
            close("p")
            end_block()
            continue
        cue = None
        if tag not in BLOCKS:
            cue = Frame(tag, number + 1, frames[-1])
            enter(cue, tag, rest)
            if (cue.side, cue.unseen) == (frames[-1].side, frames[-1].unseen):
                if opened.get(tag):
                    frames.append(Frame(tag, frames[-1].number, frames[-1], True))
                    opened[tag] += 1
                continue  # an inline element that says nothing
        if tag in BLOCKS:
            close("p", {"button", "table", "caption", "td", "th"})
        if tag in ENDED_BY_SAME:
            for other in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                close(other, ENDED_BY_SAME[tag])
        end_block()
        number += 1
        frame = cue or Frame(tag, number, frames[-1])
        if not cue:
            enter(frame, tag, rest)
        frames.append(frame)
        opened[tag] = opened.get(tag, 0) + 1
    end_block()
    return out


MARKS = re.compile(r"[.,;:!?。，！？、؟،]")
FURNITURE = re.compile(r"[©®|»«›→←•]|·")
DIGIT = re.compile(r"\d")


def features(block: Block) -> tuple[float, ...]:
    """Of the text of a block: markup that names parts of a page isn't among them."""
    text = block.text
    words = len(text) / 6.0
    return (
        1.0, min(math.log1p(words), 5.0) - 1.5, block.link_chars / len(text), min(1.0, 6.0 * len(MARKS.findall(text)) / len(text) * 2), float(text[-1] in ".!?。！？\"”…"),
        float(len(block.kind) == 2 and block.kind[0] == "h" and block.kind[1] in "123456"), float(block.kind in ("li", "dd", "dt")), min(1.0, 20.0 * len(FURNITURE.findall(text)) / len(text)), min(1.0, 3.0 * len(DIGIT.findall(text)) / len(text)),
    )


def label(block: Block) -> int | None:
    """1 or 0 where markup leaves no doubt about a block, else None."""
    return 0 if block.side else 1 if block.inside else None


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the logistic regression by Newton's method; both classes weigh the same, and PRIOR as DRAWN blocks."""
    prior = np.array(PRIOR)
    w = prior.copy()
    if not len(x) or y.min() == y.max():
        return w
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    loss = lambda w: (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum() + DRAWN / 2 * ((w - prior) ** 2).sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + DRAWN * (w - prior)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + DRAWN * np.eye(len(w))
        step, now = np.linalg.solve(curve, gradient), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from the labelled blocks of at most `sample` pages. The tasks send sums of a page's blocks and not texts."""
    key = F.xxhash64(F.col("page_id").cast("string"), F.col("url"))
    chosen = pages.select(key.alias("h")).distinct().orderBy("h").limit(sample)
    some = pages.withColumn("h", key).join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"]).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            told = []
            for page in texts_of(batch, "html"):
                both: dict[int, list] = {0: [], 1: []}
                for b in blocks_of(page):
                    y = label(b)
                    if y is not None:
                        both[y].append(features(b))
                # evenly spread ones of a long page, so that what is sent is bounded
                told.append([[*v, float(y)] for y, rows in both.items() for v in rows[:: max(1, -(-len(rows) // 40))]])
            yield pa.RecordBatch.from_arrays([pa.array(told, type=pa.list_(pa.list_(pa.float64())))], names=["rows"])

    rows = [v for r in some.mapInArrow(run, "rows array<array<double>>").collect() for v in r.rows]
    data = np.array(sorted(rows), dtype=np.float64).reshape(-1, len(PRIOR) + 1)
    return train(data[:, :-1], data[:, -1])


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness between neighbours in page order and between a parent's consecutive blocks."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if k:
            out[k - 1, k] = ADJACENT
        if b.parent in last:
            pair = (last[b.parent], k)
            out[pair] = out.get(pair, 0.0) + SIBLING
        elif k and blocks[k - 1].kind == b.kind and blocks[k - 1].side == b.side and blocks[k - 1].inside == b.inside:
            out[k - 1, k] += SIBLING / 2  # elements of one kind in a row, such as paragraphs
        last[b.parent] = k
    return out


def log_odds(blocks: list[Block], weights: list[float]) -> list[float]:
    within = any(b.inside and not b.side for b in blocks)
    named = any(b.named and not b.side for b in blocks)
    # what stands beside an article's element, or beside one that is only named like it, is less likely content
    beside = OUTSIDE if within else UNNAMED if named else 0.0
    out = []
    for b in blocks:
        text = sum(w * f for w, f in zip(weights, features(b), strict=True))
        text = max(-MOST, min(MOST, text))
        out.append(text + (SIDE if b.side else INSIDE if b.inside else (NAMED if b.named and not within else beside)))
    return out


def minimum_cut(own: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; own: capacity from the source (above 0) or to the sink (below 0).

    Of several minimum cuts the one with the fewest nodes on the source's side.
    """
    n = len(own)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        if c > 0 and a != b:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    own, load = list(own), [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # nodes that outweigh all their edges are decided
        v = queue.popleft()
        if side[v] is not None or (own[v] <= load[v] and -own[v] < load[v]):
            continue
        side[v] = own[v] > load[v]
        for u, c in near[v].items():
            if side[u] is None:
                own[u] += c if side[v] else -c
                load[u] -= c
                queue.append(u)
    open_ = [v for v in range(n) if side[v] is None]
    if open_:
        for v, there in zip(open_, flow_sides(open_, own, near, side), strict=True):
            side[v] = there
    return [bool(x) for x in side]


def flow_sides(open_: list[int], own: list[int], near: list[dict[int, int]], side: list[bool | None]) -> list[bool]:
    """Dinic's algorithm on the nodes that are left."""
    index = {v: k for k, v in enumerate(open_)}
    source, sink = len(open_), len(open_) + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(len(open_) + 2)]

    def add(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for v in open_:
        k = index[v]
        if own[v] > 0:
            add(source, k, own[v], 0)
        elif own[v] < 0:
            add(k, sink, -own[v], 0)
        for u, c in near[v].items():
            if side[u] is None and index[u] > k:
                add(k, index[u], c, c)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[: len(open_)]]
        turn, path, v = [0] * len(out), [], source
        while True:  # a blocking flow, one path after another
            if v == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                first = next(k for k, e in enumerate(path) if not room[e])
                v = to[path[first] ^ 1]
                del path[first:]
            elif turn[v] < len(out[v]):
                e = out[v][turn[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                else:
                    turn[v] += 1
            elif path:
                v = to[path.pop() ^ 1]
                turn[v] += 1
            else:
                break


def main_text(page: str, weights: list[float]) -> str:
    blocks = blocks_of(page)
    own = [round(1000 * x) for x in log_odds(blocks, weights)]
    chosen = minimum_cut(own, {k: round(1000 * v) for k, v in edges_of(blocks).items()})
    return "\n".join(b.text for b, kept in zip(blocks, chosen, strict=True) if kept)


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    w = [float(x) for x in weights]
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [main_text(x, w) for x in texts_of(batch, "html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(found, type=pa.string()), pa.array([len(x) for x in found], type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
