"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read into leaf blocks (runs of text that no block-level tag interrupts), each with the tags, classes and ids
of its ancestors. Features of ancestors and text give each block a score, a transition matrix ties neighbours, and
Viterbi picks the blocks of the article. Weights are learned by maximum likelihood (forward-backward, numpy) from
labelled pages that `labelled_pages` writes by rule over many layouts and namings; a fixed seed makes them repeatable.

Null or empty html, or a page whose blocks are all rejected, gives the empty text. Unclosed tags, truncated pages and
stray `<` are read much as browsers do, in one pass and in time proportional to the page, however long or deep it is; nothing is capped. A
missing end tag of a button, select, svg or object ends at the next block. Of decodings that tie Viterbi takes the one that
leaves text out first. Repeated rows are each read on their own. An empty table gives no rows. Only the html is read and the columns to keep
are passed on; others may have any names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

#: Elements by their role in HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
}
#: Elements whose text is no markup up to their own end tag, or else to the page's end.
RAW_TAGS = "script|style|textarea|title|iframe|xmp|noembed|noframes"
#: Elements whose text is no part of a page. The first kind holds no blocks, so that a block inside means that its end tag is missing.
SKIPPED = frozenset("button select svg math object canvas audio video".split())
SKIPPED_WHOLE = frozenset("noscript template".split())
TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*\Z)|<({RAW_TAGS})(?=[\s/>])[^>]*>(?:.*?</\1(?=[\s/>])[^>]*>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|([^>]*)(?:>|\Z))",
    re.S | re.I,
)
ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """An open block element: its parent, the features that no ancestor has, its tag, and (once scored) their weight."""

    __slots__ = ("leaf", "own", "up", "weight")

    def __init__(self, up: Node | None, own: tuple[str, ...], leaf: str):
        self.up, self.own, self.leaf, self.weight = up, own, leaf, None

    def path(self) -> tuple[str, ...]:
        out, node = [f"leaf={self.leaf}"], self
        while node is not None:
            out += node.own
            node = node.up
        return tuple(out)


@dataclass
class Block:
    node: Node
    text: str
    link_chars: int = 0


def names(attrs: str) -> list[str]:
    """Parts of class, id and role names: `mainContent ad-box` gives main, content, ad, box."""
    return ["n=" + p.lower() for m in ATTR.finditer(attrs) for p in PART.findall(m[2] or m[3] or m[4] or "") if not p.isdigit()]


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order, in time proportional to its length: each open element knows its place on the stack
    and each block only the features that it adds to its ancestors'."""
    out: list[Block] = []
    stack: list[tuple[str, Node]] = [("#", Node(None, ("t=#",), "#"))]
    places: dict[str, list[int]] = {}  # of the open elements of each name
    blocks = [0]  # places of the open block elements
    held: dict[str, int] = {"t=#": 1}  # features of the open block elements
    buf: list[str] = []
    link_chars = hidden = 0

    def flush() -> None:
        nonlocal link_chars
        if buf:
            text = " ".join(entities.unescape("".join(buf)).split())
            if text:
                out.append(Block(stack[-1][1], text, link_chars))
            buf.clear()
        link_chars = 0

    def pop(n: int) -> None:
        nonlocal hidden
        while len(stack) > n:
            tag, node = stack.pop()
            places[tag].pop()
            hidden -= tag in SKIPPED or tag in SKIPPED_WHOLE
            if blocks[-1] == len(stack):
                blocks.pop()
                for f in node.own:
                    del held[f]

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def add(piece: str) -> None:
        nonlocal link_chars
        if not hidden:
            buf.append(piece)
            if places.get("a"):
                link_chars += len(piece)

    pos = 0
    for m in TOKEN.finditer(page):
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        if m[3] is None:
            if m[1]:
                buf.append(" ")
            continue
        tag = m[3].lower()
        block = tag in BLOCK_TAGS
        if block:
            if hidden and not m[2] and (at := last(SKIPPED)) > last(SKIPPED_WHOLE):
                pop(at)
            flush()
        elif tag == "br":
            buf.append(" ")
        if m[2]:
            if places.get(tag):
                pop(places[tag][-1])
            continue
        if block and stack[blocks[-1]][0] == "p":
            pop(blocks[-1])
        if tag in CLOSED_BY:
            own, stop = CLOSED_BY[tag]
            if last(own) > last(stop):
                pop(last(own))
        if tag in VOID_TAGS or (m[4] or "").endswith("/"):
            continue
        up = stack[blocks[-1]][1]
        if block:
            own = tuple(f for f in dict.fromkeys(["t=" + tag, *names(m[4] or m[5] or "")]) if f not in held)
            held.update(dict.fromkeys(own, 1))
            blocks.append(len(stack))
            up = Node(up, own, tag)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, up))
        hidden += tag in SKIPPED or tag in SKIPPED_WHOLE
    if pos < len(page):
        add(page[pos:])
    flush()
    return out


def text_features(b: Block, i: int, n: int) -> list[str]:
    words = b.text.count(" ") + 1
    share = b.link_chars / max(1, len(b.text))
    return [
        f"words={min(words.bit_length(), 7)}", f"links={0 if share < 0.1 else 1 if share < 0.5 else 2}", f"stop={b.text[-1] in '.!?…。”\"'}",
        f"commas={min(b.text.count(','), 3)}", f"sign={any(c in b.text for c in '©|»·›')}", f"at={min(4 * i // n, 3)}", f"end={i == 0}{i == n - 1}", "bias",
    ]


@dataclass
class Model:
    weights: dict[str, float]  # of "article" against "other"
    step: np.ndarray  # 2 x 2

    def weight(self, node: Node) -> float:
        todo = []
        while node is not None and node.weight is None:
            todo.append(node)
            node = node.up
        total = node.weight if node is not None else 0.0
        for n in reversed(todo):
            total += sum(self.weights.get(f, 0.0) for f in n.own)
            n.weight = total
        return total

    def scores(self, found: list[Block]) -> list[float]:
        return [self.weight(b.node) + self.weights.get(f"leaf={b.node.leaf}", 0.0) + sum(self.weights.get(f, 0.0) for f in text_features(b, i, len(found))) for i, b in enumerate(found)]

    def decode(self, found: list[Block]) -> list[bool]:
        """Viterbi over two labels."""
        (a00, a01), (a10, a11) = self.step.tolist()
        v0, v1, back = 0.0, 0.0, []
        for i, s in enumerate(self.scores(found)):
            if i:
                from0, from1 = v0 + a00 >= v1 + a10, v0 + a01 > v1 + a11
                back.append((not from0, not from1))
                v0, v1 = max(v0 + a00, v1 + a10), max(v0 + a01, v1 + a11)
            v1 += s
        path, now = [], v1 > v0
        for b in reversed(back):
            path.append(now)
            now = b[now]
        return [*path[::-1], now][-len(found) :] if not back else [now, *path[::-1]]


def labelled_pages(n: int, seed: int = 11) -> list[list[tuple[Block, bool]]]:
    """Pages written by rule, as blocks with labels. Text of the article carries a mark that its words lack elsewhere."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    mark = ""

    def word() -> str:
        return "".join(pick(["an", "re", "ti", "sho", "la", "be", "ing", "ver", "ci", "ou", "mo", "k"]) for _ in range(rng.integers(1, 5)))

    def prose(lo: int, hi: int) -> str:
        ws = [word() for _ in range(rng.integers(lo, hi))]
        return " ".join(w + ("," if rng.random() < 0.08 else ". " if rng.random() < 0.08 else "") for w in ws).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/x">{word()}</a></li>' for _ in range(k))

    def named(tag: str, options: list[str], body: str) -> str:
        how = pick(["class", "class", "id"])
        return f'<{tag} {how}="{pick(["", "", "site-", "page_", "block "])}{pick(options)}{pick(["", "", "-box", " wrap", "-inner"])}">{body}</{tag}>'

    def sentence_or_links() -> str:
        return pick([f"<ul>{links(rng.integers(2, 8))}</ul>", prose(2, 40), f"<p>{prose(3, 50)}</p>", f"<h3>{prose(1, 4)}</h3><p>{prose(2, 25)}</p>"])

    clutter = [
        lambda: f"<nav>{pick([f'<ul>{links(rng.integers(2, 9))}</ul>', ' '.join(f'<a href=x>{word()}</a>' for _ in range(5))])}</nav>",
        lambda: named("div", ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "pagination", "toc"], sentence_or_links()),
        lambda: f"<header>{pick(['', f'<h1>{prose(1, 4)}</h1>', f'<p>{prose(1, 8)}</p>'])}<ul>{links(3)}</ul></header>",
        lambda: named("div", ["header", "masthead", "logo", "branding", "top"], sentence_or_links()),
        lambda: f"<footer>{pick(['', '&copy; '])}{prose(2, 40)}</footer>",
        lambda: f"<footer><p>{prose(2, 40)}</p><ul>{links(3)}</ul></footer>",
        lambda: named("div", ["footer", "copyright", "legal", "bottom", "colophon"], pick(["&copy; ", ""]) + prose(3, 30)),
        lambda: f"<aside>{sentence_or_links()}</aside>",
        lambda: named("div", ["sidebar", "aside", "related", "widget", "recommended", "trending", "popular", "more", "rail", "tags"], sentence_or_links()),
        lambda: named(pick(["div", "div", "section", "p"]), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "banner", "sponsor", "adsense"], prose(2, 45)),
        lambda: named("div", ["cookie", "consent", "notice", "gdpr", "alert", "popup", "modal", "disclaimer", "privacy", "warning"], pick([prose(3, 40), f"<p>{prose(3, 40)}</p>"])),
        lambda: f"<form>{pick(['', '<p>'])}<label>{prose(1, 5)}</label><input name=q>{prose(1, 12)}</form>",
        lambda: named("div", ["newsletter", "subscribe", "signup", "login", "search", "share", "social", "follow"], sentence_or_links()),
        lambda: named(pick(["section", "div", "ol"]), ["comments", "comment", "replies", "disqus", "discussion", "respond", "responses", "reviews"], "".join(f'<div class="{pick(["comment", "reply", "user", "body", "item"])}"><p>{prose(3, 60)}</p></div>' for _ in range(rng.integers(1, 4)))),
    ]

    def paragraph() -> str:
        body = mark + prose(1 if rng.random() < 0.15 else 6, 120)
        if rng.random() < 0.08:
            body = body.replace(" ", pick([" | ", " · ", " » ", " © "]), int(rng.integers(1, 9)))
        if rng.random() < 0.15:
            body += f' <a href="/x">{word()}</a> {prose(1, 9)}'
        return pick([f"<p>{body}</p>"] * 6 + [f"<p><b>{body}<br>", f"<p>{body}", f"<blockquote>{body}</blockquote>", f"<ul><li>{body}</li><li>{mark}{prose(2, 20)}</li></ul>", f"<h2>{mark}{prose(1, 7)}</h2>", f"<div>{body}</div>", f"<pre>{body}</pre>", f"<table><tr><td>{mark}{prose(1, 9)}</td><td>{mark}{prose(1, 9)}</td></tr></table>"])

    def article() -> str:
        parts = [paragraph() for _ in range(rng.integers(1, 14))]
        if rng.random() < 0.3:
            parts.insert(rng.integers(len(parts) + 1), clutter[rng.integers(7, len(clutter))]())
        title = f"<h1>{mark}{prose(1, 12)}</h1>" if rng.random() < 0.8 else ""
        if title and rng.random() < 0.15:
            title = f"<header>{title}</header>"
        body = title + "".join(parts)
        return pick([f"<article>{body}</article>"] * 4 + [f"<main>{body}</main>", f"<main><article>{body}</article></main>", f'<div class="{pick(["content", "post", "entry", "story", "article", "post-body", "entry-content", "main-content", "text", "articleBody"])}">{body}</div>', f'<div id="{pick(["content", "main", "article", "story", "body"])}">{body}</div>', f"<section>{body}</section>", body])

    pages = []
    for _ in range(n):
        before = "".join(clutter[i]() for i in rng.integers(0, len(clutter), rng.integers(0, 5)))
        after = "".join(clutter[i]() for i in rng.integers(0, len(clutter), rng.integers(0, 5)))
        body = f"{before}{article()}{after}"
        if rng.random() < 0.3:
            body = f'<div class="{pick(["wrapper", "container", "page", "site"])}">{body}</div>'
        found = leaf_blocks(f"<!DOCTYPE html><html><head><title>{prose(1, 9)}</title></head><body>{body}</body></html>")
        labelled = []
        for b in found:
            main = mark in b.text
            b.text = b.text.replace(mark, "")
            if b.text:
                labelled.append((b, main))
        pages.append(labelled)
    return pages


@lru_cache(maxsize=2)
def train(n_pages: int = 900, seed: int = 11, rounds: int = 200, ridge: float = 0.3) -> Model:
    """Maximum likelihood with a ridge, by Adam; pages of like length take the forward and backward steps together."""
    pages = labelled_pages(n_pages, seed)
    rows = [[*b.node.path(), *text_features(b, i, len(p))] for p in pages for i, (b, _) in enumerate(p)]
    number: dict[str, int] = {}
    for r in rows:
        for f in r:
            number.setdefault(f, len(number))
    x = np.zeros((len(rows), len(number)), np.float32)
    for i, r in enumerate(rows):
        x[i, [number[f] for f in r]] = 1
    y = np.array([m for p in pages for _, m in p], np.int64)
    longest = max(map(len, pages))
    at = np.full((len(pages), longest), -1)
    k = 0
    for i, p in enumerate(pages):
        at[i, : len(p)] = range(k, k + len(p))
        k += len(p)
    live = at >= 0
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[at[:, :-1][live[:, 1:]]], y[at[:, 1:][live[:, 1:]]]), 1)

    theta = np.zeros(len(number) + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        w, step = theta[:-4], theta[-4:].reshape(2, 2)
        s = np.append(x @ w.astype(np.float32), 0.0)
        e = np.stack([np.zeros_like(at, float), s[at]], 2)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(live[:, t, None], e[:, t] + np.logaddexp(fwd[:, t - 1, 0, None] + step[0], fwd[:, t - 1, 1, None] + step[1]), fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = e[:, t + 1] + bwd[:, t + 1]
            bwd[:, t] = np.where(live[:, t + 1, None], np.logaddexp(step[:, 0] + nxt[:, 0, None], step[:, 1] + nxt[:, 1, None]), 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p1 = np.exp(fwd[..., 1] + bwd[..., 1] - z[:, None])
        resid = np.zeros(len(rows))
        resid[at[live]] = p1[live]
        resid -= y
        joint = np.exp(fwd[:, :-1, :, None] + step[None, None] + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        grad = np.concatenate([x.T @ resid.astype(np.float32) + ridge * w, (joint.sum((0, 1)) - pairs).ravel() + ridge * step.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta -= 0.1 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in number.items()}, theta[-4:].reshape(2, 2).copy())


def main_text(model: Model, page: str) -> tuple[str, int]:
    """The article's text and its number of blocks."""
    found = leaf_blocks(page)
    if not found:
        return "", 0
    kept = [b.text for b, main in zip(found, model.decode(found), strict=True) if main]
    return " ".join(kept), len(kept)


def extract(pages: DataFrame, model: Model, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns of each row with text and n_blocks."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> list[list]:
        found = [main_text(shared.value, h) for h in texts]
        return [[x[0] for x in found], [x[1] for x in found]]

    return base.map_texts(pages, html, keep, "text string, n_blocks int", run)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(base.table(spark, sf_dir, "pages"), train())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


QUERIES = {"op7_main_text": op7_main_text}
ORACLE_SQL: dict[str, str] = {}
