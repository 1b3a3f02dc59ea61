"""Main-text extraction from HTML by a recurrent block labeller.

A page is cut into blocks: runs of text between tags that start or end a block, white space inside a block made one
space. A block is described by its path of open tags with their class, id and role words, and by its words, each hashed
to a fixed width, and by its length and share of link text. A bidirectional LSTM in numpy reads the page's blocks in
order, so every block is labelled in the context of the whole page. Blocks labelled as content are joined by line feeds.

Training: pages made by ``make_page``, with many layouts of menus, headers, footers, sidebars, notices, adverts, forms and
comments around an article, from a fixed seed; the words of a text are random, so the labeller learns from structure,
names, lengths and order. Weights are trained once per driver process and broadcast (well below a megabyte).

Defined cases: a null or empty page has no blocks and an empty text; scripts, styles, templates, comments and the head
hold no blocks; unclosed and stray tags and quotes are tolerated, but an unclosed script, style or comment runs to the end
of the page; a head
ends at the first text or tag that can't stand in it; very long pages are read whole; further columns are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .shingles import word_hashes

PATH, WORDS, CUES = 96, 16, 8
HIDDEN = 24
BATCH = 32
#: What begins at a ``<``: markup without a name, or a tag's name; and the steps through a tag's attributes.
_MARK = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_STEP = re.compile(r"[^>=]*+(?:(>)|=\s*+)")
_BARE = re.compile(r"[^\s>]*+")
_NAME = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|\d+")
_SPACE = re.compile(r"\s+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math annotation menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without blocks. Nothing inside is a tag, whatever it looks like, but the first end tag of the same name.
RAW = frozenset("script style template textarea title iframe select datalist".split())
_END = {tag: re.compile(rf"</{tag}(?:[\s/][^>]*)?(?:>|\Z)", re.I) for tag in RAW}
#: What may stand in a head, besides.
IN_HEAD = frozenset("base basefont bgsound link meta noframes".split())
#: Start tags that end an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())


@lru_cache(maxsize=65_536)
def _words_of(tag: str, attributes: str) -> tuple[int, ...]:
    """Hashed features of a tag: its name, and the words of its class, id and role."""
    names = [f"<{tag}>"]
    for _, *values in _NAME.findall(attributes):
        names += _PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", next((v for v in values if v), "")).lower())
    return tuple(xxhash.xxh32_intdigest(n) % PATH for n in names)


class Marks:
    """The tags of a page, found in one pass: each character is looked at once, however odd the markup is.

    A quote opens a value only where one begins, and only if it is closed somewhere. A tag that would run to the end of the
    page ends at its first ``>``, and so do all tags after it; where there is none, the rest of the page is text.
    """

    def __init__(self, page: str):
        self.page, self.open, self.plain = page, {'"': True, "'": True}, False

    def _after(self, at: int) -> int:
        """The place after the tag whose attributes begin at ``at``, -1 if there is none."""
        page = self.page
        if self.plain:
            return page.find(">", at) + 1 or -1
        first = at
        while step := _STEP.match(page, at):
            at = step.end()
            if step[1]:
                return at
            quote = page[at : at + 1]
            if quote in self.open and self.open[quote]:
                end = page.find(quote, at + 1)
                if end >= 0:
                    at = end + 1
                    continue
                self.open[quote] = False
            at = _BARE.match(page, at).end()
        self.plain = True
        return page.find(">", first) + 1 or -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, tag, whether it is an end tag, attributes), without a tag for markup that isn't one. What is sent
        is the place to go on from, where it isn't the end."""
        page, at = self.page, 0
        while mark := _MARK.search(page, at):
            start, at, tag = mark.start(), mark.end(), ""
            if mark[1] or mark[2]:
                close = "-->" if mark[1] else "]]>"
                end = page.find(close, at)
                at = len(page) if end < 0 else end + len(close)
                found = ""
            elif mark[3]:
                at = page.find(">", at) + 1 or len(page)
                found = ""
            else:
                tag, end = mark[5].lower(), self._after(at)
                if end < 0:
                    return
                found, at = page[at : end - 1], end
            at = (yield start, at, tag, bool(mark[4]), found) or at


def blocks(page: str) -> list[tuple[str, tuple[int, ...], float]]:
    """(text, path features, share of link characters) of each block with text, in page order."""
    out: list[tuple[str, tuple[int, ...], float]] = []
    stack: list[tuple[str, int]] = []  # tags, and the features of all of them so far as bits
    outer: list[int] = []  # places of those that aren't inline
    held: Counter[str] = Counter()
    text: list[str] = []
    path: tuple[int, ...] | None = None
    linked = in_link = at = 0

    def flush() -> None:
        nonlocal text, linked, path
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append((joined, path or (), min(1.0, linked / max(1, len(joined)))))
        text, linked, path = [], 0, None

    def take(piece: str) -> None:
        nonlocal linked, path
        if piece:
            text.append(piece)
            if path is None and not piece.isspace():
                bits = stack[-1][1] if stack else 0
                path = tuple(i for i in range(PATH) if bits >> i & 1)
            linked += len(piece) if in_link else 0

    def cut(depth: int) -> None:
        """Close what is open from ``depth`` on."""
        for tag, _ in stack[depth:]:
            held[tag] -= 1
        del stack[depth:]
        while outer and outer[-1] >= depth:
            outer.pop()

    in_head, endless, marks, jump = False, set(), iter(Marks(page)), None
    while mark := next(marks, None) if jump is None else _sent(marks, jump):
        jump = None
        start, end, tag, ends, attributes = mark
        piece, at = page[at:start], end
        in_head = in_head and not piece.strip()
        if not in_head:
            take(piece)
        if not tag:
            continue
        if ends:
            in_head = in_head and tag not in ("head", "body", "html", "br")
            if tag not in INLINE:
                flush()
            elif tag == "a":
                in_link = max(0, in_link - 1)
            if held[tag]:
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in RAW or tag == "head":
            flush()
            if tag == "head":
                in_head = True
            elif not attributes.rstrip().endswith("/"):
                close = None if tag in endless else _END[tag].search(page, at)
                if close:
                    at = jump = close.end()
                elif tag in ("script", "style"):
                    at = len(page)
                    break
                else:  # never closed: what follows is read as if the tag weren't there
                    endless.add(tag)
            continue
        if in_head and tag in IN_HEAD:
            continue
        in_head = False
        if tag == "br":
            take(" ")
        if tag not in INLINE:
            flush()
            in_link = 0
            closes = {"p"} if tag in ENDS_P else CLOSES.get(tag, ())
            if outer and stack[outer[-1]][0] in closes:  # an open paragraph or item ends here, with what is inside it
                cut(outer[-1])
        elif tag == "a":
            in_link += 1
        if tag not in VOID:
            bits = stack[-1][1] if stack else 0
            for i in _words_of(tag, attributes):
                bits |= 1 << i
            if tag not in INLINE:
                outer.append(len(stack))
            stack.append((tag, bits))
            held[tag] += 1
    take(page[at:])
    flush()
    return out


def _sent(marks: Iterator, place: int):
    try:
        return marks.send(place)
    except StopIteration:
        return None


def features(found: list[tuple[str, tuple[int, ...], float]]) -> np.ndarray:
    """A row per block: path, words and cues."""
    x = np.zeros((len(found), PATH + WORDS + CUES), dtype=np.float32)
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t, _, _ in found]
    starts, hashes = word_hashes(b"\n".join(encoded))
    edges = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    of = np.searchsorted(edges, starts, side="right") - 1
    counts = np.bincount(of * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=len(found) * WORDS).reshape(-1, WORDS)
    words = counts.sum(axis=1)
    x[:, PATH : PATH + WORDS] = counts / np.maximum(1, words)[:, None]
    for i, (text, path, linked) in enumerate(found):
        if path:
            x[i, list(path)] = 1.0
        length = len(text)
        x[i, PATH + WORDS :] = (min(1.0, length / 40), min(1.0, length / 400), min(1.0, words[i] / 10), linked, text[-1] in ".!?…", "©" in text, i / len(found), 1.0)
    return x


@dataclass
class Weights:
    """Of both directions: inputs, recurrences and biases of the gates; and the output layer."""

    arrays: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(w: dict[str, np.ndarray], side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of one direction for a padded batch (pages, blocks, features); what back-propagation needs."""
    n, steps, _ = x.shape
    projected = x @ w[side + "x"] + w[side + "b"]
    h = c = np.zeros((n, HIDDEN), dtype=x.dtype)
    out, kept = np.zeros((n, steps, HIDDEN), dtype=x.dtype), []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = projected[:, t] + h @ w[side + "h"]
        i, f, o, g = (_sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :]))
        m = mask[:, t, None]
        c_new = f * c + i * g
        tanh = np.tanh(c_new)
        kept.append((t, i, f, o, g, c, tanh, h, m))
        c = np.where(m, c_new, c)
        h = np.where(m, o * tanh, h)
        out[:, t] = h
    return out, kept


def predict(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    forward, kept_f = _run(w, "f", x, mask)
    backward, kept_b = _run(w, "r", x, mask)
    both = np.concatenate([forward, backward], axis=2)
    return _sigmoid(both @ w["o"] + w["ob"])[:, :, 0], (both, kept_f, kept_b)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over the batch's blocks."""
    p, (both, kept_f, kept_b) = predict(w, x, mask)
    error = ((p - y) * mask / mask.sum())[:, :, None].astype(x.dtype)
    grads = {"o": np.einsum("nth,nto->ho", both, error), "ob": error.sum(axis=(0, 1))}
    d_both = error @ w["o"].T
    for side, kept, d_out in (("f", kept_f, d_both[:, :, :HIDDEN]), ("r", kept_b, d_both[:, :, HIDDEN:])):
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=x.dtype)
        d_h, d_c, d_rec = np.zeros_like(kept[0][7]), np.zeros_like(kept[0][7]), np.zeros_like(w[side + "h"])
        for t, i, f, o, g, c, tanh, h, m in reversed(kept):
            dh = d_h + d_out[:, t]
            live = dh * m
            dc = d_c * m + live * o * (1 - tanh * tanh)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), live * tanh * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[:, t] = dz
            d_rec += h.T @ dz
            d_h = dz @ w[side + "h"].T + dh * ~m
            d_c = dc * f + d_c * ~m
        grads[side + "h"] = d_rec
        grads[side + "x"] = np.einsum("ntf,ntz->fz", x, dz_all)
        grads[side + "b"] = dz_all.sum(axis=(0, 1))
    return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, pages))
    x, mask = np.zeros((len(pages), width, PATH + WORDS + CUES), dtype=np.float32), np.zeros((len(pages), width), dtype=bool)
    for i, page in enumerate(pages):
        x[i, : len(page)], mask[i, : len(page)] = page, True
    return x, mask


def _words(rng: np.random.Generator, n: int) -> str:
    return " ".join("".join(rng.choice(list("aeiourstlnmdéü"), rng.integers(2, 9))) for _ in range(n))


def make_page(rng: np.random.Generator) -> list[tuple[str, bool]]:
    """A page as (markup, content?) pieces, one block each; layout, names and lengths are drawn at random."""
    pick = lambda *options: options[rng.integers(len(options))]
    attr = lambda *names: pick("", f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{pick(*names)} {pick("wrap", "box", "inner", "col", "row")}"')
    named = lambda *names: pick(f' class="{pick(*names)}"', f' id="{pick(*names)}"')
    sentence = lambda a, b: _words(rng, int(rng.integers(a, b))).capitalize() + pick(".", ".", ".", "", "!")
    pieces: list[tuple[str, bool]] = []

    def junk(open_: str, items: list[str], close: str) -> None:
        for i, item in enumerate(items):
            pieces.append(((open_ if i == 0 else "") + item + (close if i == len(items) - 1 else ""), False))

    def links(n: int) -> list[str]:
        return [f'<li><a href="#">{_words(rng, int(rng.integers(1, 4)))}</a></li>' for _ in range(n)]

    many = lambda a, b: int(rng.integers(a, b))
    paragraphs = lambda a, b, lo, hi: [pick(f"<p>{sentence(lo, hi)}</p>", f"<div>{sentence(lo, hi)}</div>") for _ in range(many(a, b))]
    if rng.random() < 0.6:
        junk(f"<header{attr('header', 'masthead', 'top', 'site-header')}>", [f"<p>{sentence(1, 6)}</p>", *([f"<h1>{sentence(1, 4)}</h1>"] if rng.random() < 0.2 else [])], "</header>")
    if rng.random() < 0.8:
        if rng.random() < 0.7:
            junk(f"<nav{attr('nav', 'menu', 'navbar', 'main-menu')}><ul>", links(many(2, 10)), "</ul></nav>")
        else:
            junk(f"<div{named('nav', 'menu', 'navbar', 'navigation', 'breadcrumbs')}><ul>", links(many(2, 8)), "</ul></div>")
    extras = {
        "ad": lambda: junk(f"<div{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>", paragraphs(1, 3, 3, 25) if rng.random() < 0.6 else [sentence(3, 25)], "</div>"),
        "notice": lambda: junk(f"<{(t := pick('div', 'section', 'aside'))}{named('cookie', 'cookie-notice', 'consent', 'notice', 'gdpr', 'popup', 'newsletter', 'subscribe', 'alert')}>", paragraphs(1, 3, 4, 30), f"</{t}>"),
        "side": lambda: junk(f"<{(t := pick('aside', 'aside', 'div'))}{named('sidebar', 'side', 'related', 'widget', 'recommended', 'social', 'share')}>", [f"<h3>{_words(rng, 2)}</h3>", *(links(many(1, 6)) if rng.random() < 0.5 else paragraphs(1, 4, 3, 30))], f"</{t}>"),
        "form": lambda: junk(f"<form{attr('search', 'login', 'signup', 'contact')}>", [f"<label>{_words(rng, 2)}</label>", f"<p>{sentence(2, 12)}</p>", f"<button>{_words(rng, 1)}</button>"][: many(1, 4)], "</form>"),
        "bare_aside": lambda: junk("<aside>", paragraphs(1, 4, 3, 40), "</aside>"),
    }

    def extra(p: float) -> None:
        for key in rng.permutation(list(extras)):
            if rng.random() < p:
                extras[key]()

    extra(0.3)
    open_, close = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<div class="post"><div class="entry">', "</div></div>"), ('<section class="story">', "</section>"), ('<div class="article-body">', "</div>"))
    body = [f"<h1>{sentence(2, 12)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(many(1, 16)):
        body.append(pick(f"<p>{sentence(1, 90)}</p>", f"<p>{sentence(1, 90)}</p>", f"<p>{sentence(5, 60)}", f"<p><b>{sentence(3, 40)}<br>", f"<p>{sentence(2, 20)} <a href='#'>{_words(rng, 2)}</a> {sentence(2, 20)}</p>", f"<h2>{sentence(1, 8)}</h2>", f"<blockquote>{sentence(4, 40)}</blockquote>", f"<ul><li>{sentence(2, 20)}</li></ul>", f"<pre>{sentence(4, 20)}</pre>", f"<table><tr><td>{sentence(1, 8)}</td></tr></table>", f"<div>{sentence(3, 60)}</div>", f"<figure><figcaption>{sentence(2, 14)}</figcaption></figure>"))
    for i, piece in enumerate(body):
        pieces.append(((open_ if i == 0 else "") + piece, True))
        if 0 < i < len(body) - 1 and rng.random() < 0.06:
            extras[pick("ad", "notice", "side", "bare_aside")]()
    inside = rng.random() < 0.25
    comments = rng.random() < 0.35

    def discussion() -> None:
        tag = pick("div", "section", "aside", "ol")
        junk(f"<{tag}{named('comments', 'comment-list', 'disqus', 'responses', 'discussion', 'replies')}>", [pick(f'<div class="comment"><p>{sentence(2, 50)}</p></div>', f"<p>{sentence(2, 50)}</p>", f'<li class="comment">{sentence(2, 50)}</li>') for _ in range(many(1, 6))], f"</{tag}>")

    if comments and inside:
        discussion()
    pieces.append((close + "<hr>", True))
    if comments and not inside:
        discussion()
    extra(0.25)
    if rng.random() < 0.85:
        tag = pick("footer", "footer", "footer", "div")
        items = [pick(f"<p>&copy; {sentence(1, 12)}</p>", f"&copy; example &middot; {sentence(2, 12)}", f"<p>{sentence(2, 14)}</p>")] + (links(many(1, 5)) if rng.random() < 0.4 else [])
        junk(f"<{tag}{named('footer', 'copyright', 'site-footer') if tag == 'div' else attr('footer', 'copyright', 'bottom')}>", items, f"</{tag}>")
    return pieces


TRAIN_PAGES, EPOCHS, SEED = 700, 14, 7


def training_pages(count: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of made pages. A block's label is that of the piece in which its text starts."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(count):
        pieces = make_page(rng)
        marked = "".join(re.sub(r">(?=[^<]*[^<\s])", f">{'@@1 ' if content else '@@0 '}", markup) if "<" in markup else markup for markup, content in pieces)
        found = blocks(f"<html><head><title>x</title></head><body>{marked}</body></html>")
        labels = np.array([t.split("@@", 1)[1][:1] == "1" if "@@" in t else False for t, _, _ in found], dtype=np.float32)
        cleaned = [(re.sub(r"@@[01] ", "", t).strip() or "x", p, s) for t, p, s in found]
        if cleaned:
            out.append((features(cleaned), labels))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """Weights fitted by Adam on made pages; word features of half the pages are dropped in each epoch."""
    rng, width = np.random.default_rng(seed), PATH + WORDS + CUES
    draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    w = {"o": draw(2 * HIDDEN, 1), "ob": np.zeros(1, dtype=np.float32)}
    for side in "fr":
        w |= {side + "x": draw(width, 4 * HIDDEN), side + "h": draw(HIDDEN, 4 * HIDDEN), side + "b": np.zeros(4 * HIDDEN, dtype=np.float32)}
        w[side + "b"][HIDDEN : 2 * HIDDEN] = 1.0
    data = sorted(training_pages(pages, seed), key=lambda d: len(d[0]))
    batches = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
    mean, square, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        rate = 0.01 if epoch < epochs * 2 // 3 else 0.003
        for b in rng.permutation(len(batches)):
            x, mask = padded([p for p, _ in batches[b]])
            y = np.zeros(mask.shape, dtype=np.float32)
            for i, (_, labels) in enumerate(batches[b]):
                y[i, : len(labels)] = labels
            x[rng.random(len(x)) < 0.5, :, PATH : PATH + WORDS] = 0
            step += 1
            for k, g in gradients(w, x, y, mask).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Weights(w)


def label(w: dict[str, np.ndarray], pages: list[list]) -> list[np.ndarray]:
    """For each page's blocks whether they are content; pages of like length run together."""
    out = [np.zeros(0, dtype=bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    for a in range(0, len(order), BATCH):
        own = order[a : a + BATCH]
        x, mask = padded([features(pages[i]) for i in own])
        p, _ = predict(w, x, mask)
        for row, i in zip(p, own, strict=True):
            out[i] = row[: len(pages[i])] > 0.5
    return out


def extracted(df: DataFrame, *, markup: str, into: str = "main") -> DataFrame:
    """``df`` with a struct column ``into``: text, n_blocks and n_content. No shuffle."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(trained().arrays)

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_content", T.LongType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a in range(0, len(batch), 256):
                pages = [blocks(p or "") for p in batch.iloc[a : a + 256]]
                for page, content in zip(pages, label(shared.value, pages), strict=True):
                    rows.append(("\n".join(t for (t, _, _), c in zip(page, content, strict=True) if c), len(page), int(content.sum())))
            yield pd.DataFrame(rows, columns=["text", "n_blocks", "n_content"])

    return df.withColumn(into, run.asNondeterministic()(F.col(markup)))
