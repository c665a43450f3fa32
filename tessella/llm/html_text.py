"""Main text of web pages: a bidirectional LSTM labels every block of a page.

A page becomes its sequence of leaf blocks. Each block has a vector of hashed elements and
classes on its tag path, a vector of hashed words, a few sizes, and how much of the page its
container holds. One LSTM reads the sequence forwards, one backwards, so every block is judged
with the page as context; pages of thousands of blocks are read in overlapping stretches.

No labelled pages exist, so the labeller is trained on a bounded sample of the pages that it
is given, with labels from what the markup itself says, and on varied copies, in which the
original's labels hold: containers are renamed, telling elements and names are taken away or
replaced in whole pages, boilerplate of all kinds, named or not, is put in, and readers'
comments without a telling name are put behind the article. Tag paths are blanked at random,
so that structure, neighbours and words have to do when a path says nothing.

A page is read in one pass, in time that grows with its length: whatever of a tag path is
needed is kept up to date as elements open and close.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.session import bounded_batches, ship_package, table

#: Pages learned from (a bounded sample), blocks of each copy that are learned from (a stretch
#: at a random place), varied copies, and passes: at least so many, and so many steps.
SAMPLE_PAGES, TRAIN_BLOCKS, COPIES, EPOCHS, STEPS = 240, 160, 6, 10, 300
PATH_SLOTS, WORD_SLOTS, SIZES, HIDDEN = 64, 32, 12, 16
WIDTH = PATH_SLOTS + WORD_SLOTS + SIZES
CELLS_AT_ONCE = 40_000
#: Elements by kind (fixed values).
UNSEEN = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "select", "textarea", "math", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure"}
SAME_CLOSES = {"li", "tr", "td", "th", "dt", "dd", "option"}
#: What markup says of itself: elements, and words of class or id (fixed values).
AROUND = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog"}
AROUND_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "social", "related", "recommended", "widget", "toolbar", "legal", "copyright", "disqus", "replies"}
MAIN, MAIN_NAMES = {"article", "main"}, {"article", "content", "post", "entry", "story", "main", "body"}
#: Boilerplate that is put into varied copies: an opening, and its closing (fixed values).
PUT_IN = (
    ("<aside><p>", "</p></aside>"), ('<div class="sidebar"><p>', "</p></div>"), ('<div class="comments"><p>', "</p></div>"), ('<section id="comments"><div class="comment"><p>', "</p></div></section>"),
    ('<div class="cookie-notice">', "</div>"), ('<div class="banner">', "</div>"), ("<form><label>", "</label></form>"), ("<header><h2>", "</h2></header>"), ("<nav><a>", "</a></nav>"),
    ('<div class="advert">', "</div>"), ('<div id="related"><ul><li>', "</li></ul></div>"), ('<div class="newsletter"><p>', "</p></div>"), ("<footer><p>", "</p></footer>"), ('<div class="menu"><ul><li><a>', "</a></li></ul></div>"),
)
CONTAINERS = ("<article>", "<main>", "<main><article>", '<div class="content">', '<div id="main-content">', '<div class="post-body">', "<section>", '<div class="entry">', "<div>")
#: Elements that hold a part of a page.
HOLDERS = {"html", "body", "div", "article", "main", "section", "aside", "nav", "header", "footer", "form", "ul", "ol", "dl", "table", "td", "blockquote", "fieldset", "figure", "details", "dialog"}
#: A tag whose quoted values hold what they hold; and one that ends at the first ``>``.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>=]+|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)>|([^<]+|<)", re.S)
PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|([^<]+|<)", re.S)
TAG_START = re.compile(r"<[/!?]?[a-zA-Z]|<[!?]")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title")}



class Block(NamedTuple):
    """A leaf block: its text, the share of it in links, its path's vector, what the path says
    (1: main text), whether that names boilerplate, its depth, and its container's number."""

    text: str
    linked: float
    path: bytes
    says: int
    around: bool
    depth: int
    holder: int


@lru_cache(1 << 14)
def _slot(x: str, slots: int) -> tuple[int, int]:
    h = zlib.crc32(x.encode())
    return h % slots, 1 if h >> 31 else -1


class _Path:
    """The open elements, and what is known of them: each entry holds what to go back to."""

    def __init__(self) -> None:
        self.stack: list[tuple] = []
        self.open: dict[str, int] = {}
        self.vector = np.zeros(PATH_SLOTS, np.int32)
        self.hidden = self.links = self.around = self.holders = 0
        self.main = False
        self.holder = 0

    def push(self, name: str, names: tuple[str, ...]) -> None:
        before = (self.around, self.main, self.holder)
        for x in (name, *names):
            slot, sign = _slot(x, PATH_SLOTS)
            self.vector[slot] += sign
            if x in AROUND or x[0] == "." and x[1:] in AROUND_NAMES:
                self.around, self.main = self.around + 1, False
            elif x in MAIN or x[0] == "." and x[1:] in MAIN_NAMES:
                self.main = True
        if name in HOLDERS:
            self.holders += 1
            self.holder = self.holders
        inline = name in INLINE
        block = self.stack[-1][3] if inline and self.stack else (-1 if inline else len(self.stack))
        self.stack.append((name, names, before, block))
        self.open[name] = self.open.get(name, 0) + 1
        self.hidden += name in UNSEEN
        self.links += name == "a"

    def pop(self) -> None:
        name, names, (self.around, self.main, self.holder), _ = self.stack.pop()
        for x in (name, *names):
            slot, sign = _slot(x, PATH_SLOTS)
            self.vector[slot] -= sign
        self.open[name] -= 1
        self.hidden -= name in UNSEEN
        self.links -= name == "a"

    def close(self, name: str) -> None:
        """Closes the innermost ``name`` and what is open in it; nothing if there is none."""
        if self.open.get(name):
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def nearest_block(self) -> str:
        """The innermost open element that isn't an inline one."""
        return self.stack[self.stack[-1][3]][0] if self.stack and self.stack[-1][3] >= 0 else ""


def tokens(page: str) -> Iterator[tuple[str | None, str | None, str, str | None, int]]:
    """``ends, name, rest, plain, where it ends`` of each tag and stretch of text; the consumer
    may send a place to go on from. A tag that never ends is text; where quotes never end, tags
    end at the first ``>`` from there on."""
    at, size, last = 0, len(page), page.rfind(">")
    pattern = TOKEN
    while at < size:
        if at > last and TAG_START.match(page, at):  # no tag can end any more
            yield None, None, "", "<", at + 1
            at += 1
            continue
        found = pattern.match(page, at)
        if pattern is TOKEN and found[4] == "<" and TAG_START.match(page, at):
            pattern = PLAIN_TOKEN
            continue
        at = found.end()
        moved = yield (*found.groups(), at)
        if moved is not None:
            at = moved
            yield None, None, "", None, at


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: text between block boundaries, references decoded, white
    space as one space. What can't be seen as text (scripts, styles, heads) has none."""
    out: list[Block] = []
    path = _Path()
    text: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                vector = np.clip(path.vector, -3, 3).astype(np.int8).tobytes()
                out.append(Block(whole, min(1.0, linked / len(whole)), vector, int(path.main and not path.around), path.around > 0, len(path.stack), path.holder))
            text.clear()
        linked = 0

    reading = tokens(page)
    for ends, name, rest, plain, at in reading:
        if plain is not None:
            if not path.hidden:
                text.append(plain)
                linked += len(plain) * bool(path.links)
            continue
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            end_block()
        elif name == "br":
            text.append(" ")
        if ends:
            path.close(name)
            continue
        if name in VOID or rest.endswith("/"):
            continue
        if name in ("script", "style", "textarea", "title"):
            raw = RAW_END[name].search(page, at)
            reading.send(raw.end() if raw else len(page))
            continue
        top = path.nearest_block()
        if name in CLOSES_P and top == "p" or name in SAME_CLOSES and top == name:
            path.close(top)
        if name == "body":
            path.close("head")
        path.push(name, tuple(f".{p}" for m in NAMES.findall(rest) for p in PARTS.findall("".join(m).lower())) if rest else ())
    end_block()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block: hashed tag path, hashed words, sizes, and its container's part of the page."""
    n = len(page)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :PATH_SLOTS] = np.frombuffer(b"".join(b.path for b in page), np.int8).reshape(n, PATH_SLOTS)
    _, holder = np.unique([b.holder for b in page], return_inverse=True)
    chars = np.array([len(b.text) for b in page], np.float64)
    held = np.bincount(holder, chars)
    links = np.bincount(holder, chars * [b.linked for b in page]) / held
    same = np.concatenate([[False], holder[1:] == holder[:-1], [False]])
    for i, b in enumerate(page):
        words = b.text.split()
        hashed = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
        counts = np.bincount(hashed % WORD_SLOTS, minlength=WORD_SLOTS)
        out[i, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = counts / max(1, len(words)) ** 0.5 / 4
        share = held[holder[i]] / chars.sum()
        out[i, PATH_SLOTS + WORD_SLOTS :] = (
            np.log1p(len(words)) / 4, np.log1p(len(b.text)) / 6, b.linked, b.text[-1] in ".!?", i / n, np.log1p(b.depth) / 3,
            share, held[holder[i]] == held.max(), links[holder[i]], same[i], same[i + 1], 1.0,
        )
    return np.clip(out, -3, 3)


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, mask: np.ndarray, w: np.ndarray, keep: bool = False):
    """An LSTM over (pages, time, width); masked steps carry the state on."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, saved = np.zeros((n, steps, HIDDEN), np.float32), []
    read = x @ w[:WIDTH]
    for t in range(steps):
        z = read[:, t] + h @ w[WIDTH:]
        gates, fresh = _sig(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        m = mask[:, t : t + 1]
        new = f * c + i * fresh
        th = np.tanh(new)
        if keep:
            saved.append((h, c, i, f, o, fresh, th, m))
        c = m * new + (1 - m) * c
        h = m * (o * th) + (1 - m) * h
        out[:, t] = h
    return out, saved


def _backward(x: np.ndarray, w: np.ndarray, saved: list, dout: np.ndarray) -> np.ndarray:
    dw = np.zeros_like(w)
    dh, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
    for t in range(len(saved) - 1, -1, -1):
        h, c, i, f, o, fresh, th, m = saved[t]
        dh = dh + dout[:, t]
        dnew_h = m * dh
        dnew = m * dc + dnew_h * o * (1 - th * th)
        dz = np.concatenate([dnew * fresh * i * (1 - i), dnew * c * f * (1 - f), dnew_h * th * o * (1 - o), dnew * i * (1 - fresh * fresh)], axis=1)
        dw[:WIDTH] += x[:, t].T @ dz
        dw[WIDTH:] += h.T @ dz
        dh = (1 - m) * dh + dz @ w[WIDTH:].T
        dc = (1 - m) * dc + dnew * f
    return dw


class Labeller:
    """Two LSTMs and a logistic output over both states."""

    def __init__(self, weights: list[np.ndarray] | None = None) -> None:
        rng = np.random.default_rng(5)
        self.w = weights or [(rng.standard_normal((WIDTH + HIDDEN, 4 * HIDDEN)) * 0.12).astype(np.float32) for _ in range(2)] + [(rng.standard_normal(2 * HIDDEN + 1) * 0.1).astype(np.float32)]
        if weights is None:
            for i in range(2):
                self.w[i][WIDTH - 1, HIDDEN : 2 * HIDDEN] = 1.0  # the last input is one: gates that remember

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        forth, _ = _forward(x, mask, self.w[0])
        back, _ = _forward(x[:, ::-1], mask[:, ::-1], self.w[1])
        return _sig(np.concatenate([forth, back[:, ::-1]], axis=2) @ self.w[2][:-1] + self.w[2][-1])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        forth, a = _forward(x, mask, self.w[0], True)
        back, b = _forward(x[:, ::-1], mask[:, ::-1], self.w[1], True)
        both = np.concatenate([forth, back[:, ::-1]], axis=2)
        d = (_sig(both @ self.w[2][:-1] + self.w[2][-1]) - y) * mask / max(1.0, mask.sum())
        dout = d[:, :, None] * self.w[2][None, None, :-1]
        return [_backward(x, self.w[0], a, dout[:, :, :HIDDEN]), _backward(x[:, ::-1], self.w[1], b, dout[:, ::-1, HIDDEN:]), np.append(np.einsum("nt,ntk->k", d, both), d.sum()).astype(np.float32)]


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), steps, WIDTH), np.float32), np.zeros((len(rows), steps), np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, 1
    return x, mask


def nameless(rng: np.random.Generator) -> str:
    """A class attribute that says nothing, or none."""
    letters = "".join(chr(97 + k) for k in rng.integers(0, 26, 6))
    return "" if rng.random() < 0.5 else f' class="{letters[:3]}-{letters[3:]}"'


def varied(page: str, others: list[str], rng: np.random.Generator) -> tuple[str, set[str]]:
    """A copy with another container around the main text, with or without what tells parts
    apart, and with boilerplate put in; and the texts that were put in."""
    put_in: set[str] = set()

    def text() -> str:
        said = others[rng.integers(len(others))] if others else "text"
        put_in.add(said)
        return html.escape(said)

    box = CONTAINERS[rng.integers(len(CONTAINERS))] if rng.random() < 0.6 else f"<div{nameless(rng)}>"
    ends = "".join(f"</{n}>" for n in reversed(re.findall(r"<(\w+)", box)))
    page = re.sub(r"<(?:article|main)\b[^>]*>", box, page)
    # Readers' comments stand behind the main text, in a container of their own without a telling name.
    comments = ""
    if rng.random() < 0.5:
        each = (("<p>", "</p>"), ("<div><p>", "</p></div>"), (f"<div{nameless(rng)}>", "</div>"), ("<ul><li>", "</li></ul>"))[rng.integers(4)]
        said = "".join(f"{each[0]}{text()}{each[1]}" for _ in range(rng.integers(1, 6)))
        comments = f"<div{nameless(rng)}>{said}</div>" if rng.random() < 0.7 else f"<section{nameless(rng)}><h2>{text()}</h2>{said}</section>"
    page = re.sub(r"</(?:article|main)>", lambda m: ends + comments, page)
    for _ in range(rng.integers(0, 4)):
        opens, closes = PUT_IN[rng.integers(len(PUT_IN))]
        where = [m.end() for m in re.finditer(r"</(?:nav|p|h1|div|article|main|section|footer)>|<body>", page)] or [0]
        at = where[rng.integers(len(where))]
        page = page[:at] + opens + text() + closes + page[at:]
    how = rng.random()
    if how < 0.25:  # no names at all
        page = re.sub(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*')""", "", page)
    elif how < 0.4:  # other names
        page = re.sub(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*')""", lambda m: nameless(rng), page)
    if rng.random() < 0.35:  # no telling elements
        page = re.sub(r"<(/?)(?:nav|aside|footer|header|article|main|section)\b", r"<\1div", page)
    return page, put_in


def fit(pages: list[str], epochs: int = EPOCHS) -> list[np.ndarray]:
    """Weights from a bounded list of pages, by back-propagation through time and Adam."""
    rng = np.random.default_rng(11)
    originals = [blocks(p) for p in pages]
    texts = [b.text for found in originals for b in found[:TRAIN_BLOCKS]]
    others = [t if i % 2 else " ".join(t.split()[:8]) for i, t in enumerate(texts) if t]
    sequences = []
    for page, original in zip(pages, originals):
        main = {b.text for b in original if b.says}
        for k in range(1 + COPIES):
            copy, put_in = varied(page, others, rng) if k else (page, set())
            found = blocks(copy) if k else original
            if not found:
                continue
            labels = [float(b.text in main and b.text not in put_in if k else b.says) for b in found]
            x = vectors(found)
            at = rng.integers(max(1, len(found) - TRAIN_BLOCKS + 1))
            sequences.append((x[at : at + TRAIN_BLOCKS], np.array(labels[at : at + TRAIN_BLOCKS], np.float32)))
    model = Labeller()
    first, second, step = [np.zeros_like(w) for w in model.w], [np.zeros_like(w) for w in model.w], 0
    order = np.argsort([len(y) for _, y in sequences], kind="stable")
    groups = [order[i : i + 24] for i in range(0, len(order), 24)]
    for _ in range(max(epochs, -(-STEPS // max(1, len(groups))))):
        for g in rng.permutation(len(groups)):
            x, mask = padded([sequences[i][0] for i in groups[g]])
            x[:, :, :PATH_SLOTS] *= ((rng.random((*mask.shape, 1)) > 0.1) & (rng.random((len(mask), 1, 1)) > 0.25)).astype(np.float32)
            y = np.zeros_like(mask)
            for j, i in enumerate(groups[g]):
                y[j, : len(sequences[i][1])] = sequences[i][1]
            step += 1
            for w, d, m, v in zip(model.w, model.gradients(x, mask, y), first, second):
                m[...] = 0.9 * m + 0.1 * d
                v[...] = 0.99 * v + 0.01 * d * d
                w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model.w


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """The blocks of each page that score one half or more, joined by line ends.

    Every page is read from end to end and back, however long; pages of about one length are
    read side by side, ``CELLS_AT_ONCE`` blocks at most, and a longer one by itself.
    """
    found = [blocks(p) for p in pages]
    keep = [np.zeros(len(f), bool) for f in found]
    waiting = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    while waiting:
        n = max(1, CELLS_AT_ONCE // len(found[waiting[-1]]))
        part, waiting = waiting[-n:], waiting[:-n]
        x, mask = padded([vectors(found[i]) for i in part])
        for i, scores in zip(part, model.scores(x, mask)):
            keep[i] = scores[: len(found[i])] >= 0.5
    return ["\n".join(b.text for b, k in zip(f, own) if k) for f, own in zip(found, keep)]


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages = sorted(((i, p or "") for b in batches for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    if pages:
        weights = fit([p for _, p in pages])
        yield pa.RecordBatch.from_pydict({"weights": pa.array([w.astype("<f4").tobytes() for w in weights], pa.binary()), "place": pa.array(range(3), pa.int32())})


def train_labeller(pages: DataFrame) -> list[bytes]:
    """Weights of a labeller trained in one task on the pages whose hashed ids come first."""
    chosen = pages.where("html is not null and page_id is not null").select("page_id").distinct().orderBy(F.md5(F.col("page_id").cast("string").cast("binary")), "page_id").limit(SAMPLE_PAGES)
    # One page of an id, whatever repeats.
    sample = pages.join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    found = sample.repartition(1).mapInArrow(_trained, "weights binary, place int").collect()
    return [bytes(r.weights) for r in sorted(found, key=lambda r: r.place)]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    ``text`` has the blocks labelled as main text, in page order, joined by a line end; it is
    empty where there is none, as for null or empty pages. Broken markup is read as far as it
    goes. Repeated and null ids pass through. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    weights_of = spark.sparkContext.broadcast(train_labeller(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = [(WIDTH + HIDDEN, 4 * HIDDEN)] * 2 + [(2 * HIDDEN + 1,)]
        model = Labeller([np.frombuffer(w, "<f4").reshape(s) for w, s in zip(weights_of.value, shapes)] or None)
        for batch in batches:
            texts = main_texts(model, [p or "" for p in batch.column("html").to_pylist()])
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))
