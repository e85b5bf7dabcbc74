"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks, each with the path of elements above it. A block is a
vector of hashed path parts, hashed words and a few counts; a bidirectional LSTM, written and trained in
numpy, reads the whole sequence both ways and labels every block from what stands anywhere in the page.

There are no labelled pages, so the labeller learns from two sources: a bounded sample of the given pages
(``SAMPLE``), labelled by what their elements and class names declare, and pages composed from the texts
of that sample in many layouts, whose labels are known. Every page is then labelled over its whole length.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marquesina.llm.common import map_texts, table

PATHS, WORDS = 2_048, 4_096
PATH_SIZE, WORD_SIZE, COUNTS, HIDDEN = 16, 8, 6, 16
SAMPLE = 300
SAMPLE_CHARS = 100_000
COMPOSED = 900
EPOCHS = 10
BATCH = 32
RATE = 0.01
SEED = 11
# Blocks of one page that training reads; every page is labelled whole.
LONGEST = 160

# Elements of HTML by the way they show text.
RAW = "script style".split()
UNSEEN = "title noscript template textarea select svg iframe object canvas datalist".split()
BLOCKS = set(
    "address article aside blockquote body br button caption center col dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag on the left ends an open element on the right.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"br", "button"}

# Scripts and styles hide all up to their end, other unseen elements only if they have an end; closed in itself, each hides only its tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:(" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|(" + "|".join(UNSEEN) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?<!/)>.*?</\2\s*>"
    r"|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[!?/][^>]*>)|([^<]+|<)", re.S | re.I,
)
_MARKS = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

_OFF = re.compile(
    r"^(?:ad|ads|advert|advertisement|adsense|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"nav|navigation|navbar|menu|breadcrumb|breadcrumbs|header|masthead|topbar|footer|copyright|legal|sidebar|aside|rail|widget|related|recommended|"
    r"trending|popular|share|sharing|social|follow|subscribe|subscription|newsletter|signup|login|search|form|comment|comments|commentlist|reply|replies|"
    r"disqus|respond|discussion|reader|readers|tags|pagination|pager|skip|toolbar|complementary|contentinfo)$"
)
_MAIN = re.compile(r"^(?:article|main|content|post|entry|story|body|text|articlebody|maincontent)$")
_OFF_TAGS = {"nav", "footer", "aside", "form", "menu", "button", "dialog"}


@dataclass
class Leaf:
    """One block: the parts of its path, from the root, its text, and how many of its characters are links."""

    path: list[tuple[str, ...]]
    text: str
    linked: int


def leaves(page: str) -> list[Leaf]:
    """Leaf blocks of a page in order, of pages of any length.

    Elements left open are closed with the element around them. A page whose head is not closed, or with unseen elements
    that close in themselves or never, keeps the text that follows; formulas are text.
    """
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    state = [0, 0]  # open links, linked characters

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append(Leaf([x[1] for x in stack], text, state[1]))
            state[1] = 0

    def pop(to: int) -> None:
        state[0] -= sum(1 for x in stack[to:] if x[0] == "a")
        del stack[to:]

    for m in _TOKEN.finditer(page):
        text = m[6]
        if text is not None:
            parts.append(text)
            if state[0] > 0:
                state[1] += len(text)
            continue
        if m[4] is None:
            continue
        tag = m[4].lower()
        if tag in BLOCKS:
            flush()
            # What cannot stand in a head ends it; its end tag may be left out.
            if stack and stack[-1][0] == "head":
                pop(len(stack) - 1)
        if m[3]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        ends = ENDS.get(tag, {"p"} if tag in CLOSES_P else ())
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    pop(i)
                    break
                if stack[i][0] in ("table", "ul", "ol", "dl", "div", "section", "article", "td", "th", "blockquote", "li") and stack[i][0] not in ends:
                    break
        if tag not in VOID and not m[5].endswith("/"):
            marks = [tag]
            if "=" in m[5]:
                for found in _MARKS.findall(m[5]):
                    marks += [x.lower() for x in _PART.findall("".join(found))]
            stack.append((tag, tuple(marks)))
            state[0] += tag == "a"
    flush()
    return out


def declared(leaf: Leaf) -> int:
    """What the elements above a block say of it: 1 main text, 0 not, by the innermost that says anything."""
    inside = any(p[0] in ("article", "main") or any(_MAIN.match(x) for x in p[1:]) for p in leaf.path)
    for p in leaf.path:
        if p[0] in _OFF_TAGS or any(_OFF.match(x) for x in p[1:]) or (p[0] == "header" and not inside):
            return 0
    return int(inside)


def _crc(kind: str, value: str, size: int) -> int:
    return zlib.crc32(f"{kind}{value}".encode()) % size


class Reader:
    """Hashed features of blocks, remembering path parts and words."""

    def __init__(self):
        self.parts: dict[tuple[str, ...], list[int]] = {}

    def path(self, path: list[tuple[str, ...]]) -> list[int]:
        out: list[int] = []
        for marks in path:
            found = self.parts.get(marks)
            if found is None:
                if len(self.parts) > 100_000:
                    self.parts.clear()
                found = self.parts[marks] = [_crc("t", marks[0], PATHS), *[_crc("c", x, PATHS) for x in marks[1:]]]
            out += found
        return out or [0]

    def page(self, blocks: list[Leaf]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        paths, words, counts = [], [], np.zeros((len(blocks), COUNTS))
        for i, b in enumerate(blocks):
            paths.append(self.path(b.path))
            tokens = b.text.lower().split()
            words.append([zlib.crc32(w.encode()) % WORDS for w in tokens])
            n = len(tokens)
            counts[i] = (
                min(np.log1p(n) / 5, 2.0), min(1.0, b.linked / max(1, len(b.text))), min(1.0, (b.text.count(".") + b.text.count(",")) / n),
                min(1.0, sum(c.isdigit() for c in b.text[:400]) / 40), i / max(1, len(blocks) - 1), min(len(b.path), 12) / 12,
            )
        return paths, words, counts


def _mean(weights: np.ndarray, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    flat = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(sizes.sum()))
    owner = np.repeat(np.arange(len(rows)), sizes)
    out = np.stack([np.bincount(owner, weights[flat, k], len(rows)) for k in range(weights.shape[1])], axis=1) / np.maximum(sizes, 1)[:, None]
    return out, flat, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Bidirectional LSTM over block vectors; ``p`` holds all weights."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = SEED) -> Labeller:
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + COUNTS
        p = {"path": rng.normal(0, 0.5, (PATHS, PATH_SIZE)), "word": rng.normal(0, 0.1, (WORDS, WORD_SIZE))}
        for way in "fb":
            p[f"{way}x"] = rng.normal(0, size**-0.5, (size, 4 * HIDDEN))
            p[f"{way}h"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            p[f"{way}c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        p["out"] = rng.normal(0, 0.3, (2 * HIDDEN + size, 1))
        p["bias"] = np.zeros(1)
        return Labeller(p)

    def _vectors(self, paths, words, counts):
        a, a_flat, a_owner = _mean(self.p["path"], paths)
        b, b_flat, b_owner = _mean(self.p["word"], words)
        return np.concatenate([a, b, counts], axis=1), (a_flat, a_owner), (b_flat, b_owner)

    def _run(self, way: str, x: np.ndarray, on: np.ndarray, keep: bool):
        """States of one direction; x is time by page by size, ``on`` marks the blocks that exist."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out, saved = np.zeros((steps, pages, HIDDEN)), []
        given = x @ self.p[f"{way}x"] + self.p[f"{way}c"]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.p[f"{way}h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = on[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                saved.append((t, h, c, i, f, o, g, tc, m))
            c = np.where(m, c_new, c)
            h = np.where(m, o * tc, h)
            out[t] = h
        return out, saved

    def _back(self, way: str, x: np.ndarray, saved, d_out: np.ndarray, grad: dict) -> np.ndarray:
        dx = np.zeros_like(x)
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t, h, c, i, f, o, g, tc, m in reversed(saved):
            dh = dh + d_out[t]
            live_h, live_c = dh * m, dc * m
            do = live_h * tc
            dct = live_c + live_h * o * (1 - tc * tc)
            dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - g * g)], axis=1)
            grad[f"{way}x"] += x[t].T @ dz
            grad[f"{way}h"] += h.T @ dz
            grad[f"{way}c"] += dz.sum(0)
            dx[t] = dz @ self.p[f"{way}x"].T
            dh = np.where(m, dz @ self.p[f"{way}h"].T, dh)
            dc = np.where(m, dct * f, dc)
        return dx

    def _padded(self, pages: list[tuple], keep: bool):
        sizes = [len(x[0]) for x in pages]
        flat, a, b = self._vectors([r for x in pages for r in x[0]], [r for x in pages for r in x[1]], np.concatenate([x[2] for x in pages]))
        t = np.concatenate([np.arange(n) for n in sizes])
        k = np.repeat(np.arange(len(pages)), sizes)
        x, on = np.zeros((max(sizes), len(pages), flat.shape[1])), np.zeros((max(sizes), len(pages)), bool)
        x[t, k], on[t, k] = flat, True
        (hf, sf), (hb, sb) = self._run("f", x, on, keep), self._run("b", x, on, keep)
        top = np.concatenate([hf, hb, x], axis=2)[t, k]
        return _sigmoid((top @ self.p["out"])[:, 0] + self.p["bias"][0]), (t, k, x, top, sf, sb, a, b)

    def label(self, pages: list[tuple]) -> list[np.ndarray]:
        """Probability of main text of every block of every page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i][0]), key=lambda i: len(pages[i][0]))
        for a in range(0, len(order), 128):
            some = order[a : a + 128]
            p, _ = self._padded([pages[i] for i in some], False)
            for i, q in zip(some, np.split(p, np.cumsum([len(pages[i][0]) for i in some])[:-1])):
                out[i] = q
        return out

    def fit(self, pages: list[tuple], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
        """Adam on the cross entropy of all blocks."""
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), BATCH):
                some = [pages[i] for i in order[a : a + BATCH]]
                y = np.concatenate([labels[i] for i in order[a : a + BATCH]])
                # Words are dropped at random: the texts of composed pages say little about their place.
                some = [(x[0], [r if rng.random() > 0.5 else [] for r in x[1]], x[2]) for x in some]
                p, (t, k, x, top, sf, sb, (a_flat, a_own), (b_flat, b_own)) = self._padded(some, True)
                error = ((p - y) / len(y))[:, None]
                grad = {name: np.zeros_like(v) for name, v in self.p.items()}
                grad["out"], grad["bias"] = top.T @ error, error.sum(0)
                d_top = np.zeros((*x.shape[:2], top.shape[1]))
                d_top[t, k] = error @ self.p["out"].T
                dx = d_top[:, :, 2 * HIDDEN :].copy()
                dx += self._back("f", x, sf, d_top[:, :, :HIDDEN], grad)
                dx += self._back("b", x, sb, d_top[:, :, HIDDEN : 2 * HIDDEN], grad)
                d = dx[t, k]
                for name, flat, own, part in (("path", a_flat, a_own, d[:, :PATH_SIZE]), ("word", b_flat, b_own, d[:, PATH_SIZE : PATH_SIZE + WORD_SIZE])):
                    size = np.maximum(np.bincount(own, minlength=len(d)), 1)
                    share = (part / size[:, None])[own]
                    for j in range(share.shape[1]):
                        grad[name][:, j] = np.bincount(flat, share[:, j], len(grad[name]))
                step += 1
                for name, g in grad.items():
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.999 * m2[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - RATE * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
        return self


def composed(texts: list[str], n: int = COMPOSED, seed: int = SEED) -> tuple[list[list[Leaf]], list[np.ndarray]]:
    """Pages of many layouts made from given texts, with the label of every block."""
    rng = np.random.default_rng(seed)
    texts = texts or ["The river rose in the night, and by morning the lower fields were under water.", "Tickets at the door."]
    pick = lambda *x: x[rng.integers(len(x))]
    some = lambda: html.escape(texts[rng.integers(len(texts))])
    few = lambda: " ".join(some().split()[: rng.integers(1, 7)])

    def links(k: int) -> str:
        items = "".join(pick(f"<li><a href='/{i}'>{few()}</a></li>", f"<a href='/{i}'>{few()}</a> ") for i in range(k))
        return pick(f"<ul>{items}</ul>", items)

    def off() -> str:
        """A part that is not main text."""
        body = pick(f"<p>{some()}</p>", f"<p>{few()}</p>", some(), links(rng.integers(2, 7)), f"<h3>{few()}</h3><p>{some()}</p>")
        name = pick(
            "sidebar", "widget", "ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo", "related", "related-posts", "share", "social",
            "newsletter", "subscribe", "cookie-notice", "cookie-banner", "consent", "notice", "popup", "breadcrumb", "menu", "nav", "footer", "site-header", "tags",
        )
        return pick(
            f"<div class='{name}'>{body}</div>", f"<div id='{name}'>{body}</div>", f"<aside>{body}</aside>", f"<aside class='{name}'>{body}</aside>",
            f"<section class='{name}'>{body}</section>", f"<form action='/x' class='{pick('search', 'signup', 'login')}'><label>{few()}</label><p>{few()}</p><button>{few()}</button></form>",
        )

    def comments() -> str:
        one = lambda: pick(f"<div class='comment'><b>{few()}</b><p>{some()}</p></div>", f"<li class='comment'><p>{some()}</p></li>", f"<article class='comment'><p>{some()}</p></article>")
        many = "".join(one() for _ in range(rng.integers(1, 6)))
        return pick(f"<section class='comments'><h2>{few()}</h2>{many}</section>", f"<div id='comments'>{many}</div>", f"<ol class='commentlist'>{many}</ol>", f"<section id='comments'>{many}<form><p>{few()}</p></form></section>", f"<div class='reader-comments'>{many}</div>")

    def on() -> str:
        """A part of the main text."""
        return pick(
            f"<p>{some()}</p>", f"<p>{some()}</p>", f"<p>{some()}</p>", f"<p><b>{some()}<br>", f"<h2>{few()}</h2><p>{some()}</p>", f"<blockquote>{some()}</blockquote>", f"<p>{few()}</p>",
            f"<ul><li>{some()}</li><li>{few()}</li></ul>", f"<figure><img src='x'><figcaption>{few()}</figcaption></figure>", f"<pre>{few()}</pre>",
            f"<table><tr><th>{few()}</th><td>{few()}</td></tr></table>", f"<p>{few()} <a href='/y'>{few()}</a> {some()}</p>", f"<div><p>{some()}</p></div>", f"<h3>{few()}</h3>",
        )

    pages, labels = [], []
    for _ in range(n):
        parts: list[tuple[int, str]] = []
        if rng.random() < 0.85:
            parts.append((0, pick(f"<nav>{links(rng.integers(2, 8))}</nav>", f"<header><a href='/'>{few()}</a><nav>{links(3)}</nav></header>", f"<div class='menu'>{links(5)}</div>", f"<header class='site-header'><p>{few()}</p></header>")))
        parts += [(0, off()) for _ in range(rng.integers(0, 3))]
        wrap = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article class='post'>", "</article></main>"), ("<div class='content'>", "</div>"), ("<div id='main-content'>", "</div>"), ("<div class='post-body'>", "</div>"), ("<div class='entry-content'>", "</div>"), ("<section class='story'>", "</section>"), ("<div>", "</div>"))
        inner = [(1, pick(f"<h1>{few()}</h1>", f"<header><h1>{few()}</h1></header>", f"<h1>{some()}</h1>"))] + [(1, on()) for _ in range(rng.integers(0, 12))]
        for _ in range(rng.integers(0, 3) if rng.random() < 0.5 else 0):
            inner.insert(int(rng.integers(1, len(inner) + 1)), (0, off()))
        if rng.random() < 0.2:
            inner.append((0, comments()))
        parts += [(2, wrap[0]), *inner, (2, wrap[1])]
        if rng.random() < 0.3:
            parts.append((0, comments()))
        parts += [(0, off()) for _ in range(rng.integers(0, 3))]
        if rng.random() < 0.85:
            parts.append((0, pick(f"<footer>&copy; {few()} &middot; {some()}</footer>", f"<footer><p>{some()}</p>{links(3)}</footer>", f"<div class='footer'><p>{some()}</p></div>")))
        # A mark inside every part's text tells afterwards which part a block came from.
        page = "<html><body>" + "".join(x if k == 2 else re.sub(r">([^<>]*[^<>\s][^<>]*)", lambda m, k=k: f">{'¤' if k else '¬'}{m[1]}", f"<i>{x}</i>" if x[0] != "<" else x) for k, x in parts) + "</body></html>"
        blocks = leaves(page)
        labels.append(np.array([float("¤" in b.text) for b in blocks]))
        for b in blocks:
            b.text = b.text.replace("¤", "").replace("¬", "") or "x"
        pages.append(blocks)
    return pages, labels


def trained(pages: DataFrame) -> Labeller:
    """Labeller from a bounded sample of pages: the first ``SAMPLE`` in order of a hash, of at most ``SAMPLE_CHARS``."""
    fit = pages.select("page_id", "html").filter(F.length("html").between(1, SAMPLE_CHARS))
    # Ids are chosen first, so that tasks send ids and not their own best pages to the driver.
    chosen = fit.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    # Of several pages with one id the least is taken, so that training can be repeated.
    own = fit.join(F.broadcast(chosen), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))
    rows = own.orderBy(F.xxhash64("page_id"), "page_id").collect()
    blocks = [leaves(r[1]) for r in rows]
    texts = [b.text for page in blocks for b in page if len(b.text.split()) > 5]
    made, labels = composed(texts)
    reader = Reader()
    given = [page[:LONGEST] for page in blocks if page]
    return Labeller.fresh().fit(
        [reader.page(p) for p in [*given, *made]], [*[np.array([float(declared(b)) for b in p]) for p in given], *labels]
    )


def main_text(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """``(page_id, url, text, n_chars)``: main blocks in page order, joined by a space.

    A null page is an empty one; a page without main blocks has an empty text. Repeated rows get a row each.
    """

    def make():
        reader = Reader()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            read = [leaves(x or "") for x in batch.column("html").to_pylist()]
            labels = labeller.label([reader.page(b) for b in read])
            texts = [" ".join(b.text for b, p in zip(blocks, ps) if p >= 0.5) for blocks, ps in zip(read, labels)]
            return pa.RecordBatch.from_arrays([
                batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())
            ], ["page_id", "url", "text", "n_chars"])

        return work

    return map_texts(pages, ["page_id", "url", "html"], make, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return main_text(pages, trained(pages))
