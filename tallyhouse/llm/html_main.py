"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, with the
open ancestors. Each block gets binary features of its ancestors (tags, class
and id words), its text (length, link share, punctuation) and its place. The
chain has two labels, main and other; weights of (feature, label) and (label,
label) are trained by gradient descent on the conditional log-likelihood with
forward and backward sums, and the best labelling is decoded by Viterbi.

Labelled pages are of two kinds: ``EXAMPLES``, written here by hand with each
block's label, and at most ``max_pages`` pages of the table, drawn by hash order,
whose blocks are labelled by their semantic containers (inside ``article`` or
``main``, and in no navigation, footer, aside, form or comment list: main). Pages
without such a container are not used for training. Class and container features
are dropped at random in training, so text features learn to carry a page, too.

Defined cases: null and empty html, and pages whose blocks are all other, give an
empty text; unclosed tags, comments and quotes end at the end of the page, but
an unclosed or self-closed svg, object, template, iframe or noscript is empty;
stray end tags are ignored; every input row gives one row, also rows that repeat
a page_id; null ids and urls stay null; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts

BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
                       "figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol option p pre "
                       "section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style title textarea".split())
#: Their content is never main text; without an end tag of their own, or self-closed, they are empty.
HIDDEN_TAGS = frozenset("noscript template iframe svg object".split())
#: An opening tag of the key ends an open element of the values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OTHER_CONTAINERS = frozenset("nav footer aside form menu select button dialog".split())
_HIDDEN = re.compile(f"<(?:{'|'.join(sorted(HIDDEN_TAGS))})(?![^\\s/>])", re.I)
_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_OTHER_NAME = re.compile(r"^(?:ad|ads|advert|comment|comments|cookie|notice|banner|sidebar|menu|footer|header|nav|promo|related|share|social|newsletter)$")


@dataclass(frozen=True)
class Params:
    max_pages: int = 300
    epochs: int = 16
    rate: float = 0.1
    decay: float = 1e-3
    example_weight: float = 12.0
    drop: float = 0.25
    seed: int = 5


@dataclass
class Block:
    ancestors: list[tuple[str, tuple[str, ...]]]
    parts: list[str]
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks with text, in page order."""
    page, ends = html or "", {}
    if _HIDDEN.search(page):
        _parse(page, ends, find=True)
    return _parse(page, ends)


def _parse(page: str, ends: dict[int, int], find: bool = False) -> list[Block]:
    """Leaf blocks without the hidden elements in ``ends`` (end of start tag: end of element), which ``find`` fills."""
    out, stack = [], []
    current: Block | None = None
    at, quotes = 0, True

    def add(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            if not text.strip():
                return
            current = Block(list(stack), [])
        text = entities.unescape(text)
        current.parts.append(text)
        if any(t == "a" for t, _ in stack):
            current.linked += len(text)

    def close() -> None:
        nonlocal current
        if current is not None and current.text:
            out.append(current)
        current = None

    while at < len(page):
        m = _START.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at: m.start()])
        if m[1]:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            continue
        rest = _REST.match(page, m.end()) if quotes and not m[2] else None
        if rest:
            end = rest.end()
        else:
            quotes = quotes and bool(m[2])  # an unclosed quote: later tags end at the next >
            end = page.find(">", m.end()) + 1 or len(page)
        attrs, at = page[m.end(): end], end
        if m[2]:
            continue
        tag = m[4].lower()
        if m[3]:
            if tag in BLOCK_TAGS:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if find and tag in HIDDEN_TAGS:
                        ends[stack[i][1]] = at
                    del stack[i:]
                    break
            continue
        if tag in RAW_TAGS and not (find and attrs.endswith("/>") and any(t == "svg" for t, _ in stack)):
            done = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            if not done:
                break
            at = page.find(">", done.end()) + 1 or len(page)
            continue
        if tag in HIDDEN_TAGS:
            if find and not attrs.endswith("/>"):
                stack.append((tag, at))
            at = ends.get(at, at) if not find else at
            continue
        if tag == "br":
            add(" ")
        if tag in BLOCK_TAGS:
            close()
            ended = ENDS.get(tag, ()) if tag in ENDS else ("p",)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ended:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK_TAGS or stack[i][0] in HIDDEN_TAGS:
                    break
        if tag not in VOID_TAGS and not attrs.endswith("/>"):
            names = tuple(w for g in _NAMES.findall(attrs) for w in _WORDS.findall("".join(g).lower()))
            stack.append((tag, names))
    close()
    return out


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(page):
        text = b.text
        words = text.split(" ")
        f = ["bias", f"len{min(len(words).bit_length(), 8)}", f"link{round(4 * min(1.0, b.linked / max(len(text), 1)))}",
             f"place{4 * i // len(page)}", "sentence" if text[-1] in ".!?…。" else "open"]
        if i == 0:
            f.append("first")
        if i == len(page) - 1:
            f.append("last")
        if "©" in text or "|" in text or "·" in text:
            f.append("mark")
        own = next((t for t, _ in reversed(b.ancestors) if t in BLOCK_TAGS), "")
        f.append(f"own-{own}")
        seen = {f"in-{t}" for t, _ in b.ancestors if t not in ("html", "body")}
        seen |= {f"name-{n}" for _, names in b.ancestors for n in names}
        out.append(f + sorted(seen))
    return out


def container_labels(page: list[Block]) -> list[int] | None:
    """1 main, 0 other, by semantic containers; None for a page without any."""
    out = []
    for b in page:
        tags = {t for t, _ in b.ancestors}
        names = {n for _, ns in b.ancestors for n in ns}
        main = bool(tags & {"article", "main"}) and not tags & OTHER_CONTAINERS
        out.append(int(main and not any(_OTHER_NAME.match(n) for n in names)))
    return out if any(out) else None


def _examples() -> list[tuple[str, list[int]]]:
    """Hand-labelled pages: html, and the label of each leaf block in order."""
    long = "The river rose in the night and the old bridge, which had stood for a century, was closed to carts before dawn."
    more = "People on both banks waited for news, and by noon the water had reached the mill; nobody was hurt."
    return [
        (f"<body><header><a href=/>Home</a></header><nav><ul><li><a>News</a><li><a>Sport</a></ul></nav><main><h1>Flood</h1><p>{long}<p>{more}"
         "</main><aside><h3>Related</h3><p><a>Another story</a></p></aside><footer>© 2020 Paper</footer></body>", [0, 0, 0, 1, 1, 1, 0, 0, 0]),
        (f"<div id=header>The Daily</div><div class=menu><a>One</a> <a>Two</a></div><div class=content><h2>Flood</h2><p>{long}</p><p>{more}</p></div>"
         f"<div class=sidebar><p>Most read today</p></div><div class=comments><p>I saw it too.</p><p>{more}</p></div><div id=footer>© Daily | Terms</div>",
         [0, 0, 1, 1, 1, 0, 0, 0, 0]),
        (f"<div class=cookie-notice><p>We use cookies to improve the site.</p><button>Accept</button></div><article><h1>Flood</h1><p>{more}</p>"
         f"<div class=ad>Buy new boots now.</div><p>{long}</p><ul><li>First the mill.</li><li>Then the bridge.</li></ul>"
         f"<section class=comments><p>{more}</p></section></article><form><label>Mail</label><p>Subscribe to our letter.</p></form>",
         [0, 0, 1, 1, 0, 1, 1, 1, 0, 0, 0]),
        (f"<table><tr><td><a>Home</a><td><a>About</a></table><h1>Flood</h1><p>{long}</p><blockquote>{more}</blockquote><p>{more}</p><p>© 2019 · All rights reserved</p>",
         [0, 0, 1, 1, 1, 1, 0]),
        (f"<article><header><h1>Flood</h1></header><p>{long}</p><pre>a  b</pre><aside>{more}</aside><footer>Posted by Ann</footer></article>"
         f"<div class='reader comment'><p>{long}</p></div>", [1, 1, 1, 0, 0, 0]),
    ]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _gradient(emit: np.ndarray, trans: np.ndarray, y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected counts of (block, label) and (label, label)."""
    n = len(y)
    fore, back = np.empty((n, 2)), np.zeros((n, 2))
    fore[0] = emit[0]
    for i in range(1, n):
        fore[i] = _log_sum(fore[i - 1][:, None] + trans, 0) + emit[i]
    for i in range(n - 2, -1, -1):
        back[i] = _log_sum(trans + (emit[i + 1] + back[i + 1])[None, :], 1)
    total = _log_sum(fore[-1], 0)
    node = np.eye(2)[y] - np.exp(fore + back - total)
    edge = np.zeros((2, 2))
    for i in range(1, n):
        edge[y[i - 1], y[i]] += 1
        edge -= np.exp(fore[i - 1][:, None] + trans + (emit[i] + back[i])[None, :] - total)
    return node, edge


def train(pages: list[str], p: Params = Params()) -> dict:
    """Weights {"feature": {name: [other, main]}, "trans": 2 x 2}."""
    data = [(features(blocks(h)), y, p.example_weight) for h, y in _examples()]
    for h in pages:
        page = blocks(h)
        y = container_labels(page) if page else None
        if y:
            data.append((features(page), y, 1.0))
    index = {f: i for i, f in enumerate(sorted({f for fs, _, _ in data for b in fs for f in b}))}
    w, trans = np.zeros((len(index), 2)), np.zeros((2, 2))
    g2, t2 = np.full(w.shape, 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in rng.permutation(len(data)):
            fs, y, weight = data[k]
            ids = []
            for b in fs:
                keep = rng.random(len(b)) >= p.drop
                ids.append([index[f] for f, ok in zip(b, keep) if ok or not f.startswith(("in-", "name-"))])
            emit = np.stack([w[i].sum(axis=0) for i in ids])
            node, edge = _gradient(emit, trans, y)
            flat = np.concatenate([np.array(i) for i in ids])
            grad = np.zeros_like(w)
            np.add.at(grad, flat, np.repeat(node, [len(i) for i in ids], axis=0))
            for x, g, s in ((w, grad * weight - p.decay * w, g2), (trans, edge * weight - p.decay * trans, t2)):
                s += g * g
                x += p.rate * g / np.sqrt(s)
    return {"feature": {f: w[i].tolist() for f, i in index.items()}, "trans": trans.tolist()}


def decode(fs: list[list[str]], model: dict) -> list[int]:
    """Best labelling by Viterbi; ties go to other."""
    weight, t = model["feature"], model["trans"]
    best, back = (0.0, 0.0), []
    for i, b in enumerate(fs):
        e0 = e1 = 0.0
        for f in b:
            w = weight.get(f)
            if w:
                e0 += w[0]
                e1 += w[1]
        if i == 0:
            best = (e0, e1)
            continue
        a, c = best[0] + t[0][0], best[1] + t[1][0]
        d, g = best[0] + t[0][1], best[1] + t[1][1]
        back.append((int(c > a), int(g > d)))
        best = (max(a, c) + e0, max(d, g) + e1)
    if not fs:
        return []
    y = [int(best[1] > best[0])]
    for pair in reversed(back):
        y.append(pair[y[-1]])
    return y[::-1]


def main_text(html: str | None, model: dict) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, y in zip(page, decode(features(page), model)) if y)


def fit(pages: DataFrame, params: Params = Params()) -> dict:
    """Model from the hand-labelled pages and a bounded sample of the table, trained in one task."""
    sample = (pages.where(F.col("html").isNotNull()).orderBy(F.xxhash64("html", F.lit(params.seed))).limit(params.max_pages).select("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [h for rows in batches for h in rows["html"]]
        yield pd.DataFrame({"model": [json.dumps(train(sorted(found), params))]})

    got = sample.coalesce(1).mapInPandas(run, "model string").collect()
    return json.loads(got[0]["model"]) if got else train([], params)


def extract(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = fit(pages, params)

    def run(htmls: list) -> tuple[None, list]:
        texts = [main_text(h, model) for h in htmls]
        return None, [texts, [len(t) for t in texts]]

    return over_texts(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "html", ["page_id", "url"], lambda: run,
                      "text string, n_chars long")
