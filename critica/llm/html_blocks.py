"""Operator 10: main text of HTML pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block-level
tags, with the path of open elements (names, classes, ids, roles).  Each
block is a vector of hashed path tokens, hashed words and a few measures.
A bidirectional LSTM in numpy reads the whole sequence and classifies
every block as article text or not, so what stands before and after a
block counts too.  The article's blocks, character references decoded and
white space collapsed, are joined in page order.

Training.  No page comes with labelled blocks.  A bounded sample
(``SAMPLE`` different pages of at most ``SAMPLE_CHARS`` characters, those
with the smallest hashes) gives the texts.  Where names that authors give to
page parts (BOILERPLATE, ARTICLE) tell a page's article from the rest, the
page is training data itself, and its texts are laid out anew ``LAYOUTS``
times.  In a new layout the label of every text is known, because the layout
puts it there: containers of the article have usual, random, misleading or
no names, lie in tables or forms, menus and footers have names or none, and
comments, notices, forms and adverts stand around and inside the article.
So the network has to learn the texts and their context besides the names.
Pages without telling names give no labels of their own.  The same sample
and seed give the same network.

Scale: one pass over the table labels it, without a shuffle.  Two passes
before choose the sample: hashes alone, then the chosen pages; these are the
only data on the driver, and the network (some 100 kB) goes to the tasks.

Defined results.  Null and empty html, and pages without an article, give
an empty text.  Unclosed tags, comments, scripts and stray characters are
read leniently, in time linear in the page; an element of text that is none
(svg) has to be closed to hide anything, except those that end with the page
(script, style, title, textarea, iframe).  Pages of any length are read whole.  Repeated rows are
read row by row; an empty table gives an empty result.  Other columns of
the input are not carried.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_CHARS, LAYOUTS = 200, 65_536, 3
PATH_DIMS, WORD_DIMS, HIDDEN = 160, 48, 16
MEASURES = 8
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.02, 11
#: Longest stretch of blocks in training (labelling reads pages whole).
STRETCH = 80

#: Elements that break the text into blocks.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names (elements, classes, ids, roles) of parts that are not the article.
BOILERPLATE = frozenset(
    "ad ads advert advertisement advertorial adverts alert aside banner bottombar breadcrumb breadcrumbs button captcha "
    "comment comments commentlist consent contentinfo cookie cookies copyright dialog discussion disqus feedback footer "
    "form gdpr head header legal links login masthead menu menubar modal nav navbar navigation newsletter notice "
    "notification pager pagination popup privacy promo promoted promotion reactions recommended related replies reply "
    "respond search select share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription "
    "teaser toolbar topbar tracking widget".split())
ARTICLE = frozenset(
    "article articlebody body-text content entry entrycontent main maincontent post postbody postcontent story storybody "
    "text".split())

#: Elements whose content is no text of the page; the first ones reach to the page's end if unclosed.
RAW_TAGS = ("script", "style", "title", "textarea", "iframe", "template", "svg")
_TO_THE_END = frozenset(RAW_TAGS[:5])
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW_TAGS}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|[^<]+|<", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of each leaf block with text."""
    out, stack, parts, linked = [], [], [], 0
    paths: list[tuple[str, ...]] = [()]
    at: tuple[str, ...] = ()

    def flush():
        nonlocal parts, linked
        text = " ".join(html_lib.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((at, text, linked))
        parts, linked = [], 0

    links, pos = 0, 0
    last_end = page.rfind(">")
    unclosed: set[str] = set()
    while pos < len(page):
        if page[pos] == "<" and pos > last_end:  # no tag ends any more: the rest is text
            token, m = page[pos:], None
        else:
            m = _TOKEN.match(page, pos)
            token = m.group()
        pos += len(token)
        if m is None or token[0] != "<" or token == "<":
            if not parts:
                at = paths[-1]
            parts.append(token)
            if links:
                linked += len(token)
            continue
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        closing = bool(m.group(1) or m.group(4))
        attributes = m.group(3) or m.group(6) or ""
        if name in _CLOSING and not closing and not (name == "svg" and attributes.endswith("/")):
            # What has no end once has none later on.
            end = None if name in unclosed else _CLOSING[name].search(page, pos)
            if end is not None:
                pos = end.end()
                continue
            unclosed.add(name)
            if name in _TO_THE_END:
                break
        if name in BLOCK_TAGS:
            flush()
        elif name == "br":
            parts.append(" ")
        if closing:
            if name == "a":
                links = max(0, links - 1)
            if name in stack:
                while stack:
                    paths.pop()
                    if stack.pop() == name:
                        break
            continue
        if name in VOID_TAGS or attributes.endswith("/"):
            continue
        # A block ends an open paragraph; items, rows and cells end their like.
        if name in BLOCK_TAGS and stack and (stack[-1] == "p" or stack[-1] == name and name in ("li", "dd", "dt", "tr", "td", "th", "option")):
            stack.pop()
            paths.pop()
        elif name in BLOCK_TAGS and "p" in stack[-4:] and not set(stack[len(stack) - stack[::-1].index("p"):]) & BLOCK_TAGS:
            while stack.pop() != "p":
                paths.pop()
            paths.pop()
        if name == "a":
            links += 1
        found = [name]
        for a, b, c in _NAMES.findall(attributes):
            value = (a or b or c).lower()
            found.extend(_PART.findall(value))
            found.append("".join(_PART.findall(value)))
        stack.append(name)
        paths.append(paths[-1] + tuple(found) if name in BLOCK_TAGS or len(found) > 1 else paths[-1])
    flush()
    return out


def named_label(path: tuple[str, ...]) -> int:
    """1 if the names on a path say article, else 0."""
    inside = False
    for name in path:
        if name in ARTICLE:
            inside = True
        elif name in BOILERPLATE and not (inside and name == "header"):
            return 0
    return int(inside)


_buckets: dict[tuple[str, int], int] = {}


def _bucket(token: str, dims: int) -> int:
    got = _buckets.get((token, dims))
    if got is None:
        if len(_buckets) > 500_000:
            _buckets.clear()
        got = _buckets[token, dims] = zlib.crc32(token.encode()) % dims
    return got


def vectors(blocks: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    """(len(blocks), DIMS) inputs of the network."""
    out = np.zeros((len(blocks), DIMS), np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        row = out[i]
        for depth, name in enumerate(path):
            row[_bucket(name, PATH_DIMS)] = 1.0
        words = _WORD.findall(text)
        if words:
            row[PATH_DIMS:PATH_DIMS + WORD_DIMS] = np.sqrt(np.bincount(
                [_bucket(w, WORD_DIMS) for w in words], minlength=WORD_DIMS) / len(words))
        row[-8] = float("©" in text or "®" in text)
        row[-7] = float("h1" in path or "h2" in path or "h3" in path)
        row[-6] = np.log1p(len(words)) / 5
        row[-5] = min(1.0, linked / len(text))
        row[-4] = (text.count(".") + text.count(",")) / (len(words) + 1)
        row[-3] = len(path) / 10
        row[-2] = i / len(blocks)
        row[-1] = float(text[-1] in ".!?…\"”»")
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, 0.1, (DIMS, 4 * h)).astype(np.float32)
            self.p["U" + d] = rng.normal(0, 0.2, (h, 4 * h)).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h:2 * h] = 1.0  # forget gate
            self.p["c" + d] = bias
        self.p["V"] = rng.normal(0, 0.2, (2 * h, 1)).astype(np.float32)
        self.p["S"] = np.zeros((DIMS, 1), np.float32)
        self.p["o"] = np.zeros(1, np.float32)

    def _direction(self, x, mask, d):
        h, (n, t, _) = HIDDEN, x.shape
        z = x @ self.p["W" + d] + self.p["c" + d]
        u = self.p["U" + d]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        keep = []
        for k in range(t):
            gates = z[:, k] + state @ u
            i, f, o = (_sigmoid(gates[:, j * h:(j + 1) * h]) for j in range(3))
            g = np.tanh(gates[:, 3 * h:])
            m = mask[:, k:k + 1]
            new = f * cell + i * g
            squashed = np.tanh(new)
            keep.append((state, cell, i, f, o, g, squashed, m))
            cell = m * new + (1 - m) * cell
            state = m * (o * squashed) + (1 - m) * state
        states = np.stack([k[0] for k in keep[1:]] + [state], axis=1) if keep else np.zeros((n, 0, h), np.float32)
        return states, keep

    def forward(self, x, mask):
        back = _reversed(x, mask)
        sf, kf = self._direction(x, mask, "f")
        sb, kb = self._direction(back, mask, "b")
        both = np.concatenate([sf, _reversed(sb, mask)], axis=2)
        logits = (both @ self.p["V"] + x @ self.p["S"])[:, :, 0] + self.p["o"]
        return _sigmoid(logits), (x, back, mask, both, kf, kb)

    def _direction_gradient(self, x, keep, d_states, d, grads):
        h = HIDDEN
        u = self.p["U" + d]
        d_state = np.zeros_like(d_states[:, 0])
        d_cell = np.zeros_like(d_state)
        dz = np.zeros((*x.shape[:2], 4 * h), np.float32)
        for k in range(x.shape[1] - 1, -1, -1):
            state, cell, i, f, o, g, squashed, m = keep[k]
            total = d_state + d_states[:, k]
            ds = m * total
            dc = m * d_cell + ds * o * (1 - squashed ** 2)
            gate = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), ds * squashed * o * (1 - o),
                                   dc * i * (1 - g ** 2)], axis=1)
            dz[:, k] = gate
            grads["U" + d] += state.T @ gate
            d_state = gate @ u.T + (1 - m) * total
            d_cell = dc * f + (1 - m) * d_cell
        grads["W" + d] += np.tensordot(x, dz, axes=([0, 1], [0, 1]))
        grads["c" + d] += dz.sum(axis=(0, 1))

    def gradient(self, x, mask, y):
        p, (x, back, mask, both, kf, kb) = self.forward(x, mask)
        n = max(1.0, float(mask.sum()))
        loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        d = (mask * (p - y) / n).astype(np.float32)[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["V"] += np.tensordot(both, d, axes=([0, 1], [0, 1]))
        grads["S"] += np.tensordot(x, d, axes=([0, 1], [0, 1]))
        grads["o"] += d.sum()
        d_both = d @ self.p["V"].T
        self._direction_gradient(x, kf, d_both[:, :, :HIDDEN], "f", grads)
        self._direction_gradient(back, kb, _reversed(d_both[:, :, HIDDEN:], mask), "b", grads)
        return loss, grads

    def fit(self, pages, labels, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> float:
        """Adam over stretches of pages; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        parts = [(x[a:a + STRETCH], y[a:a + STRETCH]) for x, y in zip(pages, labels) for a in range(0, len(x), STRETCH)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, last = 0, 0.0
        for _ in range(epochs):
            losses = []
            order = rng.permutation(len(parts))
            for a in range(0, len(order), BATCH):
                some = [parts[i] for i in order[a:a + BATCH]]
                x, mask = _padded([s[0] for s in some])
                y = np.zeros(mask.shape, np.float32)
                for i, s in enumerate(some):
                    y[i, :len(s[1])] = s[1]
                loss, grads = self.gradient(x, mask, y)
                losses.append(loss)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
            last = float(np.mean(losses))
        return last

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Each page's probabilities; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= 8192:
                end += 1
            x, mask = _padded([pages[i] for i in order[at:end]])
            p, _ = self.forward(x, mask)
            for k, i in enumerate(order[at:end]):
                out[i] = p[k, :len(pages[i])]
            at = end
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x = np.zeros((len(pages), t, DIMS), np.float32)
    mask = np.zeros((len(pages), t), np.float32)
    for i, p in enumerate(pages):
        x[i, :len(p)] = p
        mask[i, :len(p)] = 1
    return x, mask


def _reversed(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each row's unmasked stretch back to front, in place of itself."""
    n, t = mask.shape
    lens = mask.sum(axis=1).astype(int)[:, None]
    at = np.arange(t)[None, :]
    return x[np.arange(n)[:, None], np.where(at < lens, lens - 1 - at, at)]


#: Marks of the texts of a new layout (private characters, which no label depends on).
_IS_ARTICLE, _IS_OTHER = "\ue000", "\ue001"
#: Names that do not tell what a container holds.
_VAGUE = ("wrap", "wrapper", "container", "inner", "outer", "row", "col", "page", "box", "block", "module", "region", "grid",
          "left", "right", "center", "has-share-button", "post-share", "with-sidebar", "no-comments", "menu-open", "td-ss-main")


def laid_out(article: list[str], other: list[str], rng: np.random.Generator) -> str:
    """A page with the given texts in another layout, each text behind the mark of its label."""
    def pick(*names):
        return names[rng.integers(len(names))]

    def words(n):
        return _IS_OTHER + (html_lib.escape(other[rng.integers(len(other))][:n]) if other else "More")

    def name(*usual):
        """An attribute: one of the usual names, a vague or random one, or none."""
        kind = rng.random()
        if kind < 0.45 and usual:
            value = pick(*usual)
        elif kind < 0.6:
            value = pick(*_VAGUE) + maybe(" " + pick(*_VAGUE))
        elif kind < 0.8:
            value = "".join(pick(*"abcdefghklmnoprstuvwxz") for _ in range(int(rng.integers(1, 5)))) + maybe(str(rng.integers(100)))
        else:
            return ""
        return f' {pick("class", "id")}="{value}"'

    def box(names, n=1, tag=None):
        t = tag or pick("div", "section", "aside", "ul")
        inner = "".join(f"<{pick('p', 'li', 'div', 'span')}>{pick('', '<a href=#>')}{words(160)}</a></p>" for _ in range(n))
        return f'<{t} {pick("class", "id")}="{pick(*names)}">{inner}</{t}>'

    def maybe(text, p=0.5):
        return text if rng.random() < p else ""

    ads = ("ad", "ads", "advert", "advertisement", "promo", "sponsored", "banner", "ad-box")
    notices = ("cookie-notice", "cookie", "consent", "notice", "notification", "alert", "popup", "gdpr", "modal")
    sides = ("sidebar", "related", "widget", "recommended", "newsletter", "subscribe", "share", "social", "links")
    talk = ("comments", "comment-list", "comment", "replies", "discussion", "respond", "reactions")
    body = []
    for k, text in enumerate(article):
        t = _IS_ARTICLE + html_lib.escape(text, quote=False)
        if k == 0 and rng.random() < 0.6:
            body.append(f"<{pick('h1', 'h2')}>{t}</{pick('h1', 'h2')}>")
        else:
            body.append(pick(f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t[:20]}</b>{t[20:]}</p>", f"<div>{t}</div>", f"<p{name()}>{t}</p>",
                             f"<blockquote>{t}</blockquote>", f"<ul><li>{t}</li></ul>"))
        body.append(maybe(box(ads), 0.08))
        body.append(maybe(box(sides), 0.04))
    inner = "".join(body) + maybe(box(talk, int(rng.integers(1, 4)), pick("div", "section")), 0.3)
    usual = ("content", "post", "entry-content", "story", "article-body", "main-content")
    main = pick("<article>{}</article>", "<main>{}</main>", f"<div{name(*usual)}>{{}}</div>", f"<div{name(*usual)}>{{}}</div>",
                f"<section{name('story', 'post')}>{{}}</section>", f"<article{name('post')}>{{}}</article>",
                f"<main{name()}><article{name('post')}>{{}}</article></main>", f"<div{name()}><div{name(*usual)}>{{}}</div></div>")
    menu = "".join(f"<li><a href=#>{words(20)}</a></li>" for _ in range(int(rng.integers(2, 9))))
    flat = "".join(f"<a href=#>{words(16)}</a> " for _ in range(int(rng.integers(2, 7))))
    before = [pick(f"<nav><ul>{menu}</ul></nav>", f"<div{name('menu', 'navbar', 'navigation')}><ul>{menu}</ul></div>",
                   f"<header><ul>{menu}</ul></header>", f"<div{name()}>{flat}</div>", f"<ul{name()}>{menu}</ul>"),
              maybe(f"<header><div>{words(40)}</div></header>"),
              maybe(box(ads)), maybe(box(notices, 1, "div")), maybe(box(("breadcrumb", "breadcrumbs", "topbar"))),
              maybe(f"<form><label>{words(30)}</label><button>{words(10)}</button></form>", 0.3), maybe(box(sides), 0.4)]
    foot = f"&copy; {pick('2019', '2023', '')} {words(60)}".replace("&copy;", _IS_OTHER + "&copy;")
    after = [maybe(box(talk, int(rng.integers(1, 5)), pick("div", "section", "ul"))), maybe(box(sides, 2)), maybe(box(ads)),
             maybe(f"<aside><p>{words(120)}</p></aside>"), maybe(f"<form><p>{words(60)}</p><button>{words(10)}</button></form>", 0.3),
             maybe(box(notices, 1, "div"), 0.3),
             pick(f"<footer>{foot}</footer>", f"<div{name('footer')}><p>{foot}</p></div>", f"<div{name('footer', 'bottom')}>{flat}</div>", "")]
    rng.shuffle(before)
    main = main.replace("{}", inner)
    if rng.random() < 0.15:  # the page as a table
        page = f"<table><tr><td>{''.join(before)}</td></tr><tr><td{name()}>{main}</td></tr><tr><td>{''.join(after)}</td></tr></table>"
    else:
        page = "".join(before) + main + "".join(after)
    page = pick(page, page, page, f"<div{name()}>{page}</div>", f"<form method=post>{page}</form>")
    return f"<html><body>{page}</body></html>"


def known_labels(page: str) -> tuple[list[tuple[tuple[str, ...], str, int]], np.ndarray]:
    """(blocks, labels) of a page whose texts stand behind their marks."""
    blocks, labels, now = [], [], 0.0
    for path, text, linked in blocks_of(page):
        marks = [c for c in text if c in (_IS_ARTICLE, _IS_OTHER)]
        now = float(marks[0] == _IS_ARTICLE) if marks else now
        text = text.replace(_IS_ARTICLE, "").replace(_IS_OTHER, "").strip()
        if text:
            blocks.append((path, text, linked))
            labels.append(now)
    return blocks, np.array(labels, np.float32)


def trained(pages: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> Labeller:
    """A labeller from sampled pages and new layouts of their texts."""
    rng = np.random.default_rng(seed)
    told = []
    for page in pages:
        blocks = blocks_of(page)
        labels = np.array([named_label(path) for path, _, _ in blocks], np.float32)
        if labels.any() and not labels.all():
            told.append((blocks, labels))
    other = [t for blocks, labels in told for (_, t, _), y in zip(blocks, labels) if not y]
    examples = list(told)
    for blocks, labels in told:
        article = [t for (_, t, _), y in zip(blocks, labels) if y]
        examples += [known_labels(laid_out(article, other, rng)) for _ in range(layouts)]
    out = Labeller(seed)
    if examples:
        out.fit([vectors(b) for b, _ in examples], [y for _, y in examples])
    return out


def sampled(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> list[str]:
    """At most ``sample`` different pages of bounded length, the ones with the smallest hashes."""
    text = F.col(html_col).cast("string")
    rows = pages.select(text.alias("_html")).where(F.length("_html").between(1, SAMPLE_CHARS)).select(
        F.xxhash64(F.substring("_html", 1, 512), F.length("_html")).alias("_order"), "_html")
    # Hashes alone first, so that no task sends pages that others displace.
    least = rows.select("_order").distinct().orderBy("_order").limit(sample).agg(F.max("_order")).first()[0]
    if least is None:
        return []
    chosen = rows.where(F.col("_order") <= least).groupBy("_order").agg(F.min("_html").alias("_html"))
    return [r["_html"] for r in chosen.orderBy("_order").collect()]


def main_text(pages: DataFrame, labeller: Labeller | None = None, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_article_blocks) of every page."""
    labeller = labeller or trained(sampled(pages, html_col))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("_html"))

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cut = [blocks_of(h or "") for h in part.column(2).to_pylist()]
                article = [p >= 0.5 for p in labeller.probabilities([vectors(b) for b in cut])]
                texts = [" ".join(t for (_, t, _), a in zip(b, keep) if a) for b, keep in zip(cut, article)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(b) for b in cut], pa.int64()), pa.array([int(k.sum()) for k in article], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_article_blocks"])

    return src.mapInArrow(read, "page_id long, url string, text string, n_chars long, n_blocks long, n_article_blocks long")
