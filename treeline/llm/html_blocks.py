"""Main-text extraction by a recurrent block labeller in numpy.

A page is a sequence of leaf blocks: the text between block-level tags. A block enters as
vectors of its tag path (names, classes, ids and roles of the open elements), of its hashed
words and of its shape. A bidirectional LSTM reads the whole sequence, so that each block is
classified in the light of all others; the text is the blocks that belong to the article.

The weights are fitted by one task on a bounded number of given pages and on pages built
from their texts, in which the article stands under many names, listed, made up or none at all,
with forms, comments and asides inside, and with or without menus and footers around it.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.fitting import bounded_sample, fitted, whole_within
from treeline.llm.tokens import named

#: Pages the fit reads at most, whole, and bytes of all of them at most, but for one page.
SAMPLE_PAGES, SAMPLE_BYTES = 240, 2 << 20
BUILT_PAGES = 1300
PATH, WORDS, SHAPE = 64, 24, 6
SIZE = 2 * PATH + WORDS + SHAPE
HIDDEN = 24
EPOCHS = 10

_BLOCK_TAGS = frozenset(
    "html body main article section div header footer nav aside address p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table caption thead tbody tfoot tr td th blockquote pre figure figcaption form fieldset legend details summary "
    "hr center hgroup dialog menu search".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What HTML itself reads as raw text up to the end tag; of these only xmp shows its text.
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_APART = frozenset("select xmp".split())  # blocks of their own that p may hold
_SPACED = frozenset("noscript svg template object option optgroup".split())
_CLOSES = {  # what an opening tag ends without being told
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"\w+")
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float  # share of its characters inside links


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    if not attributes.strip():
        return (tag,)
    words = [tag]
    for _, a, b, c in _NAMED.findall(attributes):
        words += [w for w in _SPLIT.split((a or b or c).lower()) if w]
    return tuple(words)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order; scripts, styles and the like have none. An element
    without an end tag ends with the block around it, a list of options at the next block."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    runs: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if runs:
            text = " ".join(html.unescape("".join(runs)).split())
            if text:
                path = tuple(w for _, names in stack for w in names)
                out.append(Block(path, text, min(1.0, linked / len(text))))
            runs.clear()
        linked = 0

    def pop_to(place: int) -> None:
        nonlocal links
        links -= sum(tag == "a" for tag, _ in stack[place:])
        del stack[place:]

    at, lower = 0, None
    while match := _TOKEN.match(page, at):
        at = match.end()
        token = match[0]
        name = match[2] or match[5]
        if name is None:
            if token[0] != "<" or token == "<":
                runs.append(token)
                linked += len(token) if links else 0
            elif token.startswith("<![CDATA["):
                runs.append(html.escape(token[9:].removesuffix("]]>")))
            continue
        tag, closing, attributes = name.lower(), match[1] or match[4], match[3] or match[6] or ""
        if closing:
            if tag in _BLOCK_TAGS or tag in _APART:
                flush()
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            # an inline tag never closes the block around it
            if place >= 0 and (tag in _BLOCK_TAGS or not any(t in _BLOCK_TAGS for t, _ in stack[place:])):
                pop_to(place)
        elif tag in _RAW:
            if tag in _APART:
                flush()
            start = end = at
            if not attributes.endswith("/"):
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at) if len(lower) == len(page) else -1
                if end < 0:
                    end = next((m.start() for m in re.compile(f"</{tag}", re.I).finditer(page, at)), len(page))
                close = page.find(">", end)
                at = len(page) if close < 0 else close + 1
            if tag in _APART:
                stack.append((tag, _names(tag, attributes)))
                runs.append(html.escape(page[start:end]))
                linked += end - start if links else 0
                flush()
                stack.pop()
            else:
                runs.append(" ")
        elif tag == "br" or tag == "wbr":
            runs.append(" " if tag == "br" else "")
        elif tag in _VOID:
            if tag == "hr":
                flush()
        else:
            if tag in _BLOCK_TAGS or tag in _APART:
                flush()
            if tag in _SPACED:
                runs.append(" ")
            if tag in _BLOCK_TAGS:
                open_list = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "select"), -1)
                if open_list >= 0 and not any(t in _BLOCK_TAGS for t, _ in stack[open_list:]):
                    pop_to(open_list)
                p = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), -1)
                if p >= 0 and not any(t in _BLOCK_TAGS for t, _ in stack[p + 1 :]):
                    pop_to(p)
            if tag in _CLOSES:
                ends, within = _CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in within:
                        break
                    if stack[i][0] in ends:
                        pop_to(i)
                        break
            if not attributes.endswith("/"):
                stack.append((tag, _names(tag, attributes)))
                links += tag == "a"
    flush()
    return out


_VECTORS: dict[tuple[str, int], np.ndarray] = {}


def _vector(word: str, size: int) -> np.ndarray:
    """A fixed vector of signs per hashed word."""
    known = _VECTORS.get((word, size))
    if known is None:
        if len(_VECTORS) > 50_000:
            _VECTORS.clear()
        bits = np.random.default_rng(zlib.crc32(word.encode()) + size).integers(0, 2, size)
        known = _VECTORS[word, size] = ((2 * bits - 1) / size**0.5).astype(np.float32)
    return known


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    known = _PATHS.get(path)
    if known is None:
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        known = np.zeros(2 * PATH, dtype=np.float32)
        known[:PATH] = sum((_vector(w, PATH) for w in set(path)), np.zeros(PATH, np.float32))
        known[PATH:] = sum((_vector(w, PATH) for w in path[-3:]), np.zeros(PATH, np.float32))
        _PATHS[path] = known
    return known


def features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), SIZE), dtype=np.float32)
    for i, b in enumerate(blocks):
        out[i, : 2 * PATH] = _path_vector(b.path)
        words = b.text.lower().split()
        # the hash of whole texts: each word adds to one place, with a sign
        hashes = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.int64)
        bag = np.bincount(hashes % WORDS, weights=1 - 2 * (hashes >> 16 & 1), minlength=WORDS)
        out[i, 2 * PATH : 2 * PATH + WORDS] = bag / len(words) ** 0.5
        out[i, 2 * PATH + WORDS :] = (
            np.log1p(len(b.text)) / 8, np.log1p(len(words)) / 6, b.linked, i / len(blocks),
            b.text[-1] in ".!?", 1 - sum(map(len, _WORD.findall(b.text))) / len(b.text),
        )
    return out


@dataclass
class Weights:
    """Two LSTMs (gates: in, forget, out, new), and what reads them and the block itself."""

    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    top: np.ndarray
    top_shift: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.float32))
    past: np.ndarray = field(default_factory=lambda: np.zeros(SIZE, dtype=np.float32))

    def all(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.b, self.top, self.top_shift, self.past]


def fresh(seed: int = 5) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda rows, columns: rng.normal(0, rows**-0.5, (rows, columns)).astype(np.float32)
    shift = lambda: np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    return Weights([draw(SIZE, 4 * HIDDEN) for _ in "fb"], [draw(HIDDEN, 4 * HIDDEN) for _ in "fb"],
                   [shift() for _ in "fb"], draw(2 * HIDDEN, 1)[:, 0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(x: np.ndarray, mask: np.ndarray, w, u, b, keep: bool):
    """One direction over (time, page, feature); padded steps leave the state alone."""
    steps, pages = mask.shape
    h = c = np.zeros((pages, HIDDEN), dtype=np.float32)
    z0, hs, kept = x @ w + b, np.zeros((steps, pages, HIDDEN), dtype=np.float32), []
    for t in range(steps):
        z = z0[t] + h @ u
        gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        m = mask[t][:, None]
        c1 = f * c + i * new
        squashed = np.tanh(c1)
        if keep:
            kept.append((h, c, i, f, o, new, squashed))
        c, h = np.where(m, c1, c), np.where(m, o * squashed, h)
        hs[t] = h
    return hs, kept


def _back(x, mask, w, u, kept, d_hs):
    d_w, d_u, d_b = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, dtype=np.float32)
    d_h = d_c = np.zeros(d_hs.shape[1:], dtype=np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, c, i, f, o, new, squashed = kept[t]
        m = mask[t][:, None]
        d_h = d_h + d_hs[t]
        d_c1 = (d_c + d_h * o * (1 - squashed**2)) * m
        d_z = np.concatenate([d_c1 * new * i * (1 - i), d_c1 * c * f * (1 - f), d_h * m * squashed * o * (1 - o),
                              d_c1 * i * (1 - new**2)], axis=1)
        d_w += x[t].T @ d_z
        d_u += h.T @ d_z
        d_b += d_z.sum(0)
        d_c = np.where(m, d_c1 * f, d_c)
        d_h = np.where(m, d_z @ u.T, d_h)
    return d_w, d_u, d_b


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), SIZE), dtype=np.float32), np.zeros((steps, len(pages)), dtype=bool)
    for p, rows in enumerate(pages):
        x[: len(rows), p], mask[: len(rows), p] = rows, True
    return x, mask


def probabilities(weights: Weights, pages: list[np.ndarray]) -> list[np.ndarray]:
    """For each page's features, the probability of each block to belong to the article."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    first = 0
    while first < len(order):
        # pages of similar length; at most some thousand blocks with the padding
        last = first + 1
        while last < len(order) and (last - first) * len(pages[order[last]]) < 8192:
            last += 1
        some = order[first:last]
        x, mask = _padded([pages[i] for i in some])
        f, _ = _pass(x, mask, weights.w[0], weights.u[0], weights.b[0], False)
        b, _ = _pass(x[::-1], mask[::-1], weights.w[1], weights.u[1], weights.b[1], False)
        p = _sigmoid(np.concatenate([f, b[::-1]], axis=2) @ weights.top + x @ weights.past + weights.top_shift)
        for k, i in enumerate(some):
            out[i] = p[: len(pages[i]), k]
        first = last
    return out


def fit(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> Weights:
    """Back-propagation through the whole sequences, Adam on the log loss of the blocks."""
    weights, rng = fresh(seed), np.random.default_rng(seed)
    usable = [i for i in range(len(pages)) if len(pages[i])]
    m, v, step = [np.zeros_like(a) for a in weights.all()], [np.zeros_like(a) for a in weights.all()], 0
    for epoch in range(epochs):
        order = rng.permutation(usable)
        for first in range(0, len(order), 32):
            some = order[first : first + 32]
            x, mask = _padded([pages[i] for i in some])
            y = np.zeros(mask.shape, dtype=np.float32)
            for k, i in enumerate(some):
                y[: len(labels[i]), k] = labels[i]
            hf, kf = _pass(x, mask, weights.w[0], weights.u[0], weights.b[0], True)
            hb, kb = _pass(x[::-1], mask[::-1], weights.w[1], weights.u[1], weights.b[1], True)
            h = np.concatenate([hf, hb[::-1]], axis=2)
            error = (_sigmoid(h @ weights.top + x @ weights.past + weights.top_shift) - y) * mask / mask.sum()
            d_h = error[:, :, None] * weights.top
            wf, uf, bf = _back(x, mask, weights.w[0], weights.u[0], kf, d_h[:, :, :HIDDEN])
            wb, ub, bb = _back(x[::-1], mask[::-1], weights.w[1], weights.u[1], kb, d_h[::-1, :, HIDDEN:])
            slopes = [wf, wb, uf, ub, bf, bb, np.einsum("tp,tph->h", error, h), np.array([error.sum()], np.float32),
                      np.einsum("tp,tpx->x", error, x)]
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in slopes))) / 2)
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for a, m1, v1, g in zip(weights.all(), m, v, slopes, strict=True):
                g = g / norm
                m1 += 0.1 * (g - m1)
                v1 += 0.001 * (g * g - v1)
                a -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)
    return weights


# Names that pages give to the article and to what is around it.
_ARTICLE = ("article", "main", "div.post-content", "div.entry-content", "div.article-body", "div#content", "section.story",
            "div.content main-text", "main#main-content", "div.blog-post", "article.post hentry", "div.td-post-content")
_AROUND = {
    "menu": ("nav", "div.menu", "ul.navigation", "div#navbar", "nav.main-nav", "div.breadcrumbs", "ul.nav-links"),
    "header": ("header", "div#header", "div.site-header", "div.masthead", "div.topbar"),
    "footer": ("footer", "div#footer", "div.site-footer", "footer.page-footer", "div.bottom copyright"),
    "side": ("aside", "div.sidebar", "div#sidebar", "aside.widget", "div.related-posts", "section.recommended", "div.author-box"),
    "notice": ("div.cookie-banner", "div#cookie-notice", "div.consent", "div.gdpr notice", "div.alert notice", "div.popup newsletter",
               "div.paywall-notice", "section.subscribe"),
    "advert": ("div.ad", "div.advert", "div.ads sponsored", "ins.adsbygoogle", "div.promo banner", "aside.advertisement", "div#ad-slot"),
    "form": ("form", "form.search", "div.login-form", "form#contact", "form.signup"),
    "comments": ("div#comments", "section.comments", "div.comment-list", "ol.commentlist", "div#disqus_thread", "section.reader-comments",
                 "div.responses", "div.discussion replies"),
    "share": ("div.share-buttons", "div.social-links", "ul.share", "div.tags", "div.byline meta"),
}
_PHRASES = ("We use cookies to improve this site.", "Accept all", "Subscribe to our newsletter", "Your e-mail", "Search", "Sign in",
            "Share", "Advertisement", "Related articles", "Leave a reply", "All rights reserved", "Privacy policy", "Contact", "Home",
            "Read more", "Terms of use", "3 comments", "Reply", "Tags", "Previous", "Next", "Follow us")


#: Stands in front of the article's blocks in built pages, until they are labelled.
_MARK = "\ue000"


def _opened(name: str) -> tuple[str, str]:
    tag, _, rest = name.replace("#", " #").replace(".", " .").partition(" ")
    id_ = rest[1:] if rest.startswith("#") else ""
    class_ = rest[1:] if rest.startswith(".") else ""
    return f"<{tag}" + (f' id="{id_}"' if id_ else "") + (f' class="{class_}"' if class_ else "") + ">", f"</{tag}>"


def built_page(rng: np.random.Generator, texts: list[str]) -> tuple[str, list[str]]:
    """A page made of given texts, and the blocks of its article in order; in the page a
    mark stands in front of each of these."""
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    some = lambda most: int(rng.integers(1, most + 1))
    text = lambda: " ".join(pick(texts).split())

    def short() -> str:
        words = text().split()
        return " ".join(words[: some(5)])

    def sentence() -> str:
        words = text().split()
        first = int(rng.integers(0, max(1, len(words) - 12)))
        return " ".join(words[first : first + 4 + some(20)])

    def made_up() -> str:
        letters = lambda: "".join(pick("abcdefghijklmnoprstuvwz") for _ in range(2 + some(7)))
        return letters() if rng.random() < 0.6 else f"{letters()}-{letters()}"

    def comment() -> str:
        tag = pick(("div", "li", "article", "section", "p"))
        who, said = html.escape(short()), html.escape(sentence() if rng.random() < 0.7 else text())
        inner = pick((f'<p class="author">{who}</p><p>{said}</p>', f"<p>{said}</p>", f"<h4>{who}</h4><div>{said}</div>", f"<b>{who}</b>: {said}"))
        return f"<{tag}{pick(('', ' class=comment', ' class=reply'))}>{inner}</{tag}>"

    def around(kind: str) -> str:
        name = pick(_AROUND[kind])
        if rng.random() < 0.25 and "." in name:
            name += f" {made_up()}"
        start, end = _opened(name)
        if kind in ("menu", "share"):
            links = "".join(f'<li><a href="/{i}">{html.escape(pick(_PHRASES) if rng.random() < 0.2 else short())}</a></li>'
                            for i in range(some(8)))
            return f"{start}<ul>{links}</ul>{end}" if rng.random() < 0.8 else start + re.sub("</?li>", " ", links) + end
        if kind == "form":
            said = html.escape(pick(_PHRASES) if rng.random() < 0.4 else sentence())
            inner = pick((f"<label>{said}</label>", f"<p>{said}</p>", f"<h3>{pick(_PHRASES)}</h3><p>{said}</p>", f"<div>{said}</div>",
                          f"<fieldset><legend>{pick(_PHRASES)}</legend>{said}</fieldset>", f"<ul><li>{said}</li></ul>"))
            return f'{start}{inner}<input name="q"><button>{pick(_PHRASES)}</button>{end}'
        if kind == "comments":
            return f"{start}{pick(('', f'<h3>{pick(_PHRASES)}</h3>', f'<h2>{some(40)} comments</h2>'))}{''.join(comment() for _ in range(some(4)))}{end}"
        words = html.escape(text() if rng.random() < 0.4 else sentence() if rng.random() < 0.6 else short())
        inner = pick((f"{words}", f"<p>{words}</p>", f"<p>{words}</p><p><a href='/x'>{pick(_PHRASES)}</a></p>", f"<h2>{html.escape(short())}</h2><p>{words}</p>",
                      f"<h3>{pick(_PHRASES)}</h3><ul><li><a href='/y'>{words}</a></li></ul>"))
        return f"{start}{'&copy; ' if kind == 'footer' and rng.random() < 0.5 else ''}{inner}{end}"

    body, article = [], []
    if rng.random() < 0.35:
        body.append(around("header"))
    if rng.random() < 0.75:
        body.append(around("menu"))
    for kind in ("notice", "advert", "form", "side"):
        if rng.random() < 0.3:
            body.append(around(kind))
    kind = rng.random()
    if kind < 0.35:
        start, end = _opened(pick(_ARTICLE))
    elif kind < 0.78:  # a name that says nothing
        start, end = _opened(pick(("div", "div", "div", "section", "main", "article", "td")) + pick((".", ".", "#")) + made_up())
        if start.startswith("<td"):
            start, end = f"<table><tr>{start}", f"{end}</tr></table>"
    elif kind < 0.9:
        start, end = _opened(pick(("article", "main", "div", "section")))
    else:
        start = end = ""
    parts = [start]
    count = some(120 if rng.random() < 0.04 else 10) + 1
    titled = rng.random() < 0.85
    for i in range(count):
        # long and short, plain and odd texts stand in articles as well as around them
        words = short() if (i == 0 and titled) or rng.random() < 0.12 else sentence() if rng.random() < 0.25 else text()
        article.append(words)
        tag = pick(("h1", "h1", "h1", "h2")) if i == 0 and titled else pick(("p",) * 9 + ("li", "blockquote", "h2", "pre", "td", "dd", "figcaption"))
        inner = html.escape(_MARK + words)
        if rng.random() < 0.15:
            inner = f"<b>{inner}</b>"
        if tag in ("li", "td", "dd", "figcaption"):
            before, after = {"li": ("<ul>", "</ul>"), "td": ("<table><tr>", "</tr></table>"), "dd": ("<dl>", "</dl>"), "figcaption": ("<figure>", "</figure>")}[tag]
            parts.append(f"{before}<{tag}>{inner}</{tag}>{after}")
        else:
            parts.append(f"<{tag}>{inner}" + ("" if tag == "p" and rng.random() < 0.1 else f"</{tag}>"))
        if i % 5 == 2 and rng.random() < 0.5:  # a list of options
            parts.append("<select>" + "".join(f"<option>{html.escape(w)}</option>" for w in words.split()[:4]) + "</select>")
        if rng.random() < 0.12:
            parts.append(around(pick(("advert", "share", "notice", "side", "form", "form", "menu"))))
    if rng.random() < 0.25:
        parts.append(around(pick(("comments", "comments", "form", "side", "share", "footer"))))
    parts.append(end)
    whole = "".join(parts)
    if rng.random() < 0.3:
        outer = pick(("<div id='page'>", "<div class='wrapper'>", "<div class='container row'>", "<section>", f"<div class='{made_up()}'>"))
        whole = f"{outer}{whole}" + ("</section>" if outer == "<section>" else "</div>")
    body.append(whole)
    for kind, share in (("share", 0.25), ("comments", 0.45), ("side", 0.35), ("advert", 0.25), ("form", 0.25), ("notice", 0.2), ("footer", 0.75)):
        if rng.random() < share:
            body.append(around(kind))
    return f"<!DOCTYPE html><html><head><title>{html.escape(short())}</title></head><body>{''.join(body)}</body></html>", article


def _labelled(blocks: list[Block], article: list[str]) -> np.ndarray:
    """1 for the blocks of a built page that are the article's; their marks go."""
    out = np.array([b.text.startswith(_MARK) for b in blocks], dtype=np.float32)
    for b in blocks:
        b.text = b.text.replace(_MARK, "").strip() or "."
    return out


def landmarks(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its article itself; None if it does not."""
    outside = {"nav", "aside", "footer", "header", "form", "select", "ad"}
    found = np.array([bool({"article"} & set(b.path)) and not outside & set(b.path) for b in blocks], dtype=np.float32)
    return found if found.any() else None


def learn(pages: DataFrame, key: str = "page_id", html_column: str = "html", sample: int = SAMPLE_PAGES,
          most: int = SAMPLE_BYTES, built: int = BUILT_PAGES, epochs: int = EPOCHS) -> Weights:
    """Weights fitted on at most ``sample`` given pages, chosen by a hash of the key, that
    mark their article, and on ``built`` pages from their texts. Pages are read whole, as far
    as they have ``most`` bytes in all."""
    rows = pages.select(named(key).alias("k"), named(html_column).alias("h")).filter(F.length("h") > 0)
    found = whole_within(bounded_sample(rows, sample, "k", "h"), most, F.octet_length("h"), "k", "h")
    return fitted(found.select("h"), lambda some: _fit_on([h for (h,) in some], built, epochs))


def _fit_on(pages: list[str], built: int, epochs: int) -> Weights:
    rng = np.random.default_rng(11)
    x, y, texts = [], [], []
    for page in pages:
        blocks = blocks_of(page)
        labels = landmarks(blocks)
        texts += [b.text for b in blocks]
        if labels is not None:
            x.append(features(blocks))
            y.append(labels)
    texts = texts or list(_PHRASES)
    for _ in range(built):
        page, article = built_page(rng, texts)
        blocks = blocks_of(page)
        labels = _labelled(blocks, article)
        if labels.sum() == len(article):
            x.append(features(blocks))
            y.append(labels)
    return fit(x, y, epochs)


def main_text(pages: DataFrame, weights: Weights, key: str = "page_id", html_column: str = "html",
              also: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns ``also``, and text: the main text of each whole page.

    One row per input row, in one pass without a shuffle. Null pages count as empty and have
    an empty text, like pages without a block of an article. Other columns are not read. An
    empty table gives an empty result.
    """
    sent = pages.sparkSession.sparkContext.broadcast(weights)
    held = pages.select(key, *also, F.col(f"`{html_column}`").alias("_page_html"))
    schema = T.StructType([*held.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [blocks_of(p or "") for p in part.column(part.num_columns - 1).to_pylist()]
                chosen = probabilities(w, [features(b) for b in found])
                texts = ["\n".join(b.text for b, p in zip(bs, ps, strict=True) if p >= 0.5)
                         for bs, ps in zip(found, chosen, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string())], names=schema.fieldNames())

    return held.mapInArrow(run, schema)
