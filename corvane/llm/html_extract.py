"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks (runs of text between block-level tags). Each block is a vector: its tag path (tags, and the
parts of their class, id and role values, hashed), its words (hashed) and a few measures. A bidirectional LSTM in numpy reads the
page's whole sequence of blocks in both directions, so every block is labelled with the rest of the document in view. Blocks
labelled as main text are joined in page order.

The labeller is trained here, on pages that a seeded generator builds with known labels: articles among menus, headers, footers,
side bars, notices, adverts, forms and reader comments, with telling, misleading or no class names, in many layouts. Training
takes seconds, happens once in a driver, and the weights (a fixed, small size) are broadcast.

Text of scripts, styles, templates and other tags that show none, and the document's title, is no block at all; where such a tag
is never closed, the text after it is read. Formulas, drawings and what stands in for media are text like any other. Character
references are decoded, white space inside a block (line breaks included) becomes one space.

Defined results: null and empty html give the empty text; html without tags is one block; unclosed tags and truncated pages are
read as far as they go; repeated rows are extracted alike; very long pages are read whole, with memory in proportion; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvane.llm._common import table

#: Cells for hashed path parts and hashed words; measures; hidden units of each direction; generated pages; seed.
PATHS, WORDS, MEASURES, HIDDEN, PAGES, SEED = 1024, 48, 8, 12, 1500, 7
#: Tags whose content is no text whatever it holds; where one is never closed, reading goes on after it.
SILENT = {"script", "style", "noscript", "template", "title", "textarea", "iframe"}
ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE | re.ASCII) for name in SILENT}
#: Where text begins again after a script or style that is never closed.
RESUMES = re.compile(r"<(?:/head|body|main|article|section|header|nav|div|p|h[1-6]|ul|ol|table|blockquote)(?=[\s/>])", re.IGNORECASE | re.ASCII)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "svg", "math", "object", "canvas", "audio", "video", "text", "tspan", "g", "path", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msup", "msub", "msubsup", "msqrt", "mroot", "mstyle", "mover", "munder", "munderover", "semantics"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
OPENS = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOPS = re.compile("[>\"']")
#: A comment ends at once with the first, or where the second is found.
COMMENT_ENDS, COMMENT_END = re.compile("-?>"), re.compile("--!?>")
CUT = re.compile(r"/[a-zA-Z]|[a-zA-Z][^\s<>]*\s+[^<>=]*=")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")


class Blocks:
    """The leaf blocks of a page: text, path and the share of characters inside links."""

    def __init__(self, page: str) -> None:
        self.texts: list[str] = []
        #: the place in `sets` of the cells of each block's path, and the path's length
        self.paths: list[int] = []
        self.depths: list[int] = []
        self.sets: list[frozenset[int]] = [frozenset()]
        self.linked: list[float] = []
        self._read(page)

    def _tags(self, page: str, marks: dict[str, int]) -> Callable[[int], int]:
        """A function from the place after a tag's name to the place of its closing bracket, -1 if it has none.

        Brackets inside quotes close nothing, unless a quote of the page once never ended; every place is passed a bounded number of times.
        """

        def end(at: int) -> int:
            start = at
            while not marks["broken"]:
                m = STOPS.search(page, at)
                if m is None:
                    break
                if m[0] == ">":
                    return m.start()
                if m.start() >= marks[m[0]]:
                    break  # the last quote of its kind
                at = page.index(m[0], m.end()) + 1
            marks["broken"] = 1
            return page.find(">", start)

        return end

    def _read(self, page: str) -> None:
        marks = {"broken": 0, '"': page.rfind('"'), "'": page.rfind("'")}
        tag_end, last_end = self._tags(page, marks), page.rfind(">")
        # open tags: name and the place of the path's cells, which grow with the stack, so that a block stores a number and no path
        stack: list[tuple[str, int]] = []
        opened: Counter[str] = Counter()
        places: dict[frozenset[int], int] = {self.sets[0]: 0}
        below: dict[tuple[int, str], int] = {}
        parts: list[str] = []
        path = depth = 0
        links = chars = in_link = 0
        at, n = 0, len(page)
        open_ended: set[str] = set()

        def flush() -> None:
            nonlocal links, chars
            if parts:
                text = "".join(parts)
                if "&" in text:
                    text = entities.unescape(text)
                if text := " ".join(text.split()):
                    self.texts.append(text)
                    self.paths.append(path)
                    self.depths.append(depth)
                    self.linked.append(links / max(1, chars))
                parts.clear()
            links = chars = 0

        def drop(k: int) -> None:
            nonlocal in_link
            gone = Counter(x[0] for x in stack[k:])
            opened.subtract(gone)
            in_link -= gone["a"]
            del stack[k:]

        while at < n:
            lt = page.find("<", at)
            lt = n if lt < 0 else lt
            said, m = page[at:lt], None
            at = lt
            if lt < n:
                if page.startswith("<!--", lt):
                    ends = COMMENT_ENDS.match(page, lt + 4) or COMMENT_END.search(page, lt + 4)
                    at = ends.end() if ends else n
                elif (m := OPENS.match(page, lt + 1) if lt < last_end else None) and (close := tag_end(m.end())) >= 0:
                    rest, at = page[m.end() : close], close + 1
                elif lt < last_end and page.startswith(("<!", "<?"), lt):
                    at, m = page.index(">", lt) + 1, None
                elif lt > last_end and CUT.match(page, lt + 1):  # a tag that the page's end cuts
                    at, m = page.find("<", lt + 1), None
                    at = n if at < 0 else at
                else:
                    said, at, m = said + "<", lt + 1, None
            if said:
                if not chars and not said.isspace():
                    path, depth = stack[-1][1] if stack else 0, len(stack)
                parts.append(said)
                size = len(said) if not said.isspace() else 0
                chars += size
                links += size if in_link else 0
            if m is None:
                continue
            name = m[2].lower()
            if m[1]:
                if name not in INLINE:
                    flush()
                for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                    if stack[k][0] == name:
                        drop(k)
                        break
                continue
            if name not in INLINE:
                flush()
            elif name == "br":
                parts.append(" ")
            if name in SILENT:  # to its end, whatever it holds
                if not rest.endswith("/"):
                    end = None if name in open_ended else ENDS[name].search(page, at)
                    if end:
                        close = page.find(">", end.end())
                        at = n if close < 0 else close + 1
                    else:
                        open_ended.add(name)
                        if name in ("script", "style"):
                            text = RESUMES.search(page, at)
                            at = text.start() if text else n
                continue
            shut = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            if shut:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in shut:
                        drop(k)
                        break
                    if stack[k][0] not in INLINE and stack[k][0] not in ("p", "td", "th", "li", "dt", "dd"):
                        break
            if name in VOID or rest.endswith("/") and name not in ("a", "p", "div"):
                continue
            key = (stack[-1][1] if stack else 0, name + " " + rest if "=" in rest else name)
            if key not in below:
                cells = self.sets[key[0]].union(path_cells(key[1]))
                if cells not in places:
                    places[cells] = len(self.sets)
                    self.sets.append(cells)
                below[key] = places[cells]
            stack.append((name, below[key]))
            opened[name] += 1
            in_link += name == "a"
        flush()


@lru_cache(maxsize=65536)
def path_cells(node: str) -> tuple[int, ...]:
    """Cells of one tag of a path and of the parts of its names."""
    name, _, rest = node.partition(" ")
    told = ["<" + name]
    for m in NAMES.finditer(rest):
        told += [p.lower() for p in PART.findall(m[1])]
    codes = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in told]
    return tuple(c % PATHS for c in codes) + tuple((c >> 16) % PATHS for c in codes)  # two cells each, so that two parts seldom look alike


@lru_cache(maxsize=65536)
def word_cell(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS


def vectors(page: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct paths, PATHS), the place of each block's path among them, and (blocks, WORDS + MEASURES)."""
    n = len(page.texts)
    place: dict[int, int] = {}
    at = np.array([place.setdefault(p, len(place)) for p in page.paths])
    paths = np.zeros((len(place), PATHS))
    for path, i in place.items():
        paths[i, list(page.sets[path])] = 1.0
    words = [t.split() for t in page.texts]
    size = np.array([len(w) for w in words])
    cells = np.fromiter((word_cell(w) for ws in words for w in ws), np.int64, int(size.sum()))
    of = np.repeat(np.arange(n), size)
    x = np.zeros((n, WORDS + MEASURES))
    x[:, :WORDS] = np.bincount(of * WORDS + cells, minlength=n * WORDS).reshape(n, WORDS) / size[:, None]
    m = x[:, WORDS:]
    m[:, 0] = np.log1p(size) / 5
    m[:, 1] = page.linked
    m[:, 2] = [t[-1] in ".!?:;…\"»”" for t in page.texts]
    m[:, 3] = [min(1.0, sum(map(t.count, ".,;")) / 8) for t in page.texts]
    m[:, 4] = size > 25
    m[:, 5] = np.arange(n) / max(1, n - 1)
    m[:, 6] = [min(1.0, d / 10) for d in page.depths]
    m[:, 7] = size <= 3
    return paths, at, x


def dense(v: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    return np.concatenate([v[0][v[1]], v[2]], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Labeller:
    """Two LSTMs, one each way, and a logistic output over both states and the block itself."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        d, h = PATHS + WORDS + MEASURES, HIDDEN
        self.p = {}
        for way in "fb":
            self.p["W" + way] = rng.normal(0, 0.15, (d, 4 * h))
            self.p["U" + way] = rng.normal(0, 1 / math.sqrt(h), (h, 4 * h))
            self.p["c" + way] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["V"] = rng.normal(0, 0.3, 2 * h)
        self.p["X"] = np.zeros(d)
        self.p["v"] = np.zeros(1)

    def _way(self, way: str, pre: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, pages, hidden) of one direction over pre-activations; beyond a page's end the state stays."""
        steps, pages, _ = pre.shape
        h = HIDDEN
        s, c = np.zeros((pages, h)), np.zeros((pages, h))
        out = np.zeros((steps, pages, h))
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = pre[t] + s @ self.p["U" + way]
            g = _sigmoid(z[:, : 3 * h])
            i, f, o, a = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :], np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            c2 = f * c + i * a
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((t, s, c, i, f, o, a, tc, m))
            s, c = np.where(m, o * tc, s), np.where(m, c2, c)
            out[t] = s
        return out

    def probabilities(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Of each block of each page. Paths are multiplied by the weights once each, not once a block."""
        p, h = self.p, HIDDEN
        size = np.cumsum([0, *(len(v[0]) for v in pages)])
        paths, rest = np.concatenate([v[0] for v in pages]), np.concatenate([v[2] for v in pages])
        at = np.concatenate([v[1] + size[k] for k, v in enumerate(pages)])
        one = lambda w: (paths @ w[:PATHS])[at] + rest @ w[PATHS:]
        pre = np.concatenate([one(p["Wf"]) + p["cf"], one(p["Wb"]) + p["cb"], one(p["X"][:, None])], axis=1)
        ends = np.cumsum([0, *(len(v[1]) for v in pages)])
        x, mask = padded([pre[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        f, b = self._way("f", x[:, :, : 4 * h], mask), self._way("b", x[:, :, 4 * h : 8 * h], mask)
        q = _sigmoid(f @ p["V"][:h] + b @ p["V"][h:] + x[:, :, 8 * h] + p["v"][0])
        return [q[: len(v[1]), k] for k, v in enumerate(pages)]

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over a batch (steps, pages)."""
        p, h = self.p, HIDDEN
        kept: dict[str, list] = {"f": [], "b": []}
        out = {w: self._way(w, x @ p["W" + w] + p["c" + w], mask, kept[w]) for w in "fb"}
        z = out["f"] @ p["V"][:h] + out["b"] @ p["V"][h:] + x @ p["X"] + p["v"][0]
        q = _sigmoid(z)
        n = mask.sum()
        loss = -(np.log(np.where(y > 0, q, 1 - q) + 1e-9) * mask).sum() / n
        dz = (q - y) * mask / n
        g = {"X": np.einsum("tp,tpd->d", dz, x), "v": np.array([dz.sum()]), "V": np.concatenate([np.einsum("tp,tph->h", dz, out[w]) for w in "fb"])}
        for k, w in enumerate("fb"):
            ds_out = dz[:, :, None] * p["V"][k * h : (k + 1) * h]
            gU, dpre = np.zeros_like(p["U" + w]), np.zeros((*mask.shape, 4 * h))
            ds, dc = np.zeros((mask.shape[1], h)), np.zeros((mask.shape[1], h))
            for t, s0, c0, i, f, o, a, tc, m in reversed(kept[w]):
                ds = ds + ds_out[t]
                do = ds * tc
                dc2 = dc + ds * o * (1 - tc * tc)
                d = np.concatenate([dc2 * a * i * (1 - i), dc2 * c0 * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - a * a)], axis=1) * m
                dpre[t] = d
                gU += s0.T @ d
                ds, dc = np.where(m, d @ p["U" + w].T, ds), np.where(m, dc2 * f, dc)
            g["U" + w], g["c" + w] = gU, dpre.sum(axis=(0, 1))
            g["W" + w] = np.tensordot(x, dpre, axes=([0, 1], [0, 1]))
        return loss, g


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    x, mask = np.zeros((steps, len(xs), xs[0].shape[1])), np.zeros((steps, len(xs)), bool)
    for k, one in enumerate(xs):
        x[: len(one), k] = one
        mask[: len(one), k] = True
    return x, mask


# ---- generated training pages -------------------------------------------------------------------------------------------
MAIN_NAMES = ["content", "post body", "entry-content", "article text", "story", "main", "page", "wrap", "col8", "x1", ""]
SIDE = {
    "nav": (["nav", "div", "ul", "div"], ["menu", "navbar", "main-menu", "breadcrumbs", "topnav", "nav links", "pagination", ""]),
    "header": (["header", "div"], ["header", "masthead", "site-header", "banner top", "logo"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "bottom", "copyright legal"]),
    "aside": (["aside", "div"], ["sidebar", "related", "widget", "recommended", "trending", "side right"]),
    "notice": (["div", "section", "p"], ["cookie-notice", "consent", "notice", "alert", "newsletter", "popup modal", "disclaimer", "gdpr", "warning message"]),
    "ad": (["div", "section", "aside"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"]),
    "form": (["form"], ["search", "login", "subscribe", "contact", ""]),
    "comments": (["section", "div", "ol"], ["comments", "comment-list", "reader comments", "discussion", "responses replies", "disqus"]),
    "share": (["div", "ul"], ["share", "social", "tags", "author-bio", "meta byline"]),
}
SAID = {
    "nav": ["home", "about", "news", "contact", "archive", "next", "previous", "login"],
    "footer": ["&copy; 2023 all rights reserved", "&middot; privacy policy", "terms of use", "imprint"],
    "notice": ["we use cookies", "accept all", "subscribe to our newsletter", "please enable javascript", "sign up now"],
    "ad": ["advertisement", "sponsored", "buy now", "shop the sale", "limited offer"],
    "form": ["your name", "e-mail", "send", "search", "password", "submit"],
    "comments": ["reply", "says:", "posted by", "2 hours ago", "report"],
    "share": ["share this", "tweet", "tags:", "by staff"],
}


class Generator:
    """Pages with known labels: html and the label (1 main) of each block's text."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        syllables = [a + b for a in ("", *"bcdfghlmnprstvwz") for b in ("a", "e", "i", "o", "u", "er", "en", "in", "on", "an", "re", "ti")]
        self.vocabulary = ["".join(self.rng.choice(syllables, self.rng.integers(1, 4))) for _ in range(1500)]
        self.html: list[str] = []
        self.marks: list[tuple[str, int]] = []

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def sentence(self, low: int, high: int) -> str:
        ws = [self.pick(self.vocabulary) for _ in range(int(self.rng.integers(low, high)))]
        return " ".join(ws).capitalize() + self.pick([".", ".", ".", "", "?", "!"])

    def prose(self) -> str:
        return " ".join(self.sentence(1, 18) for _ in range(int(self.rng.integers(1, 7))))

    def tag(self, tag: str, names: str, inner) -> None:
        key = self.pick(["class", "class", "id"])
        self.html.append(f'<{tag} {key}="{names}">' if names else f"<{tag}>")
        inner()
        self.html.append(f"</{tag}>")

    def block(self, tag: str, text: str, label: int, link: float = 0.0, close: bool = True) -> None:
        shown = f'<a href="/x">{text}</a>' if self.chance(link) else text
        if label and self.chance(0.12):
            shown = f"<b>{shown}" + ("" if self.chance(0.7) else "</b>") + ("<br>" if self.chance(0.5) else "")
        self.html.append(f"<{tag}>{shown}" + (f"</{tag}>" if close else ""))
        self.marks.append((" ".join(entities.unescape(text).split()), label))

    def side(self, kind: str, named: float = 0.85) -> None:
        tags, names = SIDE[kind]
        tag = self.pick(tags)
        told = self.pick(names) if tag == "div" or self.chance(named) else ""
        if tag in ("div", "section", "p", "ol", "ul") and not told:
            told = names[0]

        def inner() -> None:
            wide = kind in ("nav", "share") or kind in ("aside", "footer", "header") and self.chance(0.5)
            if wide:
                item = "li" if tag in ("ul", "ol") or self.chance(0.8) else self.pick(["span", "div", "p"])
                item = "div" if item == "span" else item
                if item == "li" and tag not in ("ul", "ol"):
                    self.html.append("<ul>")
                for _ in range(int(self.rng.integers(1, 9))):
                    self.block(item, self.pick(SAID[kind]) if kind in SAID and self.chance(0.3) else self.sentence(1, 4), 0, 0.95 if kind in ("nav", "aside") else 0.4)
                if item == "li" and tag not in ("ul", "ol"):
                    self.html.append("</ul>")
                return
            if tag in ("p",) or kind in ("ad", "footer", "notice") and self.chance(0.4):
                text = self.sentence(3, 25) if self.chance(0.6) else self.pick(SAID.get(kind, ["more"])) + " " + self.sentence(2, 12)
                self.html.append(text)
                self.marks.append((" ".join(entities.unescape(text).split()), 0))
                return
            for _ in range(int(self.rng.integers(1, 5))):
                if kind == "comments":
                    self.tag("li" if tag == "ol" else "div", self.pick(["comment", "reply", "comment-body", ""]), lambda: (self.block("h4", self.pick(SAID[kind]), 0), self.block("p", self.prose(), 0)))
                elif kind == "form":
                    self.block(self.pick(["div", "p", "button", "legend"]), self.pick(SAID[kind]) if self.chance(0.6) else self.sentence(1, 5), 0)
                else:
                    self.block(self.pick(["p", "div", "h3", "h4"]), self.pick(SAID[kind]) if kind in SAID and self.chance(0.4) else self.sentence(1, 20), 0, 0.4)

        self.tag(tag, told, inner)

    def article(self) -> None:
        def inner() -> None:
            if self.chance(0.25):
                self.tag("header", self.pick(["", "entry-header"]), lambda: self.block("h1", self.sentence(2, 14), 1))
            elif self.chance(0.9):
                self.block(self.pick(["h1", "h1", "h1", "h2"]), self.sentence(2, 16), 1)
            for _ in range(int(self.rng.integers(0, 14))):
                r = self.rng.random()
                if r < 0.72:
                    self.block("p", self.prose() if self.chance(0.8) else self.sentence(1, 4), 1, 0.03, self.chance(0.85))
                elif r < 0.8:
                    self.block(self.pick(["h2", "h3", "h4"]), self.sentence(1, 8), 1)
                elif r < 0.85:
                    self.block(self.pick(["blockquote", "pre", "div"]), self.prose(), 1)
                elif r < 0.9:
                    self.html.append("<ul>")
                    for _ in range(int(self.rng.integers(1, 5))):
                        self.block("li", self.sentence(1, 12), 1, 0.1)
                    self.html.append("</ul>")
                elif r < 0.93:
                    self.html.append("<table>")
                    for _ in range(int(self.rng.integers(1, 3))):
                        self.html.append("<tr>")
                        for _ in range(2):
                            self.block("td", self.sentence(1, 5), 1)
                        self.html.append("</tr>")
                    self.html.append("</table>")
                else:
                    self.side(self.pick(["ad", "ad", "form", "aside", "notice", "share"]), 1.0)
            if self.chance(0.12):
                self.side("comments", 1.0)

        tag = self.pick(["article", "article", "article", "main", "div", "section"])
        names = self.pick(MAIN_NAMES)
        self.tag(tag, names or ("content" if tag in ("div", "section") else ""), inner)

    def fragment(self) -> tuple[str, list[tuple[str, int]]]:
        """Text without a page around it: bare, or in paragraphs."""
        self.html, self.marks = [], []
        for _ in range(int(self.rng.integers(1, 5))):
            text = self.sentence(1, 6) if self.chance(0.4) else self.prose()
            if self.chance(0.5):
                self.block("p", text, 1, close=self.chance(0.6))
            else:
                self.html.append(text + self.pick(["<hr>", "<div></div>"]))
                self.marks.append((" ".join(entities.unescape(text).split()), 1))
        return "".join(self.html), self.marks

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        if self.chance(0.08):
            return self.fragment()
        self.html, self.marks = ["<!DOCTYPE html><html><head><title>" + self.sentence(2, 8) + "</title><style>p{}</style></head><body>"], []
        before, after = ["header", "nav", "ad", "notice", "form", "aside"], ["aside", "comments", "ad", "share", "nav", "notice", "form"]
        for k in before:
            if self.chance(0.75 if k == "nav" else 0.35):
                self.side(k)
        wrapped = self.chance(0.3)
        if wrapped:
            self.html.append(f'<div class="{self.pick(["wrap", "container", "page", "row", "layout"])}">')
        if self.chance(0.96):
            self.article()
        for k in after:
            if self.chance(0.3):
                self.side(k)
        if wrapped:
            self.html.append("</div>")
        if self.chance(0.85):
            self.side("footer")
        self.html.append("</body></html>" if self.chance(0.9) else "")
        return "".join(self.html), self.marks


def examples(pages: int, seed: int) -> list[tuple[tuple, np.ndarray]]:
    """Vectors and labels of the blocks of generated pages."""
    make, out = Generator(seed), []
    for _ in range(pages):
        page, marks = make.page()
        blocks = Blocks(page)
        if [" ".join(m[0].split()) for m in marks] == blocks.texts and marks:
            out.append((vectors(blocks), np.array([m[1] for m in marks], float)))
    return out


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = SEED, epochs: int = 10) -> Labeller:
    """A labeller fitted with Adam on generated pages; the same one for the same arguments."""
    model, data = Labeller(seed), examples(pages, seed)
    rng = np.random.default_rng(seed)
    m1, m2, n = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][1]) + rng.normal(0, 4))
        batches = [order[i : i + 24] for i in range(0, len(order), 24)]
        for k in rng.permutation(len(batches)):
            own = [data[i] for i in batches[k]]
            x, mask = padded([dense(d[0]) for d in own])
            y = np.zeros(mask.shape)
            for j, d in enumerate(own):
                y[: len(d[1]), j] = d[1]
            drop = rng.random((1, x.shape[1], PATHS)) > 0.1  # not to lean on single names
            x[:, :, :PATHS] *= drop
            _, g = model.step(x, mask, y)
            n += 1
            rate = 0.01 * (0.5 if epoch >= epochs - 3 else 1.0) * min(1.0, n / 20)
            for key, d in g.items():
                d = np.clip(d, -1, 1) + 1e-5 * model.p[key]
                m1[key] = 0.9 * m1[key] + 0.1 * d
                m2[key] = 0.999 * m2[key] + 0.001 * d * d
                model.p[key] = model.p[key] - rate * (m1[key] / (1 - 0.9**n)) / (np.sqrt(m2[key] / (1 - 0.999**n)) + 1e-8)
    return model


def main_blocks(model: Labeller, pages: list[str]) -> list[list[tuple[str, float]]]:
    """Per page, its blocks with their probability of being main text."""
    parsed = [Blocks(p) for p in pages]
    out: list[list[tuple[str, float]]] = [[] for _ in pages]
    order = sorted((i for i in range(len(pages)) if parsed[i].texts), key=lambda i: len(parsed[i].texts))
    start = 0
    while start < len(order):
        end, longest = start, 0
        while end < len(order) and end - start < 128:  # pages of like length, at most so many blocks at once
            longest = len(parsed[order[end]].texts)
            if end > start and longest * (end + 1 - start) > 6000:
                break
            end += 1
        own = order[start:end]
        for i, p in zip(own, model.probabilities([vectors(parsed[i]) for i in own]), strict=True):
            out[i] = list(zip(parsed[i].texts, p.tolist(), strict=True))
        start = end
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", model: Labeller | None = None) -> DataFrame:
    """One row per input row: id, url, text (main blocks joined by line ends), n_chars."""
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast(model or trained())
    columns = [pages[id_col].alias("key"), *([pages[url_col].alias("url")] if url_col else [])]
    source = pages.select(pages[html_col].cast("string").alias("html"), *columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:]) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = ["\n".join(t for t, p in blocks if p >= 0.5) for blocks in main_blocks(sent.value, [h or "" for h in part.column(0).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*part.schema.names[1:], "text", "n_chars"])

    return source.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
