"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between the bounds of block elements. Each block has a tag-path
vector (hashed tags, class and id words of its ancestors), a hashed-word vector and a few measures. A
bidirectional LSTM in numpy reads the page's whole block sequence and labels every block as article or not, so
a block is judged with all the others in view. The text is what the article blocks hold.

The labeller is learned from a sample of at most about `max_train_pages` pages and as many composed ones. The sample's
blocks are labelled by several signals (`page_labels`): what their elements are called, where the page's prose
stands, runs of links outside it. Composed pages know their labels by construction: some have speaking names, some
have none at all, and in some the article stands in an element called like an aside, so that names alone decide
nothing and the sequence has to. They hold lists of the article's own, remarks after an article that its element has
closed, and what pages say of themselves. Learning is one small task; labelling is one pass without a shuffle.
"""

from __future__ import annotations

import html
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIMS, WORD_DIMS, MEASURES = 512, 24, 11
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 16
MAX_TRAIN_PAGES = 300
LEAST_COMPOSED = 1300
TRAIN_WINDOW = 128

# Element names of HTML.
RAW = ("script", "style", "textarea", "template", "svg", "iframe", "noscript", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html head body title button option optgroup legend dt dd li td th tr tbody thead tfoot".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table select".split())
# Names that page authors give to what is not the article, and to what is.
ASIDE_TAGS = frozenset("head title nav header footer aside form button select option menu dialog legend fieldset label".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget related recommended share sharing social follow footer header masthead comment comments commentlist disqus reply replies respond form search pagination pager copyright legal".split()
)
NEUTRAL_WORDS = ("row", "col", "wrap", "wrapper", "container", "inner", "outer", "box", "block", "item", "list", "left", "right", "top", "grid", "home", "site", "js", "lazy", "clearfix", "theme", "dark", "hentry", "x1", "u7")
ARTICLE_WORDS = ("article", "post", "entry", "content", "story", "main", "body", "text", "page", "section", "blog", "news", "prose", "chapter")

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_EDGE = re.compile(r"""[>"']""")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[^\W_]+")
_slot_cache: dict[str, int] = {}


def _slot(name: str) -> int:
    at = _slot_cache.get(name)
    if at is None:
        if len(_slot_cache) > 100_000:
            _slot_cache.clear()
        at = _slot_cache[name] = zlib.crc32(name.encode()) % PATH_DIMS
    return at


class Element:
    """An element with those around it: tag, class and id words, and what follows from them."""

    __slots__ = ("tag", "words", "above", "depth", "label", "_path")

    def __init__(self, tag: str, words: tuple[str, ...], above: Element | None):
        self.tag, self.words, self.above = tag, words, above
        self.depth = above.depth + 1 if above else 1
        aside = tag in ASIDE_TAGS or (tag not in ("html", "body") and not ASIDE_WORDS.isdisjoint(words))
        self.label = 0 if aside or (above and not above.label) else 1
        self._path: np.ndarray | None = None

    def path(self) -> np.ndarray:
        """Counts of hashed tags and words from the root on."""
        chain, at = [], self
        while at is not None and at._path is None:
            chain.append(at)
            at = at.above
        path = at._path if at else np.zeros(PATH_DIMS, np.float32)
        for at in reversed(chain):
            path = path.copy()
            path[_slot(at.tag)] += 1
            for w in at.words:
                path[_slot("." + w)] += 1
            if at is not self:  # kept for those below
                at._path = path
        return path


def chain(names: tuple[tuple[str, tuple[str, ...]], ...]) -> Element | None:
    at = None
    for tag, words in names:
        at = Element(tag, words, at)
    return at


@dataclass
class Block:
    text: str
    element: Element | None
    linked: int

    @property
    def names(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """(tag, class and id words) from the root."""
        out, at = [], self.element
        while at is not None:
            out.append((at.tag, at.words))
            at = at.above
        return tuple(reversed(out))


def _names(attrs: str) -> tuple[str, ...]:
    return tuple(w.lower() for m in _NAMES.finditer(attrs) for w in _WORDS.findall(m[1] or m[2] or m[3] or ""))


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Markup in page order: start, end, tag (none for comments and raw elements), whether it ends one, attributes.

    Quotes hide a tag's end; one that is never closed doesn't. Raw elements go to their end tag or the page's end, a
    self-closed svg is empty. Every place is looked at a bounded number of times, whatever stays open.
    """
    last = {c: page.rfind(c) for c in ">\"'"}
    open_quotes: set[int] = set()  # quotes from which no tag's end is reached

    def tag_end(at: int) -> tuple[int, bool]:
        """Where the tag ends, -1 if nowhere; whether its quotes are closed."""
        first, met = at, []
        while at <= last[">"]:
            m = _EDGE.search(page, at)
            at = m.start()
            if page[at] == ">":
                return at + 1, True
            if at in open_quotes or last[page[at]] == at:
                break
            met.append(at)
            at = page.find(page[at], at + 1) + 1
        open_quotes.update(met)
        return page.find(">", first) + 1 or -1, False

    at, n = page.find("<"), len(page)
    while at >= 0:
        tag, ends, attrs, stop = None, False, "", -1
        m = _TAG.match(page, at)
        if m:
            stop, whole = tag_end(m.end()) if last[">"] >= m.end() else (-1, False)
            tag, ends, attrs = m[2].lower(), bool(m[1]), page[m.end() : max(stop - 1, m.end())]
            if stop > 0 and whole and not ends and tag in _RAW_END and attrs[:1] in ("", " ", "\t", "\n", "\r", "\f", "\v", "/"):
                if not (tag == "svg" and attrs.endswith("/")):
                    end = _RAW_END[tag].search(page, stop)
                    stop = end.end() if end else n
                tag = None
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4) + 3
            stop = stop if stop > 2 else n
        elif page[at + 1 : at + 2] in ("!", "?", "/") and at < last[">"]:
            stop = page.find(">", at) + 1
        if stop > 0:
            yield at, stop, tag, ends, attrs
        at = page.find("<", stop if stop > 0 else at + 1)


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order. Raw elements and comments have none."""
    out: list[Block] = []
    stack: list[Element] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
        linked = 0

    def close(tags: tuple[str, ...], bounds: frozenset) -> None:
        if not any(opened.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                flush()
                for e in stack[k:]:
                    opened[e.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in bounds:
                return

    at = 0
    for start, end, tag, ends, attrs in tokens(page):
        if start > at:
            parts.append(page[at:start])
            if links:
                linked += start - at
        at = end
        if tag is None:
            continue
        if ends:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                close((tag,), frozenset())
        elif tag == "br":
            parts.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                close(("p",), SCOPE)
            if tag in SIBLINGS:
                close(SIBLINGS[tag], SCOPE)
            stack.append(Element(tag, _names(attrs) if attrs else (), stack[-1] if stack else None))
            opened[tag] = opened.get(tag, 0) + 1
        elif tag == "a":
            links += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def named_label(block: Block) -> int:
    """What the names of a block's elements say: 1 article, 0 not."""
    return block.element.label if block.element else 1


# Elements that name the article, those that list, and words of what pages say of themselves.
MAIN = frozenset(("main", "article"))
LISTED = frozenset("li dt dd td th figcaption".split())
SELF_WORDS = frozenset("cookie cookies consent privacy accept copyright rights reserved subscribe newsletter advertisement sponsored comment comments reply posted login terms imprint".split())


#: Lines for composed pages; {0} is a year, {1} a name.
SELF_TALK = (
    "We use cookies to improve this site. By going on you accept our use of cookies.", "This site uses cookies. Read our privacy policy.", "Your privacy matters: accept all cookies or choose.",
    "\u00a9 {0} {1}. All rights reserved.", "Copyright {0} {1}", "\u00a9 {1} {0}", "All content copyright {1}, {0}.", "Terms of use and privacy", "Subscribe to our newsletter for more.", "Advertisement", "Sponsored by {1}",
)


def within_main(b: Block) -> bool:
    at = b.element
    while at is not None:
        if at.tag in MAIN:
            return True
        at = at.above
    return False


def spoken(text: str) -> float:
    """How much a block speaks of the page itself: a copyright sign or such words, as a share of its words."""
    words = [w.lower() for w in _WORDS.findall(text)]
    return min(1.0, (3 * ("\u00a9" in text) + sum(w in SELF_WORDS for w in words)) / max(4.0, len(words) / 4))


def is_prose(b: Block) -> bool:
    """A dozen words or more, few of them links."""
    return b.linked < 0.3 * len(b.text) and b.text.count(" ") >= 11


def page_labels(found: list[Block]) -> np.ndarray:
    """1 for article blocks of a page, by names, prose and links.

    A block is what its names say, with two exceptions. Where no prose stands outside elements called like asides, the
    named element that holds most of it is the article. Three or more blocks in a row that are links alone are none if
    the page's prose lies all before or all after them.
    """
    label = np.array([named_label(b) for b in found], int)
    prose = np.array([is_prose(b) for b in found], bool)
    if prose.any() and not (prose & (label == 1)).any():
        held: dict[tuple, int] = {}
        for b, p in zip(found, prose, strict=True):
            at = next((k for k, (tag, words) in enumerate(b.names) if tag not in ("html", "body") and not ASIDE_WORDS.isdisjoint(words)), None)
            if p and at is not None and not any(tag in ASIDE_TAGS for tag, _ in b.names):
                held[b.names[: at + 1]] = held.get(b.names[: at + 1], 0) + len(b.text)
        if held:
            best = max(held, key=held.get)
            for k, b in enumerate(found):
                if b.names[: len(best)] == best and not any(tag in ASIDE_TAGS for tag, _ in b.names):
                    label[k] = 1
    at = np.flatnonzero(prose & (label == 1))
    if len(at):
        for first, end in link_runs(found):
            if end <= at[0] or first > at[-1]:
                label[first:end] = 0
    return label


def link_runs(found: list[Block]) -> list[tuple[int, int]]:
    """Stretches of three or more blocks of links alone."""
    runs, first = [], 0
    for k in range(len(found) + 1):
        if k == len(found) or found[k].linked < 0.8 * len(found[k].text):
            if k - first >= 3:
                runs.append((first, k))
            first = k + 1
    return runs


def vectors(found: list[Block]) -> np.ndarray:
    """(blocks, DIMS)."""
    x = np.zeros((len(found), DIMS), np.float32)
    named = np.array([named_label(b) for b in found], np.float32)
    prose = np.array([is_prose(b) for b in found], np.float32)
    size = np.array([len(b.text) for b in found], np.float32)
    outside = float((named * prose * size).sum() / max(1.0, (prose * size).sum()))
    in_run = np.zeros(len(found), np.float32)
    for first, end in link_runs(found):
        in_run[first:end] = min(1.0, (end - first) / 8)
    held = [within_main(b) for b in found]
    apart = any(h and p for h, p in zip(held, prose, strict=True))
    for k, b in enumerate(found):
        x[k, :PATH_DIMS] = np.minimum(b.element.path(), 2) if b.element else 0
        words = b.text.split()
        hashed = np.bincount([(ord(w[0]) * 31 + ord(w[-1]) * 7 + len(w)) % WORD_DIMS for w in words], minlength=WORD_DIMS)
        x[k, PATH_DIMS : PATH_DIMS + WORD_DIMS] = hashed / max(1, len(words))
        x[k, -MEASURES:] = (np.log1p(len(b.text)) / 8, b.linked / len(b.text), k / len(found), (b.element.depth if b.element else 0) / 10, named[k], prose[k], outside, in_run[k], float(apart and not held[k]), spoken(b.text), float(bool(b.element) and b.element.tag in LISTED and not b.linked))
    return x


class Labeller:
    """A bidirectional LSTM with one logistic output for each block, which also sees the block's own vector."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.1, (DIMS, 4 * HIDDEN))
            self.w["h" + d] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.w["b" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.w["o"] = rng.normal(0, 0.2, 2 * HIDDEN)
        self.w["c"] = np.zeros(1)
        self.w["s"] = np.zeros(DIMS)

    def dumps(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, **self.w)
        return held.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> Labeller:
        new = cls()
        new.w = dict(np.load(io.BytesIO(raw)))
        return new

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: (time, batch, DIMS); mask: (time, batch). Padding leaves the state as it is."""
        n, batch = mask.shape
        given = x.astype(np.float32, copy=False) @ self.w["x" + d].astype(np.float32) + self.w["b" + d] if not keep else x @ self.w["x" + d] + self.w["b" + d]
        h = c = np.zeros((batch, HIDDEN))
        out, held = np.zeros((n, batch, HIDDEN)), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = given[t] + h @ self.w["h" + d]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            if keep:
                held.append((t, h, c, i, f, o, g, new))
            c = np.where(m, new, c)
            h = np.where(m, o * np.tanh(new), h)
            out[t] = h
        return out, held

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return both @ self.w["o"] + x @ self.w["s"] + self.w["c"][0]

    def accuracy(self, pages: list[list[Block]]) -> float:
        """Share of blocks labelled as `page_labels` has them."""
        hits = total = 0
        for page in pages:
            x, mask = _padded([vectors(page)])
            hits += int(((self.scores(x, mask)[:, 0] > 0) == page_labels(page)).sum())
            total += len(page)
        return hits / max(1, total)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w["o"] + x @ self.w["s"] + self.w["c"][0], -30, 30)))
        off = np.where(mask, p - y, 0) / max(1, mask.sum())
        grads = {"o": np.einsum("tb,tbh->h", off, both), "c": np.array([off.sum()]), "s": np.einsum("tb,tbi->i", off, x)}
        for k, d in enumerate("fb"):
            from_out = off[:, :, None] * self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dz = np.zeros((*mask.shape, 4 * HIDDEN))
            dh = dc = np.zeros((mask.shape[1], HIDDEN))
            hs = np.zeros_like(self.w["h" + d])
            for t, h, c, i, f, o, g, new in reversed(runs[d][1]):
                m = mask[t][:, None]
                full = dh + from_out[t]
                th = np.tanh(new)
                into = np.where(m, dc + full * o * (1 - th * th), 0)
                live = np.where(m, full, 0)
                z = np.concatenate([into * g * i * (1 - i), into * c * f * (1 - f), live * th * o * (1 - o), into * i * (1 - g * g)], axis=1)
                dz[t] = z
                hs += h.T @ z
                dh = z @ self.w["h" + d].T + np.where(m, 0, full)
                dc = np.where(m, into * f, dc)
            grads["x" + d] = np.einsum("tbi,tbj->ij", x, dz)
            grads["h" + d], grads["b" + d] = hs, dz.sum(axis=(0, 1))
        return grads


def _padded(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(g) for g in group)
    x, mask = np.zeros((n, len(group), DIMS), np.float32), np.zeros((n, len(group)), bool)
    for k, g in enumerate(group):
        x[: len(g), k] = g
        mask[: len(g), k] = True
    return x, mask


def _composed(rng: np.random.Generator, texts: list[str]) -> tuple[list[Block], np.ndarray]:
    """A page with made-up structure and its labels: parts around and inside an article, in random order and nesting.

    Kinds: names that speak (two in five pages), no names at all (a quarter), an article in an element called like an aside.
    Without speaking names asides are lists of links and short lines.
    """
    aside_tags, aside_words = sorted(ASIDE_TAGS - {"head", "title", "option", "legend"}), sorted(ASIDE_WORDS)
    kind = str(rng.choice(("named", "bare", "misled"), p=(0.4, 0.25, 0.35)))
    root = (("html", ()), ("body", ()))
    out: list[Block] = []
    labels: list[int] = []
    prose = [t for t in texts if t.count(" ") >= 14] or ["a few words of text that go on for a while until there are more than a dozen of them"]

    def pick(words) -> str:
        return str(words[rng.integers(len(words))])

    def leaf(names: tuple, label: int, words: int | None, linked: float = 0.0) -> None:
        text = pick(texts if words else prose)
        text = " ".join(text.split()[:words]) if words else text
        out.append(Block(text, chain(names), int(len(text) * linked)))
        labels.append(label)

    def few(most: int = 12) -> int:
        return int(rng.integers(1, most))

    def noise() -> tuple[str, ...]:
        return (pick(NEUTRAL_WORDS),) if rng.random() < 0.3 else ()

    def said(text: str, names: tuple, label: int, linked: float = 0.0) -> None:
        out.append(Block(text, chain(names), int(len(text) * linked)))
        labels.append(label)

    def listed(names: tuple) -> None:
        """A list of the article's own: short items, now and then links."""
        tag = pick(("ul", "ol", "ul"))
        linked = 1.0 if rng.random() < 0.25 else 0.0
        for _ in range(int(rng.integers(2, 6))):
            leaf((*names, (tag, ()), ("li", ())), 1, few(7), linked)

    def self_talk(names: tuple) -> None:
        """What a page says of itself, in elements without speaking names."""
        tag = pick(("div", "p", "section", "div"))
        names = (*names, (tag, noise()))
        for _ in range(1 if rng.random() < 0.6 else 2):
            said(pick(SELF_TALK).format(pick(("2019", "2021", "2024", "2025")), " ".join(pick(texts).split()[:2])), (*names, ("p", ())) if rng.random() < 0.5 else names, 0)

    def remarks(names: tuple) -> None:
        """Readers' remarks after an article that its element closes."""
        names = (*names, (pick(("div", "section", "div")), noise()))
        if rng.random() < 0.5:
            leaf((*names, (pick(("h2", "h3", "h4")), ())), 0, few(4))
        for _ in range(int(rng.integers(1, 5))):
            leaf((*names, (pick(("p", "div", "p")), ())), 0, None if rng.random() < 0.5 else few(14))

    def heading(names: tuple) -> None:
        leaf((*names, (pick(("h1", "h1", "h2")), ())), 1, few())

    def aside(names: tuple, long: bool = True) -> None:
        if kind == "named" or rng.random() < (0.5 if kind == "misled" else 0.3):
            named = rng.random()
            tag = pick(aside_tags) if named < 0.4 else pick(("div", "section", "ul", "p", "span"))
            names = (*names, (tag, noise() + ((pick(aside_words),) + ((pick(aside_words),) if rng.random() < 0.3 else ()) if named >= 0.3 else ())))
            inner = pick(("p", "li", "div", "td", "h3"))
            for _ in range(1 if rng.random() < 0.3 else int(rng.integers(1, 7))):
                short = rng.random() < 0.6 or not long
                leaf((*names, (inner, ())) if rng.random() < 0.7 else names, 0, few() if short else None, 1.0 if short and rng.random() < 0.5 else 0.0)
        else:
            if rng.random() < 0.4:
                names, inner = (*names, (pick(("div", "div", "section")), noise()), ("ul", ())), "li"
            else:
                names, inner = (*names, (pick(("div", "ul", "table", "section")), noise())), pick(("li", "td", "div", "p"))
            for _ in range(int(rng.integers(3, 12))):
                leaf((*names, (inner, ())), 0, few(5), 1.0)

    closed = False

    def article(names: tuple) -> None:
        nonlocal closed
        misled = ((pick(aside_words),) if rng.random() < 0.7 else (pick(aside_words), pick(NEUTRAL_WORDS))) if kind == "misled" else ()
        outer = rng.random() < 0.5
        if outer:
            heading(names)
        tags = ("div", "section") if kind == "misled" else ("article", "main", "div", "section") if kind == "named" else ("div", "div", "section", "td")
        speaking = (pick(ARTICLE_WORDS),) if kind == "named" and rng.random() < 0.5 else ()
        names = (*names, (pick(tags), noise() + speaking + misled))
        closed = names[-1][0] in MAIN
        if rng.random() < 0.5:
            names = (*names, (pick(tags), noise()))
        if not outer:
            heading(names)
        for k in range(int(rng.integers(2 if kind == "named" else 3, 16))):
            if rng.random() < 0.2 and kind == "named":
                aside(names)
            if k > 1 and rng.random() < 0.1:
                listed(names)
            leaf((*names, (pick(("p", "p", "p", "p", "li", "blockquote", "h2", "h3", "pre", "td", "div")), ())), 1, few(20) if k and rng.random() < 0.2 else None, 0.2 if rng.random() < 0.2 else 0.0)

    if rng.random() < 0.7:
        leaf((root[0], ("head", ()), ("title", ())), 0, few())
    if rng.random() < 0.4:
        root = (*root, ("div", noise()))
    if rng.random() < 0.2:
        self_talk(root)
    for _ in range(int(rng.integers(0, 5))):
        aside(root, kind != "misled")
    article(root)
    if closed and rng.random() < 0.5:
        remarks(root)
    for _ in range(int(rng.integers(0, 5)) if rng.random() < 0.7 else 0):
        aside(root, kind != "misled")
    if rng.random() < 0.4:
        self_talk(root)
    return out, np.array(labels)


def learn(pages: list[str], rounds: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 11) -> Labeller:
    """From the given pages and as many composed ones (`LEAST_COMPOSED` at least)."""
    rng = np.random.default_rng(seed)
    real = [b for b in (blocks(p) for p in pages) if b]
    texts = [b.text for page in real for b in page] or ["a few words of text"]
    composed = [_composed(rng, texts) for _ in range(max(LEAST_COMPOSED, len(real)))]
    rows = []
    for page, labels in [(p, page_labels(p)) for p in real] + composed:
        x, y = vectors(page), labels.astype(float)
        rows += [(x[k : k + TRAIN_WINDOW], y[k : k + TRAIN_WINDOW]) for k in range(0, len(y), TRAIN_WINDOW)]
    model = Labeller(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.w.items()}
    step, steps = 0, rounds * -(-len(rows) // batch)
    for _ in range(rounds):
        order = sorted(rng.permutation(len(rows)).tolist(), key=lambda i: len(rows[i][1]) // 16)
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            x, mask = _padded([rows[i][0] for i in groups[g]])
            y = np.zeros(mask.shape)
            for k, i in enumerate(groups[g]):
                y[: len(rows[i][1]), k] = rows[i][1]
            grads = model.gradients(x, mask, y)
            norm = np.sqrt(sum((v * v).sum() for v in grads.values()))
            step += 1
            now = rate * (1 - 0.95 * step / steps)  # ever smaller steps
            for k, v in grads.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                m, s = moments[k]
                m, s = 0.9 * m + 0.1 * v, 0.99 * s + 0.01 * v * v
                moments[k] = m, s
                model.w[k] = model.w[k] - now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


def main_texts(pages: list[str | None], model: Labeller, most: int = 10_000) -> list[str]:
    """The article text of each page, blocks joined by a line feed; empty if there is none."""
    cut = [blocks(p) if p else [] for p in pages]
    labels: dict[int, np.ndarray] = {}
    order = sorted((i for i, c in enumerate(cut) if c), key=lambda i: len(cut[i]))
    group: list[int] = []
    for i in [*order, -1]:
        if group and (i < 0 or (len(group) + 1) * len(cut[i]) > most):
            x, mask = _padded([vectors(cut[j]) for j in group])
            s = model.scores(x, mask)
            labels |= {j: s[: len(cut[j]), k] > 0 for k, j in enumerate(group)}
            group = []
        group.append(i)
    return ["\n".join(b.text for b, good in zip(c, labels[i], strict=True) if good) if c else "" for i, c in enumerate(cut)]


def fit(pages: DataFrame, html_col: str = "html", max_train_pages: int = MAX_TRAIN_PAGES) -> Labeller:
    """Learns in one task from at most about `max_train_pages` pages, drawn by a hash of their text. None is fine too."""
    n = pages.count()
    share = min(1.0, max_train_pages / max(1, n))
    drawn = pages.where(F.pmod(F.xxhash64(html_col), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select(F.coalesce(html_col, F.lit("")).alias("html")).distinct().repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(t for b in batches for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([learn(found).dumps()], pa.binary())], names=["model"])

    learned = drawn.mapInArrow(run, "model binary").first()
    return Labeller.loads(learned[0]) if learned else learn([])


def extract(pages: DataFrame, model: Labeller, html_col: str = "html") -> DataFrame:
    """The rows of pages with text string and n_chars long (code points) in place of the html.

    Null and empty pages, and pages without article blocks, give empty text. Whole pages are read. Repeated rows and
    null keys give a row each; columns named text or n_chars are replaced.
    """
    pages = pages.drop("text", "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(model.dumps())
    others = [f for f in pages.schema.fields if f.name != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.loads(shared.value)
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                texts = main_texts(part.column(part.schema.get_field_index(html_col)).to_pylist(), labeller)
                left = [part.column(part.schema.get_field_index(f.name)) for f in others]
                yield pa.RecordBatch.from_arrays([*left, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in others), "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return pages.mapInArrow(run, f"{schema}, text string, n_chars long" if schema else "text string, n_chars long")
