"""HTML extraction by a recurrent block labeller.

A page is read into its leaf blocks in page order. Each block is described by its tag path (the tags above it and the
words of their class and id names), by hashed vectors of its words, and by a few figures; a bidirectional LSTM in numpy
reads the sequence of all blocks of the page, so that every block is judged with the whole page in view, and says which
blocks belong to the main text. The network is trained here, on pages that ``SamplePages`` makes up.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialect.llm.common import arrow_batches

#: Tags that don't end a block, tags without content, tags whose content is no text of the page, and what ends what.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template select".split())
#: Tags of formulas and drawings, which stand in a line and may close themselves; of these and the skipped ones, those that part words.
FOREIGN = frozenset(
    (
        "math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml "
        "svg g defs symbol use text tspan textpath desc metadata path rect circle ellipse line polyline polygon image lineargradient radialgradient stop clippath mask pattern marker filter"
    ).split()
)
INLINE |= FOREIGN | {"object", "canvas", "noscript", "iframe"}
PARTED = frozenset("textarea select text desc mtd mtr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
P_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Names in a tag path that have a place of their own; all others share hashed ones.
NAMES = (
    "html body main article section header footer nav aside form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption button "
    "fieldset address details summary dialog menu center hgroup a b span label small "
    "content entry post story text body-text page wrapper container sidebar widget menu-name navbar breadcrumb pager ad ads advert sponsor promo banner cookie notice consent alert popup modal "
    "comment comments reply respond discussion share social related recommended newsletter subscribe signup login search copyright legal foot head top masthead logo toolbar tags meta byline"
).split()
PLACES = {name: k for k, name in enumerate(dict.fromkeys(NAMES))}
#: Different class and id words for one name.
ALIASES = {
    "advertisement": "advert", "adverts": "advert", "sponsored": "sponsor", "sponsors": "sponsor", "adsbygoogle": "ads", "adbox": "ad", "adslot": "ad", "cookies": "cookie", "gdpr": "consent", "privacy": "consent",
    "notification": "notice", "notices": "notice", "warning": "notice", "navigation": "nav", "navi": "nav", "topnav": "nav", "menubar": "menu", "menus": "menu", "breadcrumbs": "breadcrumb", "pagination": "pager", "rail": "sidebar", "side": "sidebar", "widgets": "widget",
    "replies": "reply", "disqus": "comments", "feedback": "comments", "commentlist": "comments", "sharing": "share", "follow": "social", "recommendations": "recommended", "teaser": "promo", "promotion": "promo", "promoted": "promo",
    "articlebody": "story", "entrycontent": "entry", "postcontent": "post", "footnav": "footer", "bottom": "foot", "imprint": "legal", "disclaimer": "legal", "articles": "article",
}
OTHER, WORDS, OWN, FIGURES, HIDDEN = 16, 48, 32, 10, 24
PATH = len(PLACES) + OTHER
WIDTH = PATH + OWN + WORDS + FIGURES

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_COMMENT_END, _TAG_PART = re.compile(r"--!?>"), re.compile(r"[\"'>]")
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _hash(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


@lru_cache(8192)
def _bits(tag: str, attributes: str) -> int:
    """The places of a tag and of the words of its names, as a bit mask."""
    names = [tag]
    for found in _NAMED.findall(attributes) if attributes else ():
        value = "".join(found)
        names += [w.lower() for w in _CAMEL.findall(value)]
        names += re.split(r"[^a-z]+", value.lower())
    mask = 0
    for k, name in enumerate(names):
        if name:
            name = ALIASES.get(name, name) if k else name
            if k and name in ("a", "b"):
                continue
            mask |= 1 << (PLACES[name] if name in PLACES else len(PLACES) + _hash(name, OTHER))
    return mask


@dataclass
class Block:
    text: str
    path: int
    own: str
    linked: int


class _Markup:
    """Finds the tags of a page, each character being looked at a bounded number of times, however the page is broken.

    A tag ends at the first ``>`` outside of quotes; where a quote is never closed or all ``>`` stand in quotes, at the
    first ``>`` of all. A ``<`` that begins nothing is text.
    """

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in ("'", '"', ">", "]]>")}
        self.failed: set[int] = set()  # quotes from which, if they open, no end of a tag is reached
        self.unclosed: set[str] = set()

    def _end(self, at: int) -> int:
        """The end of a tag whose name ends at ``at``, -1 if it has none."""
        if self.last[">"] < at:
            return -1
        passed, i = [], at
        while found := _TAG_PART.search(self.html, i):
            place, i = found.start(), found.end()
            if found[0] == ">":
                return i
            if place in self.failed or i > self.last[found[0]]:
                break
            passed.append(place)
            i = self.html.find(found[0], i) + 1
        self.failed.update(passed)
        return self.html.find(">", at) + 1

    def tags(self) -> Iterator[tuple[str, str, str, str]]:
        """(text before, name, ``/`` if it closes, attributes) of each tag; the last one has no name. Skipped content isn't text."""
        html, begin, at = self.html, 0, 0
        while m := _OPEN.search(html, at):
            at, content = m.end(), ""
            if m[1]:
                end = _COMMENT_END.search(html, at)
                end = end.end() if end else len(html)
            elif m[2] and at <= self.last["]]>"]:
                end = html.index("]]>", at) + 3
                content = html[at : end - 3]
            elif m[2] or m[3]:
                end = html.find(">", at) + 1 if at <= self.last[">"] else -1
            else:
                end = self._end(at)
            if end <= 0:
                at = m.start() + 1
                continue
            yield html[begin : m.start()], (m[5] or "").lower(), m[4] or "", html[m.end() : end - 1] if m[5] else content
            begin = at = end
            if m[5] and not m[4] and (tag := m[5].lower()) in RAW and html[end - 2] != "/":
                close = None if tag in self.unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                if close:
                    begin = at = close.end()
                else:
                    self.unclosed.add(tag)
                    if tag in ("script", "style", "textarea", "title"):
                        begin = at = len(html)
        yield html[begin:], "", "", ""


class _Frame:
    """An open tag that begins blocks, and the open inline tags inside of it."""

    def __init__(self, tag: str, mask: int):
        self.tag, self.mask = tag, mask
        self.inline: list[tuple[str, int]] = []
        self.held: Counter[str] = Counter()

    def pop(self) -> str:
        tag, _ = self.inline.pop()
        self.held[tag] -= 1
        return tag


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page with text, in page order; white space is one space, character references are decoded.

    Tags may be nested as deeply as they are. A closing tag that closes nothing is passed over.
    """
    out: list[Block] = []
    frames, opened = [_Frame("", 0)], Counter()
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = frames[-1]
                out.append(Block(text, top.inline[-1][1] if top.inline else top.mask, top.tag, linked))
            parts.clear()
        linked = 0

    def said(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.strip())

    def close() -> None:
        nonlocal links
        links -= frames[-1].held["a"]
        opened[frames.pop().tag] -= 1

    for text, tag, closing, attributes in _Markup(html).tags():
        said(text)
        if not tag:
            if attributes:
                parts.append(attributes)
            continue
        if not closing and tag in RAW:
            if tag in PARTED:
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in PARTED:
            parts.append(" ")
        if tag not in INLINE:
            flush()
        if closing:
            if tag in INLINE:
                while frames[-1].held[tag] > 0:
                    gone = frames[-1].pop()
                    links -= gone == "a"
                    if gone == tag:
                        break
            elif opened[tag] > 0:
                while frames[-1].tag != tag:
                    close()
                close()
            continue
        if tag in VOID or tag in FOREIGN and attributes.endswith("/"):
            continue
        if len(frames) > 1 and frames[-1].tag in (("p",) if tag in P_ENDS else CLOSES.get(tag, ())):
            close()
        top = frames[-1]
        mask = (top.inline[-1][1] if top.inline else top.mask) | _bits(tag, attributes.strip())
        if tag in INLINE:
            top.inline.append((tag, mask))
            top.held[tag] += 1
            links += tag == "a"
        else:
            frames.append(_Frame(tag, mask))
            opened[tag] += 1
    flush()
    return out


class _Places(dict):
    """Remembers the hashed place of each word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = place = _hash(word, WORDS)
        return place


_WORD_PLACES = _Places()


def vectors(page: list[Block]) -> np.ndarray:
    """A row for each block."""
    x = np.zeros((len(page), WIDTH), np.float32)
    width = (PATH + 7) // 8
    masks = np.frombuffer(b"".join(b.path.to_bytes(width, "little") for b in page), np.uint8).reshape(len(page), width)
    x[:, :PATH] = np.unpackbits(masks, axis=1, bitorder="little")[:, :PATH]
    sizes = np.array([len(b.text) for b in page], np.float64)
    total = sizes.sum()
    every: list[int] = []
    owner: list[int] = []
    for i, b in enumerate(page):
        x[i, PATH + _hash(b.own, OWN)] = 1
        found = _WORD.findall(b.text.lower())
        places = list(map(_WORD_PLACES.__getitem__, found))
        n = max(1, len(found))
        owner.append(len(places))
        every += places
        t = b.text
        x[i, PATH + OWN + WORDS :] = (
            np.log1p(len(t)) / 6, np.log1p(n) / 5, min(1.0, b.linked / len(t)), t[-1] in ".!?:;", t[0].isupper(), (t.count(".") + t.count(",")) / n,
            i / len(page), (len(page) - i - 1) / len(page), np.log1p(len(page)) / 5, len(t) / total,
        )
    held = np.array(owner)
    cells = np.repeat(np.arange(len(page)), held) * WORDS + np.array(every, np.int64)
    counts = np.bincount(cells, minlength=len(page) * WORDS).reshape(len(page), WORDS)
    x[:, PATH + OWN : PATH + OWN + WORDS] = np.sqrt(counts / np.maximum(1, held)[:, None])
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output; sequences are padded at their ends and masked."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.08, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.w[f"c{d}"] = bias
        self.w["o"] = rng.normal(0, 0.1, (2 * HIDDEN, 1)).astype(np.float32)
        self.w["p"] = np.zeros(1, np.float32)

    def _run(self, gates: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (time, page, hidden) from input gates (time, page, 4 hidden); the backward pass runs from the last step."""
        steps, pages, _ = gates.shape
        h, c = (np.zeros((pages, HIDDEN), np.float32) for _ in range(2))
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.w[f"h{d}"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            kept.append((t, h, c, i, f, o, g, new, m))
            c, h = m * new + (1 - m) * c, m * (o * np.tanh(new)) + (1 - m) * h
            out[t] = h
        return out, kept

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of each block of each page to be main text.

        Pages of a batch stand in falling order of length and all begin at step 0, also when read from their ends, so
        that the pages still running are the first ones and nothing is padded.
        """
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: -len(pages[k]))
        for low in range(0, len(order), 1024):
            batch = order[low : low + 1024]
            flat = np.concatenate([pages[k] for k in batch])
            sizes = np.array([len(pages[k]) for k in batch])
            first = np.cumsum(sizes) - sizes
            running = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # pages longer than each step
            states = np.zeros((len(flat), 2 * HIDDEN), np.float32)
            for side, d in enumerate("fb"):
                gates = flat @ self.w[f"x{d}"] + self.w[f"c{d}"]
                h, c = (np.zeros((len(batch), HIDDEN), np.float32) for _ in range(2))
                for t, n in enumerate(running):
                    at = first[:n] + t if d == "f" else first[:n] + sizes[:n] - 1 - t
                    z = gates[at] + h[:n] @ self.w[f"h{d}"]
                    s = _sigmoid(z[:, : 3 * HIDDEN])
                    c[:n] = s[:, HIDDEN : 2 * HIDDEN] * c[:n] + s[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
                    h[:n] = s[:, 2 * HIDDEN :] * np.tanh(c[:n])
                    states[at, side * HIDDEN : (side + 1) * HIDDEN] = h[:n]
            y = _sigmoid(states @ self.w["o"] + self.w["p"])[:, 0]
            for k, part in zip(batch, np.split(y, first[1:]), strict=True):
                out[k] = part
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the blocks of a padded batch (time, page, width)."""
        steps, pages, _ = x.shape
        runs = {d: self._run(x @ self.w[f"x{d}"] + self.w[f"c{d}"], mask, d) for d in "fb"}
        states = np.concatenate([runs[d][0] for d in "fb"], 2)
        p = _sigmoid(states @ self.w["o"] + self.w["p"])[..., 0]
        e = ((p - y) * mask / mask.sum())[..., None]
        g = {"o": np.einsum("tph,tpo->ho", states, e), "p": e.sum((0, 1))}
        back = e @ self.w["o"].T
        for k, d in enumerate("fb"):
            dx = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
            g[f"h{d}"] = np.zeros_like(self.w[f"h{d}"])
            dh, dc = (np.zeros((pages, HIDDEN), np.float32) for _ in range(2))
            for t, h, c, i, f, o, gg, new, m in reversed(runs[d][1]):
                dh = dh + back[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                th = np.tanh(new)
                dnew = m * (dc + dh * o * (1 - th**2))
                dz = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), m * dh * th * o * (1 - o), dnew * i * (1 - gg**2)], 1)
                dx[t] = dz
                g[f"h{d}"] += h.T @ dz
                dh, dc = (1 - m) * dh + dz @ self.w[f"h{d}"].T, (1 - m) * dc + dnew * f
            g[f"x{d}"] = np.einsum("tpw,tpz->wz", x, dx, optimize=True)
            g[f"c{d}"] = dx.sum((0, 1))
        return g

    def train(self, pages: list[np.ndarray], marks: list[np.ndarray], epochs: int, rate: float, seed: int, batch: int = 32) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        n = 0
        for epoch in range(epochs):
            order = sorted(range(len(pages)), key=lambda k: len(pages[k]) + rng.uniform(0, 6))
            groups = [order[k : k + batch] for k in range(0, len(order), batch)]
            for k in rng.permutation(len(groups)):
                group = groups[k]
                steps = max(len(pages[p]) for p in group)
                x, mask, y = np.zeros((steps, len(group), WIDTH), np.float32), np.zeros((steps, len(group)), np.float32), np.zeros((steps, len(group)), np.float32)
                for j, p in enumerate(group):
                    x[: len(pages[p]), j], mask[: len(pages[p]), j], y[: len(pages[p]), j] = pages[p], 1, marks[p]
                n += 1
                step = rate * (0.5 ** (3 * epoch / epochs))
                for name, g in self.gradients(x, mask, y).items():
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.01 * (g * g - v[name])
                    self.w[name] -= (step * (m[name] / (1 - 0.9**n)) / (np.sqrt(v[name] / (1 - 0.99**n)) + 1e-7)).astype(np.float32)


class SamplePages:
    """Made-up pages whose blocks begin with a mark: MAIN or OTHER."""

    MAIN, OTHER = "", ""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.syllables = ["th", "er", "an", "on", "ing", "re", "at", "ou", "sch", "ein", "ung", "lich", "que", "eau", "tion", "ment", "ción", "mente", "ado", "ña", "é", "ü", "ka", "mi", "lo", "pre", "sta", "vo"]

    def one(self, *options: str) -> str:
        return options[self.rng.integers(len(options))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        found = ["".join(self.rng.choice(self.syllables, self.rng.integers(1, 4))) for _ in range(self.rng.integers(low, high + 1))]
        return " ".join(found).capitalize()

    def prose(self, low: int = 1, high: int = 5) -> str:
        end = self.one(".", ".", ".", "!", "?", "", "*** ") if self.chance(0.3) else "."
        return " ".join(self.words(3, 14) + end for _ in range(self.rng.integers(low, high + 1)))

    def other(self, *usual: str) -> str:
        """Text that isn't main: usual phrases, or prose like any other."""
        return self.OTHER + (self.one(*usual) if usual and self.chance(0.5) else self.one(self.words(1, 4), self.prose(1, 2)))

    def named(self, tag: str, *names: str) -> tuple[str, str]:
        name = self.one(*names)
        name = self.one(name, name, f"{self.one('site', 'css', 'box', 'x')}-{name}", f"{name}-{self.one('wrap', 'area', 'inner', 'block')}", f"{name} {self.one('clearfix', 'row', 'dark')}")
        return f'<{tag} {self.one("class", "class", "id")}="{name}">', f"</{tag}>"

    def plain(self, tag: str) -> tuple[str, str]:
        return f"<{tag}>", f"</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<li><a href="/x">{self.other("Home", "About us", "Contact", "News", "Sport", "Archive", "Login")}</a></li>' for _ in range(self.rng.integers(low, high + 1))]
        if self.chance(0.25):
            return "".join(f'<a href="/y">{self.other("Home", "Help")}</a> ' for _ in items)
        return "<ul>" + "".join(items) + "</ul>"

    def inside(self, pair: tuple[str, str], *body: str) -> str:
        return pair[0] + "".join(body) + pair[1]

    def paragraphs(self, low: int, high: int, usual: str) -> str:
        return "".join(f"<p>{self.other(usual)}</p>" for _ in range(self.rng.integers(low, high + 1)))

    def menu(self) -> str:
        pair = self.plain("nav") if self.chance(0.5) else self.named(self.one("div", "nav", "ul"), "menu", "nav", "navigation", "navbar", "breadcrumb", "topnav")
        return self.inside(pair, self.links(2, 8))

    def head(self) -> str:
        pair = self.plain("header") if self.chance(0.6) else self.named("div", "header", "masthead", "top", "head", "banner")
        title = self.one(f'<div class="logo">{self.other()}</div>', f"<h1>{self.other()}</h1>", f"<p>{self.other()}</p>", "")
        return self.inside(pair, title, self.menu() if self.chance(0.7) else "", f"<p>{self.other('Search the site')}</p>" if self.chance(0.3) else "")

    def notice(self) -> str:
        pair = self.named(self.one("div", "div", "section", "aside"), "cookie", "cookie-notice", "notice", "consent", "alert", "gdpr", "cookies", "notification", "popup", "modal")
        return self.inside(pair, self.one(f"<p>{self.other('We use cookies.', 'Accept all cookies')}</p>", self.other("This site uses cookies to work.")), f"<button>{self.other('OK', 'Accept')}</button>" if self.chance(0.6) else "")

    def advert(self) -> str:
        pair = self.named(self.one("div", "div", "aside", "section"), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsbygoogle", "promotion", "sponsor", "ad-slot")
        return self.inside(pair, self.one(f"<p>{self.other('Advertisement', 'Buy now!')}</p>", self.other("Sponsored"), f'<a href="/z">{self.other("Shop now")}</a>', f"<h3>{self.other()}</h3><p>{self.other()}</p>"))

    def form(self) -> str:
        fields = "".join(f"<label>{self.other('Name', 'E-mail')}</label><input name=q>" for _ in range(self.rng.integers(1, 3)))
        body = self.inside(self.plain("form"), f"<p>{self.other('Sign up for our newsletter')}</p>" if self.chance(0.6) else "", fields, f"<button>{self.other('Send', 'Subscribe')}</button>", self.one("", f"<textarea>{self.words(1, 4)}</textarea>", f"<select><option>{self.words(1, 1)}</option></select>"))
        return self.inside(self.named("div", "newsletter", "subscribe", "signup", "search", "login"), body) if self.chance(0.4) else body

    def side(self) -> str:
        pair = self.plain("aside") if self.chance(0.5) else self.named(self.one("div", "aside", "section"), "sidebar", "widget", "related", "recommended", "rail", "side")
        return self.inside(pair, f"<h3>{self.other('Most read', 'Related', 'Popular')}</h3>" if self.chance(0.7) else "", self.one(self.links(2, 5), self.paragraphs(1, 4, "Read more"), self.links(1, 3)))

    def share(self) -> str:
        return self.inside(self.named(self.one("div", "ul"), "share", "social", "sharing", "tags", "follow"), self.links(1, 4))

    def comments(self) -> str:
        def single() -> str:
            body = f"<p>{self.other()}</p>" if self.chance(0.7) else self.other()
            return self.inside(self.named(self.one("div", "li", "article", "div"), "comment", "reply", "comment-body"), f"<b>{self.other()}</b><br>" if self.chance(0.4) else "", body)

        pair = self.named(self.one("section", "div", "div", "ol"), "comments", "comment-list", "comments", "discussion", "respond", "replies")
        return self.inside(pair, f"<h2>{self.other('Comments', '3 comments', 'Leave a reply')}</h2>" if self.chance(0.7) else "", *[single() for _ in range(self.rng.integers(1, 5))], self.form() if self.chance(0.3) else "")

    def foot(self) -> str:
        pair = self.plain("footer") if self.chance(0.65) else self.named("div", "footer", "foot", "copyright", "legal", "bottom")
        return self.inside(pair, self.one(f"{self.OTHER}&copy; {self.words(1, 3)} &middot; {self.prose(1, 1)}", f"<p>{self.other('&copy; 2020 All rights reserved.')}</p>", self.links(2, 6) + f"<p>{self.other('Imprint')}</p>"))

    def text(self) -> str:
        m, t = self.MAIN, self.prose(1, 6)
        kind = self.rng.random()
        if kind < 0.55:
            t = t.replace(" ", self.one(" ", " <b>x</b> ", ' <a href="/q">link</a> '), 1)
            return f"<p>{m}{t}" + self.one("</p>", "</p>", "</p>", "</p>\n", "")
        if kind < 0.64:
            return f"<p><b>{m}{self.prose(1, 1)}<br>"
        if kind < 0.74:
            tag = self.one("h2", "h3", "h2", "h4")
            return f"<{tag}>{m}{self.words(1, 8)}</{tag}>"
        if kind < 0.82:
            tag = self.one("ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{m}{self.one(self.words(1, 5), self.prose(1, 2))}</li>" for _ in range(self.rng.integers(2, 5))) + f"</{tag}>"
        if kind < 0.88:
            return f"<blockquote>{self.one('', '<p>')}{m}{t}</blockquote>"
        if kind < 0.92:
            return "<table>" + "".join(f"<tr><td>{m}{self.words(1, 3)}</td><td>{m}{self.words(1, 3)}</td></tr>" for _ in range(2)) + "</table>"
        if kind < 0.95:
            return f"<pre>{m}{t}</pre>"
        if kind < 0.97:
            return f"<figure><img src=a><figcaption>{m}{self.words(3, 9)}</figcaption></figure>"
        return f"<div>{m}{t}</div>"

    def article(self) -> str:
        title = f"<h1>{self.MAIN}{self.words(2, 9)}</h1>"
        title = self.one(title, title, title, f"<header>{title}</header>", "")
        body = [self.text() for _ in range(self.rng.integers(1, 14))]
        for extra, p in ((self.advert, 0.25), (self.share, 0.15), (self.side, 0.15), (self.form, 0.12), (self.comments, 0.12), (self.notice, 0.06), (self.menu, 0.05)):
            if self.chance(p):
                body.insert(len(body) if extra == self.comments else self.rng.integers(0, len(body) + 1), extra())
        kind = self.rng.random()
        if kind < 0.55:
            pair = self.plain("article")
        elif kind < 0.7:
            pair = self.plain("main")
        elif kind < 0.92:
            pair = self.named(self.one("div", "section", "article", "main"), "content", "entry", "post", "story", "article", "main", "entry-content", "article-body", "text", "page")
        else:
            pair = ("", "") if self.chance(0.5) else self.plain("div")
        return self.inside(pair, title, *body)

    def page(self) -> str:
        before = [f() for f, p in ((self.head, 0.4), (self.menu, 0.6), (self.notice, 0.25), (self.advert, 0.45), (self.form, 0.08), (self.side, 0.2)) if self.chance(p)]
        if self.chance(0.3):
            self.rng.shuffle(before)
        after = [f() for f, p in ((self.comments, 0.25), (self.side, 0.3), (self.advert, 0.2), (self.form, 0.15), (self.foot, 0.8), (self.notice, 0.1)) if self.chance(p)]
        body = "".join([*before, self.article(), *after])
        if self.chance(0.15):
            body = self.inside(self.named("div", "wrapper", "container", "page"), body)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}" + self.one("</body></html>", "</body></html>", "")

    def marked(self) -> tuple[list[Block], np.ndarray]:
        found = [b for b in blocks(self.page()) if self.MAIN in b.text or self.OTHER in b.text]
        marks = np.array([self.MAIN in b.text for b in found], np.float32)
        for b in found:
            b.text = b.text.replace(self.MAIN, "").replace(self.OTHER, "").strip() or "x"
        return found, marks


@lru_cache(2)
def trained(pages: int = 800, epochs: int = 8, seed: int = 11) -> Labeller:
    """The labeller after training on so many made-up pages; the same each time."""
    source, labeller = SamplePages(seed), Labeller()
    made = [(vectors(b), y) for b, y in (source.marked() for _ in range(pages)) if b]
    labeller.train([x for x, _ in made], [y for _, y in made], epochs, 0.015, seed)
    return labeller


def main_text(pages: list[str | None], labeller: Labeller) -> list[str]:
    """The main text of each page: its main blocks joined by an empty line."""
    parsed = [blocks(h) if h else [] for h in pages]
    scores = labeller.scores([vectors(p) if p else np.zeros((0, WIDTH), np.float32) for p in parsed])
    return ["\n\n".join(b.text for b, s in zip(p, y, strict=True) if s >= 0.5) for p, y in zip(parsed, scores, strict=True)]


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without ``html`` and with text and n_chars; columns of these names are replaced.

    A null or empty page, and one without a main block, has an empty text. Nothing is cut off or dropped from a block;
    equal pages get equal texts.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(trained().w)
    kept = [c for c in df.columns if c not in ("text", "n_chars", html)]
    df = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.w = shared.value
        for batch in batches:
            texts = main_text(batch.column(len(kept)).to_pylist(), labeller)
            columns = [*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "text", "n_chars"])

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept]
    return df.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
