"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks (text between block-level tags). A bidirectional LSTM in numpy reads the sequence of
all blocks of a page, each as a hashed vector of its tag path (tags, and words of class, id and role of the elements
around it), a hashed vector of its words, and a few measures, and gives every block the probability of being main text.
The context is the whole document, both ways. Blocks above one half are joined in page order.

The network is trained here, in one task, on a sample of the table's pages that is bounded in number (labelled by what
their elements say they are) and on pages composed of the sample's texts in other layouts, where the truth is known:
articles in plain divisions, with menus, sidebars, notices, adverts, forms and reader comments before, after and inside
them. A long page is read by the network in stretches that hand their state on, so memory follows the blocks' states only.

Scripts, styles, comments, the page's title and form controls (buttons, selections, text areas, lists of data) are no
blocks; whatever else has text is one, or part of one, such as mathematics in a sentence. Raw text ends at its end tag
only. A control is silent up to its end tag; one that an enclosing element's end shows to have none is silent up to the
next block-level tag. Character references are decoded, white space within a block becomes one space; nothing is cut off.

Defined results: null and empty pages, and pages without a main block, give the empty text; repeated rows give repeated
rows; an empty table gives an empty table; broken mark-up is read as browsers mostly do (an unclosed paragraph ends where
the next block begins, an end tag without a start is ignored); further columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import with_found

FIT_PAGES, COMPOSED_PAGES, EPOCHS, SEED = 200, 500, 8, 5
HIDDEN, PATH_BINS, WORD_BINS, MEASURES = 16, 160, 32, 7
WIDTH = PATH_BINS + WORD_BINS + MEASURES
#: Blocks (of all pages together) that go through the network at a time; of one page, in scoring and in training.
CELLS, STRETCH, FIT_STRETCH = 16_000, 8_000, 400

# Kinds of elements.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i iframe img ins kbd label map mark math "
    "annotation maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics "
    "object output picture q ruby rb rp rt rtc s samp slot small span strike strong sub sup svg text textpath tspan time tt u "
    "var video wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
SILENT = frozenset("select button datalist".split())
#: Silent elements that a start tag of the same name ends.
ALONE = frozenset(("button", "select"))
#: Block-level tags, the first of which ends a silent element without an end tag.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>?)",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS: dict[str, re.Pattern] = {}


@dataclass
class Block:
    """bins has a bit for each bin of the tag path, said what the path has of the words that training labels come from."""

    text: str
    bins: int
    said: frozenset[str]
    linked: int


@dataclass
class Silent:
    """An open silent element: its place on the stack, the blocks before it, whether a block-level tag has come since."""

    depth: int
    before: int
    ended: bool = False


def _tokens(name: str, attrs: str) -> tuple[str, ...]:
    """What an element says it is: its tag, and the words of its class, id and role."""
    out = [f"<{name}>"]
    if attrs and ("=" in attrs or "hidden" in attrs):
        for key, *values in _NAMED.findall(attrs):
            value = next((v for v in values if v), "")
            key = key.lower()
            if key == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    out.append("hidden")
            elif key in ("hidden", "aria-hidden"):
                if value.lower() != "false":
                    out.append("hidden")
            else:
                out += [w.lower() for w in _WORD.findall(value)]
    return tuple(out)


def _bins(tokens: Iterable[str]) -> int:
    bits = 0
    for t in tokens:
        bits |= 1 << zlib.crc32(t.encode()) % PATH_BINS
    return bits


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order."""
    page = page or ""
    out: list[Block] = []
    #: Of each open element: its name, the bins of all tokens down to it, those of its own, and the path's known tokens.
    stack: list[tuple[str, int, int, frozenset[str]]] = []
    silent: list[Silent] = []
    parts: list[str] = []
    at = linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not (silent and not silent[-1].ended):
                _, path, own, said = stack[-1] if stack else TOP
                out.append(Block(text, path | own, said, min(linked, len(text))))
            parts.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if in_link:
                linked += len(piece)

    def close(depth: int, by_own_end: bool = False) -> None:
        """Leave the elements from this depth on. What a silent element holds goes if its own end tag closes it."""
        del stack[depth:]
        while silent and silent[-1].depth >= depth:
            left = silent.pop()
            if by_own_end and left.depth == depth:
                del out[left.before :]

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = not m["end"]
            elif name in ("br", "wbr", "img"):
                parts.append(" " if name == "br" else "")
            continue
        flush()
        in_link = False
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k, by_own_end=True)
                    break
            continue
        attrs = m["attrs"]
        if name in RAW and not attrs.endswith("/>"):
            end = _ENDS.setdefault(name, re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I)).search(page, at)
            at = end.end() if end else n
            continue
        while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(name, ())):
            close(len(stack) - 1)
        if name in ALONE and (before := next((x for x in reversed(silent) if stack[x.depth][0] == name), None)):
            close(before.depth)
        if name in BLOCK:
            for x in reversed(silent):
                if x.ended:
                    break
                x.ended = True
        if name not in VOID and not attrs.endswith("/>"):
            if name in SILENT:
                silent.append(Silent(len(stack), len(out)))
            tokens = _tokens(name, attrs)
            _, path, _, said = stack[-1] if stack else TOP
            own = _bins(f"own {t}" for t in tokens)
            stack.append((name, path | _bins(tokens), own, said | (KNOWN & set(tokens))))
    flush()
    return out


class _WordBins(dict):
    def __missing__(self, word: str) -> int:
        self[word] = k = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BINS
        return k


class Vectors:
    """Block vectors, with the bins of paths and words kept while they recur."""

    def __init__(self) -> None:
        self.paths: dict[int, np.ndarray] = {}
        self.words = _WordBins()

    def path(self, bins: int) -> np.ndarray:
        if (found := self.paths.get(bins)) is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            found = self.paths[bins] = np.flatnonzero([bins >> k & 1 for k in range(PATH_BINS)])
        return found

    def of(self, page: list[Block], start: int = 0, end: int | None = None) -> np.ndarray:
        """Vectors of the page's blocks from start to end."""
        total = len(page)
        page = page[start:end]
        out = np.zeros((len(page), WIDTH), dtype=np.float32)
        if len(self.words) > 300_000:
            self.words.clear()
        known = self.words
        for i, b in enumerate(page):
            out[i, self.path(b.bins)] = 1
            words = b.text.split()
            counts = np.bincount(list(map(known.__getitem__, words)), minlength=WORD_BINS)
            out[i, PATH_BINS : PATH_BINS + WORD_BINS] = np.sqrt(counts / len(words))
            n = len(b.text)
            out[i, PATH_BINS + WORD_BINS :] = (
                np.log1p(n) / 5,
                np.log1p(len(words)) / 4,
                b.linked / n,
                min(1.0, 20 * sum(map(b.text.count, ".,;!?")) / n),
                (start + i) / max(1, total - 1),
                "©" in b.text,
                b.text[-1] in ".!?…\"”»",
            )
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Bidirectional LSTM with one logistic output for each step."""

    NAMES = ("wx0", "wh0", "b0", "wx1", "wh1", "b1", "out", "bias")

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {}
        for d in "01":
            self.w["wx" + d] = (rng.normal(size=(WIDTH, 4 * h)) * 0.15).astype(np.float32)
            self.w["wh" + d] = (rng.normal(size=(h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            self.w["b" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.w["out"] = (rng.normal(size=2 * h) / np.sqrt(2 * h)).astype(np.float32)
        self.w["bias"] = np.zeros(1, dtype=np.float32)

    @staticmethod
    def _flip(lengths: np.ndarray, longest: int) -> np.ndarray:
        """For each sequence, its steps in reverse; padding stays behind."""
        step = np.arange(longest)[None, :]
        return np.where(step < lengths[:, None], lengths[:, None] - 1 - step, step)

    def _direction(self, x: np.ndarray, d: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list, tuple]:
        n, t, _ = x.shape
        wh, h = self.w["wh" + d], HIDDEN
        gates_x = x @ self.w["wx" + d] + self.w["b" + d]
        hidden, cell = state or (np.zeros((n, h), dtype=np.float32), np.zeros((n, h), dtype=np.float32))
        out, kept = np.zeros((n, t, h), dtype=np.float32), []
        for k in range(t):
            z = gates_x[:, k] + hidden @ wh
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            tanh = np.tanh(new)
            if keep:
                kept.append((i, f, o, g, cell, tanh, hidden))
            cell, hidden = new, o * tanh
            out[:, k] = hidden
        return out, kept, (hidden, cell)

    def one(self, n: int, vectors: Callable[[int, int], np.ndarray], stretch: int = STRETCH) -> np.ndarray:
        """Probabilities for one page of n blocks, whose vectors(start, end) are made a stretch at a time."""
        score = np.zeros(n, dtype=np.float32)
        parts = [(at, min(n, at + stretch)) for at in range(0, n, stretch)]
        for d, order in (("0", parts), ("1", parts[::-1])):
            state, weight = None, self.w["out"][:HIDDEN] if d == "0" else self.w["out"][HIDDEN:]
            for a, b in order:
                step = 1 if d == "0" else -1
                hidden, _, state = self._direction(vectors(a, b)[None, ::step], d, False, state)
                score[a:b] += (hidden[0] @ weight)[::step]
        return _sigmoid(score + self.w["bias"])

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        rows, flip = np.arange(len(x))[:, None], self._flip(lengths, x.shape[1])
        ahead, kept0, _ = self._direction(x, "0", keep)
        x_back = x[rows, flip]
        back, kept1, _ = self._direction(x_back, "1", keep)
        both = np.concatenate([ahead, back[rows, flip]], axis=2)
        p = _sigmoid(both @ self.w["out"] + self.w["bias"])
        return p, (both, flip, x_back, kept0, kept1)

    def _direction_slopes(self, x: np.ndarray, slope: np.ndarray, d: str, kept: list, grads: dict) -> None:
        n, t, _ = x.shape
        h, wh = HIDDEN, self.w["wh" + d]
        dz_all = np.zeros((n, t, 4 * h), dtype=np.float32)
        dh, dc = np.zeros((n, h), dtype=np.float32), np.zeros((n, h), dtype=np.float32)
        gwh = np.zeros_like(wh)
        for k in range(t - 1, -1, -1):
            i, f, o, g, cell, tanh, hidden = kept[k]
            dh = dh + slope[:, k]
            dc = dc + dh * o * (1 - tanh**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dz_all[:, k] = dz
            gwh += hidden.T @ dz
            dh, dc = dz @ wh.T, dc * f
        grads["wh" + d] = gwh
        grads["wx" + d] = x.reshape(-1, WIDTH).T @ dz_all.reshape(-1, 4 * h)
        grads["b" + d] = dz_all.sum(axis=(0, 1))

    def slopes(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict:
        p, (both, flip, x_back, kept0, kept1) = self.forward(x, lengths, keep=True)
        mask = np.arange(x.shape[1])[None, :] < lengths[:, None]
        d = ((p - y) * mask / mask.sum()).astype(np.float32)
        grads = {"out": np.tensordot(d, both, axes=((0, 1), (0, 1))), "bias": np.array([d.sum()], dtype=np.float32)}
        slope = d[:, :, None] * self.w["out"]
        rows = np.arange(len(x))[:, None]
        self._direction_slopes(x, slope[:, :, :HIDDEN], "0", kept0, grads)
        self._direction_slopes(x_back, slope[:, :, HIDDEN:][rows, flip], "1", kept1, grads)
        return grads


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), int(lengths.max()), WIDTH), dtype=np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
    return x, lengths


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED, batch: int = 24) -> Network:
    """Adam on the cross-entropy of all blocks; pages of like length share a batch."""
    net, rng = Network(seed), np.random.default_rng(seed)
    order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for k in rng.permutation(len(groups)):
            chosen = [pages[i] for i in groups[k]]
            x, lengths = _padded([c[0] for c in chosen])
            y = np.zeros(x.shape[:2], dtype=np.float32)
            for i, c in enumerate(chosen):
                y[i, : len(c[1])] = c[1]
            step += 1
            for name, g in net.slopes(x, lengths, y).items():
                g = np.clip(g, -1, 1) + 1e-5 * net.w[name]
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                net.w[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


# What elements of a page are commonly called; training labels come from these.
ASIDE_TAGS = frozenset("nav footer aside form header menu dialog fieldset figcaption".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie consent disqus footer header "
    "hidden masthead menu modal nav navbar navigation newsletter notice popup promo promoted recommended related reply replies "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
MAIN_TAGS, MAIN_WORDS = frozenset(("article", "main")), frozenset("article content entry main post story text body".split())
KNOWN = ASIDE_WORDS | MAIN_WORDS | {f"<{t}>" for t in ASIDE_TAGS | MAIN_TAGS}
#: What the stack holds above a page's outermost element.
TOP: tuple[str, int, int, frozenset[str]] = ("", 0, 0, frozenset())


def declared(b: Block) -> bool | None:
    """What a block's elements say it is: main text or not; None where they say nothing."""
    tags = {t[1:-1] for t in b.said if t[0] == "<"}
    words = {t for t in b.said if t[0] != "<"}
    if tags & (ASIDE_TAGS - {"header"}) or words & ASIDE_WORDS or ("header" in tags and not tags & MAIN_TAGS):
        return False
    if tags & MAIN_TAGS or words & MAIN_WORDS:
        return True
    return None


def compose(rng: np.random.Generator, main: list[str], other: list[str]) -> str:
    """A page in a random layout; each block's text starts with a private character that tells what it is."""
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    good = lambda: "\ue000" + esc(pick(main))
    bad = lambda: "\ue001" + esc(pick(other if rng.random() < 0.6 else main)[: int(rng.integers(8, 240))])

    def links(n: int) -> str:
        item = lambda: f'<li><a href="/{int(rng.integers(99))}">{bad()[:30]}</a></li>'
        return "<ul>" + "".join(item() for _ in range(n)) + "</ul>"

    def named(tag: str, name: str, inner: str) -> str:
        key = pick(["class", "class", "id", "role"])
        return f'<{tag} {key}="{name}">{inner}</{tag}>'

    def para() -> str:
        kind = rng.random()
        if kind < 0.72:
            return f"<p>{good()}</p>" if rng.random() < 0.8 else f"<p>{good()}"
        if kind < 0.8:
            return f"<{(h := pick(['h2', 'h3']))}>{good()[:60]}</{h}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{good()[:150]}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote>{good()}</blockquote>"
        return f"<table><tr><td>{good()[:40]}</td><td>{good()[:40]}</td></tr></table>"

    words = sorted(ASIDE_WORDS - {"hidden", "header", "footer"})

    def extra() -> str:
        kind = rng.random()
        if kind < 0.3:
            return named(pick(["div", "section", "aside"]), pick(words), f"<p>{bad()}</p>" if rng.random() < 0.5 else bad())
        if kind < 0.45:
            return f"<aside><h3>{bad()[:40]}</h3><p>{bad()}</p></aside>"
        if kind < 0.6:
            return f"<form><label>{bad()[:40]}</label><p>{bad()}</p><input></form>"
        if kind < 0.8:
            said = "".join(named("div", pick(["comment", "reply"]), f"<p>{bad()}</p>") for _ in range(int(rng.integers(1, 5))))
            return named(pick(["section", "div", "ul"]), pick(["comments", "replies", "respond", "comments-list"]), f"<h2>{bad()[:30]}</h2>{said}")
        if kind < 0.9:
            return f'<div {pick(["hidden", "aria-hidden=true", "style=display:none"])}>{bad()}</div>'
        return f"<nav>{links(int(rng.integers(2, 6)))}</nav>"

    top, bottom = [], []
    if rng.random() < 0.8:
        top.append(pick([f"<nav>{links(int(rng.integers(2, 9)))}</nav>", named("div", pick(["menu", "navbar", "nav"]), links(4))]))
    if rng.random() < 0.5:
        top.append(pick([f"<header><h1>{bad()[:40]}</h1><p>{bad()}</p></header>", named("div", pick(["header", "masthead", "topbar"]), bad())]))
    top += [extra() for _ in range(int(rng.integers(0, 3)))]
    bottom += [extra() for _ in range(int(rng.integers(0, 4)))]
    if rng.random() < 0.85:
        bottom.append(pick([f"<footer>&copy; {bad()}</footer>", named("div", pick(["footer", "site-footer"]), f"&copy; {bad()}")]))
    body = [para() for _ in range(int(rng.integers(1, 12)))]
    for _ in range(int(rng.integers(0, 3))):
        if rng.random() < 0.6:
            body.insert(int(rng.integers(len(body) + 1)), extra())
    inner = (f"<h1>{good()[:70]}</h1>" if rng.random() < 0.8 else "") + "".join(body)
    if rng.random() < 0.2:
        inner = f"<header><h1>{good()[:70]}</h1></header>" + "".join(body)
        shell = f"<article>{inner}</article>"
    else:
        name = pick(["content", "post", "entry-content", "story", "article-body", "main-text"])
        shell = pick([f"<article>{inner}</article>", f"<main>{inner}</main>", named("div", name, inner), f"<main><article>{inner}</article></main>"])
    if rng.random() < 0.3:
        shell = f'<div class="{pick(["wrapper", "container", "page", "row"])}">{shell}</div>'
    return f"<html><head><title>{esc(pick(main))[:40]}</title></head><body>{''.join(top)}{shell}{''.join(bottom)}</body></html>"


def _stretches(page: list[Block], said: list[bool], vectors: Vectors) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, labels) of a page, in runs that fit a batch."""
    for at in range(0, len(page), FIT_STRETCH):
        end = min(len(page), at + FIT_STRETCH)
        yield vectors.of(page, at, end), np.array(said[at:end], dtype=np.float32)


def training_pages(pages: list[str], composed: int = COMPOSED_PAGES, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vectors, labels) of the sample and of composed pages."""
    vectors, out, main, other = Vectors(), [], [], []
    for page in pages:
        found = blocks(page)
        said = [declared(b) for b in found]
        for b, s in zip(found, said, strict=True):
            (main if s else other).append(b.text) if s is not None else None
        if found and None not in said:
            out += _stretches(found, said, vectors)
    main, other = main or ["Lorem ipsum dolor sit amet, consectetur."], other or ["Home", "About us", "Contact"]
    rng = np.random.default_rng(seed)
    for _ in range(composed):
        found = blocks(compose(rng, main, other))
        found = [b for b in found if b.text.lstrip("© ")[:1] in ("\ue000", "\ue001")]
        said = [b.text.lstrip("© ")[0] == "\ue000" for b in found]
        for b in found:
            b.text = b.text.replace("\ue000", "").replace("\ue001", "").strip() or "x"
        if found:
            out += _stretches(found, said, vectors)
    return out


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, key: str = "page_id", html: str = "html") -> Network:
    """A network trained, in one task, on about fit_pages pages (chosen by a hash of the key) and composed ones."""
    n = pages.count()
    below = max(1, int(min(1.0, fit_pages / max(n, 1)) * 2**20))
    sample = pages.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(2**20)) < F.lit(below)).select(F.col(html).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = sorted(page for b in batches for page in b["html"])
        net = train(training_pages(found))
        yield pd.DataFrame({"name": list(net.w), "value": [v.tobytes() for v in net.w.values()]})

    weights = sample.filter("html <> ''").repartition(1).mapInPandas(run, "name string, value binary").collect()
    if not weights:  # no page with anything on it: composed ones only
        return train(training_pages([]))
    net = Network()
    for r in weights:
        net.w[r["name"]] = np.frombuffer(r["value"], dtype=np.float32).reshape(net.w[r["name"]].shape).copy()
    return net


def main_texts(pages: list[str | None], net: Network, vectors: Vectors) -> list[str]:
    """Main text of each page."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(found[order[end]]) * (end + 1 - at) <= CELLS:
            end += 1
        part = order[at:end]
        if len(found[part[0]]) > STRETCH:
            page = found[part[0]]
            p = [net.one(len(page), lambda a, b, page=page: vectors.of(page, a, b))]
        else:
            x, lengths = _padded([vectors.of(found[i]) for i in part])
            p, _ = net.forward(x, lengths)
        for row, i in enumerate(part):
            out[i] = "\n".join(b.text for b, q in zip(found[i], p[row], strict=False) if q > 0.5)
        at = end
    return out


def extract(pages: DataFrame, net: Network, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, url, text, n_chars) of every whole page."""

    def compute():
        vectors = Vectors()

        def of(found: list[str]) -> list:
            texts = main_texts(found, net, vectors)
            return [texts, [len(t) for t in texts]]

        return of

    out = with_found(pages.select(key, url, html), html, "text string, n_chars long", compute)
    return out.select(F.col(key), F.col(url), "__found.text", "__found.n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))
