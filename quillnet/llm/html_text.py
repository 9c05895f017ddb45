"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks, each with its tag path, its words
and its links.  A bidirectional LSTM in numpy reads the tag-path and hashed-word
vectors of the whole sequence and labels every block as main text or not.  It is
trained by backpropagation through time on invented pages of many shapes and on a
bounded sample of the table's pages, labelled by the elements that enclose them.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, others, quoted, widened
from .langid import softmax
from .repeats import Kind, symbols

UNITS = 12
PATHS, WORDS = 256, 48
#: Bounds of training: pages of the table (about), invented pages, steps, pages a step, neighbouring blocks of a page.
SAMPLE, INVENTED, STEPS, BATCH, BLOCKS = 300, 400, 160, 32, 48
SAMPLE_CHARS = 60_000
#: Levels of an element's path that a block keeps, outermost and innermost; how far up an open element is looked for.
OUTER, INNER, UP = 16, 48, 512

# Element names by their part in a page.
HIDDEN = "template select datalist head".split()
RAW = "script style noscript textarea title iframe noembed noframes".split()
INLINE = "a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img input ins kbd label mark meta link object param q s samp small span strike strong sub sup time tt u var wbr".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
DRAWN = "svg math".split()
GOOD = "article main".split()
BAD = "nav header footer aside form menu dialog".split()
# what can stand in a head; anything else, and text, closes it
OF_HEAD = "head base basefont bgsound link meta title noscript noframes script style template".split()
# elements of text that end a drawing around them
BREAKS = "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article main section aside header footer nav".split()
P_CLOSERS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
# words of class names from which pages are invented and sampled pages labelled; the network itself gets no list
BAD_WORDS = "ad ads advert advertisement banner sponsor promo menu nav navbar navigation breadcrumb breadcrumbs sidebar widget footer header masthead cookie cookies consent notice alert popup modal comment comments reply replies disqus respond share social related recommended newsletter subscribe login signup search pagination copyright legal toolbar".split()
GOOD_WORDS = "article content post entry story body main text prose".split()

# a tag: a value follows its equals sign, quoted or up to white space; a quote that never ends is a letter like others
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_INLINE, _VOID, _HIDDEN, _RAW, _DRAWN, _OF_HEAD, _BREAKS, _P_CLOSERS = map(set, (INLINE, VOID, HIDDEN, RAW, DRAWN, OF_HEAD, BREAKS, P_CLOSERS))
_ALONE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """Text and tags in page order: ("", text, ""), ("<" or "</", name, attributes), in one pass.

    Comments, declarations and the content of raw elements are left out; they, and
    a tag that is not closed, end with the page at the latest.
    """
    at = look = 0
    while True:
        i = page.find("<", look)
        c = page[i + 1 : i + 2] if i >= 0 else ""
        if i >= 0 and not (c.isascii() and (c.isalpha() or c in "/!?") and c):
            look = i + 1  # a sign like others
            continue
        if (text := page[at : i if i >= 0 else len(page)]) != "":
            yield "", text, ""
        if i < 0:
            return
        if page.startswith("<!--", i):
            end = _COMMENT_END.search(page, i + 2 if page.startswith(("<!-->", "<!--->"), i) else i + 4)
            at = end.end() if end else len(page)
        elif c in "!?" or (c == "/" and not (page[i + 2 : i + 3].isascii() and page[i + 2 : i + 3].isalpha())):
            at = page.find(">", i) + 1 or len(page)
        elif m := _TAG.match(page, i):
            name, at = m[1].lower(), m.end()
            if c != "/" and name in _RAW:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
                yield "<>", name, ""
            else:
                yield "</" if c == "/" else "<", name, m[2]
        else:
            return
        look = at


class _Open:
    """The open block elements of a page, from the outermost on, each with its label."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.labels: list[str] = []
        self.count: Counter = Counter()

    def top(self) -> str:
        return self.names[-1] if self.names else ""

    def push(self, name: str, label: str) -> None:
        self.names.append(name)
        self.labels.append(label)
        self.count[name] += 1

    def cut(self, k: int) -> None:
        """Close the element at place k and all within it."""
        for name in self.names[k:]:
            self.count[name] -= 1
        del self.names[k:], self.labels[k:]

    def find(self, wanted: set[str], fence: set[str] = frozenset()) -> int | None:
        """The innermost open element of these names, unless a fence stands before it."""
        if any(self.count[n] for n in wanted):
            for k in range(len(self.names) - 1, max(len(self.names) - 1 - UP, -1), -1):
                if self.names[k] in fence:
                    return None
                if self.names[k] in wanted:
                    return k
        return None

    def close(self, wanted: set[str], fence: set[str] = frozenset()) -> None:
        if (k := self.find(wanted, fence)) is not None:
            self.cut(k)

    def hidden(self) -> bool:
        return any(self.count[n] for n in _HIDDEN)

    def path(self) -> tuple[str, ...]:
        return tuple(self.labels if len(self.labels) <= OUTER + INNER else self.labels[:OUTER] + self.labels[-INNER:])


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order: the path of enclosing block elements (with class words), decoded text, linked characters."""
    out: list[Block] = []
    open_, text = _Open(), []
    linked, link, drawn = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined and not open_.hidden():
                out.append(Block(open_.path(), joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    for kind, name, more in scan(page):
        if not kind:
            if open_.top() == "head" and name.strip():
                open_.cut(len(open_.names) - 1)
            text.append(name)
            linked += len(name) if link else 0
            continue
        starts = kind != "</"
        if open_.top() == "head" and starts and name not in _OF_HEAD:
            open_.cut(len(open_.names) - 1)
        if kind == "<>":
            # in the midst of a drawing or a line a raw element parts nothing
            continue
        if name in _DRAWN:
            drawn = max(drawn + (0 if more.endswith("/") else 1 if starts else -1), 0)
            continue
        if drawn:
            if (starts and name in _BREAKS) or (not starts and open_.count[name]):
                drawn = 0
            else:
                continue
        if name in _INLINE:
            if name == "a":
                link = starts
            elif name == "br":
                text.append(" ")
            continue
        flush()
        link = False
        if not starts:
            open_.close({name})
            continue
        if name in _P_CLOSERS and open_.top() == "p":
            open_.cut(len(open_.names) - 1)
        if name in _ALONE:
            open_.close(_ALONE[name], _FENCE.get(name, frozenset()))
        if name not in _VOID:
            words = sorted({w for f in _NAMES.findall(more) for w in _PARTS.findall("".join(f).lower())}) if more else []
            open_.push(name, " ".join([name, *words]))
    flush()
    return out


EXTRA = 14


def _path_dims(path: tuple[str, ...]) -> np.ndarray:
    """Hashed names of elements and classes along the path, the innermost element's apart."""
    v = np.zeros(PATHS)
    for label in path:
        name, *words = label.split()
        for w in (f"<{name}", *words):
            v[zlib.crc32(w.encode()) % PATHS] += 0.7
    return np.minimum(v, 2)


_KNOWN: dict[tuple[str, ...], np.ndarray] = {}


def vectors(blocks: list[Block]) -> np.ndarray:
    """One input vector for each block."""
    x = np.zeros((len(blocks), PATHS + WORDS + EXTRA), np.float32)
    if not blocks:
        return x
    if len(_KNOWN) > 50_000:
        _KNOWN.clear()
    for k, b in enumerate(blocks):
        if (v := _KNOWN.get(b.path)) is None:
            v = _KNOWN[b.path] = _path_dims(b.path)
        x[k, :PATHS] = v
    raw = [b.text.lower().encode() for b in blocks]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    codes, at = symbols(Kind(1, 1, words=True), np.frombuffer(b"".join(raw), np.uint8), offsets)
    n = np.diff(at)
    row = np.repeat(np.arange(len(blocks)), n)
    hist = np.bincount(row * WORDS + ((codes >> np.uint64(7)) % np.uint64(WORDS)).astype(np.int64), minlength=len(blocks) * WORDS).reshape(-1, WORDS)
    x[:, PATHS : PATHS + WORDS] = hist / np.sqrt(np.maximum(n, 1))[:, None] * 0.5
    size = np.array([len(b.text) for b in blocks])
    extra = x[:, PATHS + WORDS :]
    extra[:, 0] = np.log1p(size) / 6
    extra[:, 1] = np.array([b.linked for b in blocks]) / size
    extra[:, 2] = np.log1p(n) / 5
    extra[:, 3] = [b.text[-1] in ".!?:;\"'" for b in blocks]
    depth = np.array([len(b.path) for b in blocks])
    extra[:, 4] = depth / 8
    for k, names in enumerate((("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li",), ("td", "th"), ("pre", "blockquote"), ("div", "section"), ("body", "html"))):
        extra[:, 5 + k] = [bool(b.path) and b.path[-1].split()[0] in names for b in blocks]
    extra[:, 13] = 1
    return x


class Lstm:
    """A bidirectional LSTM with a two-way output at every block; sequences are (blocks, pages, features), padded at the end."""

    def __init__(self, inputs: int, seed: int = 5):
        r, h = np.random.default_rng(seed), UNITS
        self.w = {}
        for side in "fb":
            self.w["x" + side] = r.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * h))
            self.w["u" + side] = r.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.w["c" + side] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
            self.w["o" + side] = r.normal(0, 0.3, (h, 2))
        self.w["d"] = r.normal(0, 0.1, (inputs, 2))
        self.w["b"] = np.zeros(2)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    @staticmethod
    def flip(x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each sequence backwards, padding left at the end."""
        t = np.arange(len(x))[:, None]
        at = np.where(t < size[None, :], size[None, :] - 1 - t, t)
        return x[at, np.arange(x.shape[1])[None, :]]

    def _side(self, x: np.ndarray, side: str, mem: list | None) -> np.ndarray:
        h, w = UNITS, self.w
        inp = x @ w["x" + side] + w["c" + side]
        state = cell = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((len(x), x.shape[1], h), np.float32)
        for t in range(len(x)):
            v = inp[t] + state @ w["u" + side]
            gates = 1 / (1 + np.exp(-np.clip(v[:, : 3 * h], -30, 30)))
            new = np.tanh(v[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            old, before = cell, state
            cell = f * cell + i * new
            squashed = np.tanh(cell)
            state = out[t] = o * squashed
            if mem is not None:
                mem.append((before, old, i, f, o, new, squashed))
        return out

    def forward(self, x: np.ndarray, size: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        mems = ([], []) if keep else (None, None)
        back = self.flip(x, size)
        hf = self._side(x, "f", mems[0])
        hb = self._side(back, "b", mems[1])
        out = hf @ self.w["of"] + self.flip(hb, size) @ self.w["ob"] + x @ self.w["d"] + self.w["b"]
        return out, (hf, hb, back, mems)

    def backward(self, x: np.ndarray, size: np.ndarray, kept: tuple, d_out: np.ndarray) -> dict[str, np.ndarray]:
        hf, hb, back, mems = kept
        g = {"b": d_out.sum((0, 1)), "d": np.einsum("tbi,tbk->ik", x, d_out)}
        for side, seq, hid, d, mem in (("f", x, hf, d_out, mems[0]), ("b", back, hb, self.flip(d_out, size), mems[1])):
            g["o" + side] = np.einsum("tbh,tbk->hk", hid, d)
            dh_out = d @ self.w["o" + side].T
            dv_all = np.empty((*seq.shape[:2], 4 * UNITS), np.float32)
            dh = dc = np.zeros_like(hid[0])
            u = np.zeros_like(self.w["u" + side])
            for t in reversed(range(len(seq))):
                before, old, i, f, o, new, squashed = mem[t]
                dh = dh + dh_out[t]
                dc = dc + dh * o * (1 - squashed**2)
                dv = np.concatenate([dc * new * i * (1 - i), dc * old * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
                dv_all[t] = dv
                u += before.T @ dv
                dh, dc = dv @ self.w["u" + side].T, dc * f
            g["u" + side], g["c" + side] = u, dv_all.sum((0, 1))
            g["x" + side] = np.einsum("tbi,tbk->ik", seq, dv_all)
        return g


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in seqs])
    x = np.zeros((int(size.max()), len(seqs), seqs[0].shape[1]), np.float32)
    for k, s in enumerate(seqs):
        x[: len(s), k] = s
    return x, size


def train(pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 5) -> Lstm:
    """Adam on the mean cross entropy of all blocks of (vectors, labels)."""
    pages = [(x, y) for x, y in pages if len(x)]
    net, rng = Lstm(pages[0][0].shape[1], seed), np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in net.w.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        pick = rng.choice(len(pages), min(BATCH, len(pages)), replace=False)
        # of a long page a stretch from anywhere in it
        part = [pages[k] for k in pick]
        start = [int(rng.integers(0, max(len(p[1]) - BLOCKS, 0) + 1)) for p in part]
        part = [(p[0][a : a + BLOCKS], p[1][a : a + BLOCKS]) for p, a in zip(part, start, strict=True)]
        x, size = _padded([p[0] for p in part])
        y = np.zeros(x.shape[:2], np.int64)
        for j, p in enumerate(part):
            y[: size[j], j] = p[1]
        live = (np.arange(len(x))[:, None] < size[None, :])[:, :, None]
        out, kept = net.forward(x, size, keep=True)
        d = softmax(out, 2)
        np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
        g = net.backward(x, size, kept, (d * live / live.sum()).astype(np.float32))
        rate = 0.02 * min(1, step / 10) * (0.55 + 0.45 * np.cos(np.pi * step / steps))
        for k in net.w:
            m1[k] += 0.1 * (g[k] - m1[k])
            m2[k] += 0.01 * (g[k] ** 2 - m2[k])
            net.w[k] = (net.w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def label_by_elements(blocks: list[Block]) -> np.ndarray:
    """Training labels of a page that has an article or main element: what lies in it and in no other part's element."""
    def good(b: Block) -> bool:
        names = [label.split() for label in b.path]
        inside = [k for k, n in enumerate(names) if n[0] in GOOD]
        return bool(inside) and not any(n[0] in BAD or any(w in BAD_WORDS for w in n[1:]) for n in names[inside[0] :])

    return np.array([good(b) for b in blocks], np.int64)


def invented(count: int, seed: int = 3) -> list[tuple[list[Block], np.ndarray]]:
    """Pages made up from parts whose role is known."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    letters = np.array(list("aeiounrstlmdc"))

    def words(n: int) -> str:
        return " ".join("".join(r.choice(letters, int(r.integers(2, 9)))) for _ in range(n))

    def sentence(lo: int, hi: int) -> str:
        return words(int(r.integers(lo, hi))).capitalize() + pick([".", ".", ".", "!", "?"])

    out = []
    for _ in range(count):
        blocks: list[tuple[Block, int]] = []
        top = pick([("html", "body"), ("html", "body", "div wrapper"), ("html", "body", "div page", "div row")])

        def extra(inside: tuple[str, ...] = (), top: tuple[str, ...] = top, blocks: list = blocks) -> None:
            holder = pick([*BAD, *["div " + pick(BAD_WORDS) for _ in range(6)], "section " + pick(BAD_WORDS), "ul " + pick(BAD_WORDS)])
            path = (*top, *inside, holder)
            if holder.split()[0] in ("nav", "menu", "ul") or r.random() < 0.3:
                for _ in range(int(r.integers(1, 7))):
                    t = words(int(r.integers(1, 4)))
                    blocks.append((Block((*path, "ul", "li"), t, len(t)), 0))
            else:
                for _ in range(int(r.integers(1, 4))):
                    t = sentence(2, 30)
                    blocks.append((Block((*path, *pick([(), ("p",), ("div",)])), t, int(r.random() < 0.3) * len(t)), 0))

        for _ in range(int(r.integers(0, 4))):
            extra()
        holder = pick([("article",), ("main",), ("main", "article"), ("article " + pick(GOOD_WORDS),), ("div " + pick(GOOD_WORDS),), ("section " + pick(GOOD_WORDS),), ("div content", "div")])
        if r.random() < 0.8:
            blocks.append((Block((*top, *holder, "h1"), words(int(r.integers(2, 12))).capitalize(), 0), 1))
        for _ in range(int(r.integers(1, 14))):
            kind = r.random()
            if kind < 0.08:
                extra(holder)
            elif kind < 0.16:
                for _ in range(int(r.integers(1, 5))):
                    blocks.append((Block((*top, *holder, "ul", "li"), sentence(1, 14), 0), 1))
            elif kind < 0.24:
                blocks.append((Block((*top, *holder, pick(["h2", "h3"])), words(int(r.integers(1, 8))), 0), 1))
            else:
                blocks.append((Block((*top, *holder, *pick([("p",), ("p",), ("p",), (), ("blockquote",), ("div",), ("pre",)])), sentence(1, 60), 0), 1))
        for _ in range(int(r.integers(0, 4))):
            extra()
        out.append(([b for b, _ in blocks], np.array([y for _, y in blocks], np.int64)))
    return out


def sample(pages: DataFrame) -> list[str]:
    """At most 2 * SAMPLE pages that have an article or main element, of bounded size, chosen by a hash of their content."""
    able = pages.where(F.col("html").rlike("(?i)<(article|main)\\b") & (F.length("html") < SAMPLE_CHARS)).select("html")
    n = able.count()
    some = able.where(F.pmod(F.xxhash64("html"), F.lit(1_000_003)) < F.lit(1_000_003 * min(1.0, SAMPLE / max(n, 1))))
    return sorted(r["html"] for r in some.limit(2 * SAMPLE).collect())


def fit(pages: DataFrame) -> Lstm:
    """The labeller, from invented pages and a bounded sample of the table's."""
    examples = [(vectors(b), y) for b, y in invented(INVENTED)]
    for page in sample(pages):
        blocks = blocks_of(page)
        examples.append((vectors(blocks), label_by_elements(blocks)))
    return train(examples)


def label(net: Lstm, pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block is main text, pages of similar length side by side."""
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and stop - start < 512 and (stop - start + 1) * len(pages[order[stop]]) <= 40_000:
            stop += 1
        part = order[start:stop]
        x = vectors([b for k in part for b in pages[k]])
        cuts = np.cumsum([len(pages[k]) for k in part])[:-1]
        padded, size = _padded(np.split(x, cuts))
        result, _ = net.forward(padded, size)
        for j, k in enumerate(part):
            out[k] = result[: size[j], j, 1] > result[: size[j], j, 0]
        start = stop
    return out


def extract(pages: DataFrame, net: Lstm | None = None) -> DataFrame:
    """The input's rows and columns, with the main text in ``text`` and its code points in ``n_chars`` in place of columns of these names.

    Blocks follow page order, joined by an empty line.  Null or empty html, and
    pages without main text, give an empty text; pages of any length are read
    whole, in time that grows with their length; where both labels are as likely a
    block is left out.  Repeated rows give repeated rows with equal texts, an empty
    table no rows; other columns stay as they are, whatever their names.
    """
    net = net or fit(pages)
    rest = others(pages, "text", "n_chars")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [blocks_of(h or "") for h in batch.column("html").to_pylist()]
        texts = ["\n\n".join(b.text for b, ok in zip(p, good.tolist(), strict=True) if ok) for p, good in zip(found, label(net, found), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    return map_slices(pages.select(*quoted(rest)), fn, widened(pages, rest, "text string, n_chars long"), column="html", limit=4 << 20)
