"""Main text of HTML pages by a recurrent block labeller (operator 4).

A page is cut into blocks, the runs of text between block-level tags. A bidirectional LSTM in
numpy reads the page's blocks in order, each as hashed counts of its tag path (tags and their class,
id and role words), of its words, and of its size and links, and labels every block with the whole
page as context. It is trained on a bounded sample of pages (``SAMPLE``) with labels from what the
markup says (article, main, nav, footer, ...), into whose block sequences furniture of known kinds
is mixed, so that kinds the sample lacks are known too.

Results in edge cases: null and empty pages, and pages without main text, have the text "" and
n_chars 0. Null page_ids and urls and repeated rows are kept as they are. A ``<`` that starts no tag
is text; tags left open end with what holds them. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credscan.llm.words import word_hashes

#: Pages that the labeller is fitted on, and the size that they have at most.
SAMPLE, SAMPLE_CHARS = 160, 100_000
PATH, WORD, HIDDEN = 384, 32, 16
#: Under this salt all names of the lists below have places of their own.
SALT = (176).to_bytes(4, "little")
EPOCHS, BATCH, RATE = 50, 16, 0.02

_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Skipped up to their end tag. Without one, what follows a script or style is part of it; of the others only the tag goes.
_RAW = frozenset("script style textarea noscript iframe template svg title".split())
#: Read as if they were not there: what they hold is the page's own text.
_CLEAR = frozenset("object canvas math".split())
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
#: Tags and words of class, id or role that hold no main text.
FURNITURE = tuple("nav header footer aside form menu button select dialog fieldset head".split())
NOISE = tuple(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup "
    "promo promoted recommended related reply replies search share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "tags toolbar widget complementary contentinfo search".split()
)
#: Tags and words that hold it.
CONTENT = tuple("article main".split())
MAIN = tuple("article articlebody body content entry main post story text".split())


class Block:
    """A run of text: its path (tags, and words of their attributes), and characters in all and in links."""

    __slots__ = ("linked", "path", "size", "text")

    def __init__(self, path: list[str], parts: list[str], linked: int) -> None:
        self.path = path
        self.text = " ".join(html.unescape("".join(parts)).split())
        self.size, self.linked = len(self.text), linked


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with white space reduced and character references decoded."""
    found: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            block = Block([x for _, names in stack for x in names], parts, linked)
            if block.text:
                found.append(block)
            parts.clear()
        linked = 0

    at, lowered = 0, None
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in _CLEAR:
            continue
        if name in _RAW and not closing:
            if not attributes.endswith("/") or name != "svg":
                lowered = lowered if lowered is not None else page.lower()
                end = lowered.find(f"</{name}", at) if len(lowered) == len(page) else _end(page, name, at)
                at = end if end >= 0 else len(page) if name in ("script", "style") else at
            if name in ("title",):
                flush()
            continue
        if name in _BLOCK or name == "br":
            if name == "br":
                parts.append(" ")
                continue
            flush()
        if name in _VOID:
            continue
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in _BLOCK:  # a block ends an open paragraph, an item or cell its like
            for k in range(len(stack) - 1, -1, -1):
                open_ = stack[k][0]
                if open_ == "p" or open_ == name and name in ("li", "dd", "dt", "tr", "td", "th", "option"):
                    del stack[k:]
                    break
                if open_ in _BLOCK:
                    break
        words = [w for v in _NAMES.findall(attributes) for w in _PART.findall("".join(v).lower())] if attributes else []
        stack.append((name, [name, *(f".{w}" for w in words)]))
    flush()
    return found


def _end(page: str, name: str, at: int) -> int:
    m = re.compile(f"</{name}", re.I).search(page, at)
    return m.start() if m else -1


def _hash(name: str, cache: dict[str, int] = {}) -> int:  # noqa: B006
    if name not in cache:
        if len(cache) > 100_000:
            cache.clear()
        cache[name] = int.from_bytes(blake2b(name.encode(), digest_size=8, salt=SALT).digest(), "little") % PATH
    return cache[name]


def features(sequence: list[Block]) -> np.ndarray:
    """One row per block: path, words, size, share of links, place."""
    n = len(sequence)
    out = np.zeros((n, PATH + WORD + 4), np.float32)
    for i, b in enumerate(sequence):
        for x in b.path:
            out[i, _hash(x)] = 1
    hashes, bounds = word_hashes(pa.array([b.text for b in sequence], pa.string()))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    words = np.bincount(owner * WORD + (hashes >> np.uint64(59)).astype(np.int64), minlength=n * WORD).reshape(n, WORD)
    out[:, PATH : PATH + WORD] = words / np.maximum(1, words.sum(1, keepdims=True))
    size = np.array([b.size for b in sequence], float)
    out[:, -4] = np.log1p(size) / 8
    out[:, -3] = np.minimum(1, np.array([b.linked for b in sequence]) / np.maximum(1, size))
    out[:, -2] = np.arange(n) / max(1, n)
    out[:, -1] = 1
    return out


def marked(sequence: list[Block]) -> np.ndarray:
    """What the markup says of each block: 1 main text, 0 not."""
    paths = [set(b.path) for b in sequence]
    noise = [any(x in p for x in FURNITURE) or any(f".{x}" in p for x in NOISE) for p in paths]
    for i, p in enumerate(paths):  # the header of an article is its own
        if noise[i] and "article" in p and "header" in p and not any(x in p for x in FURNITURE if x != "header"):
            noise[i] = any(f".{x}" in p for x in NOISE if x != "header")
    inside = [any(x in p for x in CONTENT) for p in paths]
    if not any(i and not n for i, n in zip(inside, noise, strict=True)):
        inside = [any(f".{x}" in p for x in MAIN) for p in paths]
    if not any(i and not n for i, n in zip(inside, noise, strict=True)):
        inside = [b.linked * 2 < b.size and bool(p & {"p", "h1", "h2", "h3", "li", "pre", "blockquote", "td"}) for b, p in zip(sequence, paths, strict=True)]
    return np.array([i and not n for i, n in zip(inside, noise, strict=True)], np.float32)


#: What stands for a page's content element, what may wrap parts of it, and what its blocks may be.
_HOLDERS = (["article"], ["main"], ["main", "article"], ["div", ".content"], ["div", ".post"], ["div", ".entry", ".content"], ["section", ".story"])
_WRAPS = ([], ["div"], ["section"], ["header"], ["figure"], ["blockquote"], ["div", "div"])
_LEAVES = (["p"], ["p", "b"], ["p", "a"], ["h1"], ["h2"], ["h3"], ["ul", "li"], ["ol", "li"], ["pre"], ["blockquote"], ["td"], ["div"], ["span"], ["figcaption"], ["dl", "dd"])
_NOISY = ("div", "section", "p", "ul", "span", "aside", "ol", "table")


def mixed_in(sequence: list[Block], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A variant of a page: content under other elements, and furniture of random kinds among its blocks.

    Furniture is worded with the page's own words, so that words alone don't give it away.
    """

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def like(block: Block, path: list[str]) -> Block:
        new = Block(path, [""], 0)
        new.text, new.size, new.linked = block.text, block.size, block.linked
        return new

    out, out_labels = list(sequence), list(labels)
    if rng.random() < 0.5:
        holder = pick(_HOLDERS)
        for i, (b, y) in enumerate(zip(sequence, labels, strict=True)):
            if y and rng.random() < 0.9:
                wrap = pick(_WRAPS) if rng.random() < 0.3 else []
                leaf = pick(_LEAVES) if rng.random() < 0.5 else b.path[-1:]
                out[i] = like(b, ["html", "body", *holder, *wrap, *leaf])
    for _ in range(int(rng.integers(0, 6))):
        at = int(rng.integers(0, len(out) + 1))
        near = out[min(at, len(out) - 1)] if out else Block(["html", "body", "p"], ["x"], 0)
        base = near.path[:-1] if rng.random() < 0.6 else ["html", "body"]
        if rng.random() < 0.4:
            names = [pick([x for x in FURNITURE if x not in ("header", "head")])]
        elif rng.random() < 0.1:
            base, names = ["html", "body"], ["header"]
        else:
            names = [pick(_NOISY), f".{pick(NOISE)}", *([f".{pick(('box', 'list', 'wrapper', 'area', 'block', 'item'))}"] if rng.random() < 0.4 else [])]
        tail = pick(_LEAVES) if rng.random() < 0.8 else []
        words = pick(out).text.split() if out else ["x"]
        for k in range(int(rng.integers(1, 4))):
            start = int(rng.integers(0, max(1, len(words) - 3)))
            text = " ".join(words[start : start + int(rng.integers(1, 40))]) or "x"
            out.insert(at + k, Block(base + names + tail, [text], len(text) if "li" in tail and rng.random() < 0.5 else 0))
            out_labels.insert(at + k, 0.0)
    return out, np.array(out_labels, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, inputs: int = PATH + WORD + 4, hidden: int = HIDDEN) -> None:
        rng = np.random.default_rng(5)
        self.hidden = hidden
        if weights is None:
            weights = {"out": rng.normal(0, 0.1, (2 * hidden + 1,))}
            for d in "fb":
                weights[f"x{d}"] = rng.normal(0, 0.1, (inputs, 4 * hidden))
                weights[f"h{d}"] = rng.normal(0, 0.1, (hidden, 4 * hidden))
        self.weights = {k: v.astype(np.float32) for k, v in weights.items()}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """Hidden states of one direction, in its reading order; x is (time, page, input) in page order."""
        n = self.hidden
        gates = (x.reshape(-1, x.shape[2]) @ self.weights[f"x{d}"]).reshape(*x.shape[:2], -1)
        if d == "b":
            gates, mask = gates[::-1], mask[::-1]
        h = c = np.zeros((x.shape[1], n), np.float32)
        states, history = np.empty((*x.shape[:2], n), np.float32), []
        for t in range(len(x)):
            g = gates[t] + h @ self.weights[f"h{d}"]
            i, f, o, u = _sigmoid(g[:, :n]), _sigmoid(g[:, n : 2 * n] + 1), _sigmoid(g[:, 2 * n : 3 * n]), np.tanh(g[:, 3 * n :])
            m = mask[t][:, None]
            c_new = f * c + i * u
            tanh = np.tanh(c_new)
            if keep:
                history.append((h, c, i, f, o, u, tanh, m))
            h, c = np.where(m, o * tanh, h), np.where(m, c_new, c)
            states[t] = h
        return states, history

    def probabilities(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        forward, past = self._run("f", x, mask, keep)
        backward, future = self._run("b", x, mask, keep)
        both = np.concatenate([forward, backward[::-1], np.ones((*x.shape[:2], 1), np.float32)], 2)
        return _sigmoid(both @ self.weights["out"]), both, past, future

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all blocks."""
        p, both, past, future = self.probabilities(x, mask, True)
        error = (p - labels) * mask / max(1, mask.sum())
        n = self.hidden
        found = {"out": np.einsum("tp,tpk->k", error, both)}
        into = error[:, :, None] * self.weights["out"]
        for d, history, inputs, upper in (("f", past, x, into[:, :, :n]), ("b", future, x[::-1], into[::-1, :, n : 2 * n])):
            dx, dh_weights = np.zeros_like(self.weights[f"x{d}"]), np.zeros_like(self.weights[f"h{d}"])
            dh = dc = np.zeros((x.shape[1], n), np.float32)
            for t in range(len(x) - 1, -1, -1):
                h, c, i, f, o, u, tanh, m = history[t]
                dh = dh + upper[t]
                own = np.where(m, dh, 0)
                dc_new = np.where(m, dc, 0) + own * o * (1 - tanh**2)
                dg = np.concatenate([
                    dc_new * u * i * (1 - i), dc_new * c * f * (1 - f), own * tanh * o * (1 - o), dc_new * i * (1 - u**2)
                ], 1)
                dx += inputs[t].T @ dg
                dh_weights += h.T @ dg
                dh = np.where(m, dg @ self.weights[f"h{d}"].T, dh)
                dc = np.where(m, dc_new * f, dc)
            found[f"x{d}"], found[f"h{d}"] = dx, dh_weights
        return found

    def label(self, sequences: list[np.ndarray], at_once: int = 4096) -> list[np.ndarray]:
        """The probability of each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and (upto - at + 1) * len(sequences[order[upto]]) <= at_once:
                upto += 1
            group = order[at:upto]
            x, mask = padded([sequences[i] for i in group])
            p = self.probabilities(x, mask)[0]
            for k, i in enumerate(group):
                out[i] = p[: len(sequences[i]), k]
            at = upto
        return out


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, sequences))
    x = np.zeros((longest, len(sequences), sequences[0].shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for k, s in enumerate(sequences):
        x[: len(s), k], mask[: len(s), k] = s, True
    return x, mask


def fit(sample: list[str]) -> Labeller:
    """A labeller from pages, by Adam on cross-entropy."""
    rng = np.random.default_rng(11)
    model = Labeller()
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    sequences = [s for s in map(blocks, sample) if s]
    own = [marked(s) for s in sequences]
    step = 0
    for epoch in range(EPOCHS if sequences else 0):
        rate = RATE * (1 - epoch / EPOCHS) ** 1.5
        pages = [mixed_in(s, y, rng) if rng.random() < 0.7 else (s, y) for s, y in zip(sequences, own, strict=True)]
        pages = [(s[k : k + 80], y[k : k + 80]) for s, y in pages for k in (int(rng.integers(0, max(1, len(s) - 80))),)]
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        for k in rng.permutation(np.arange(0, len(pages), BATCH)):
            group = order[k : k + BATCH]
            x, mask = padded([features(pages[i][0]) for i in group])
            labels = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(group):
                labels[: len(pages[i][1]), j] = pages[i][1]
            step += 1
            for name, g in model.gradients(x, mask, labels).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                model.weights[name] = (model.weights[name] - rate * move).astype(np.float32)
    return model


def trained(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """A labeller fitted on the ``sample`` pages of least hash, a draw that no order of rows affects.

    A share of the pages, eight samples large, goes into the draw, so partitions send few to the driver.
    """
    share = min(1.0, 8 * sample / max(1, pages.count()))
    drawn = F.pmod(F.xxhash64("page_id", "html", F.lit("draw")), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = pages.where((F.length("html") > 0) & (F.length("html") <= SAMPLE_CHARS) & drawn)
    drawn = rows.orderBy(F.xxhash64("page_id", "html"), "html").select("html").limit(sample).collect()
    return fit([r["html"] for r in drawn])


def _texts(model: Labeller, column: pa.Array) -> Iterator[str]:
    for at in range(0, len(column), 256):
        sequences = [blocks(t or "") for t in column.slice(at, 256).to_pylist()]
        flat = features([b for s in sequences for b in s]) if any(sequences) else np.zeros((0, 1))
        ends = np.cumsum([0, *map(len, sequences)])
        inputs = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own = flat[a:b]
            if len(own):
                own[:, -2] = np.arange(len(own)) / len(own)
            inputs.append(own)
        for s, p in zip(sequences, model.label(inputs), strict=True):
            yield "\n".join(b.text for b, x in zip(s, p, strict=True) if x >= 0.5)


def main_text(model: Labeller, page: Column, spark: SparkSession) -> Column:
    """The main text of an HTML column."""
    shared = spark.sparkContext.broadcast(model.weights)  # of fixed size

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(_texts(Labeller(shared.value), column), pa.string())

    return run(page)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    found = pages.select("page_id", "url", main_text(trained(pages), pages["html"], spark).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
