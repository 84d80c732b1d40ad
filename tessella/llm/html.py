"""Main text of web pages: a recurrent labeller reads a page's blocks in order, forwards and backwards.

A page is cut into leaf blocks of text, each with the path of elements above it. A block's vector holds its hashed tag
path (names, classes and ids), hashed words and a few shares; two LSTMs in numpy read the sequence from either end, so
each label depends on the whole page. The model is trained once a process on pages made by a generator with a fixed seed
whose labels are known (made_pages); it has about 75,000 numbers, whatever the data, and goes with the tasks.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, texts
from .made_pages import MAIN, SIDE, made_page

# Fixed values of HTML: elements that begin and end blocks, that have no content, and whose content is not text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title noscript template svg iframe object textarea math canvas".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")
ANY = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PATH, WORDS, SHARES = 256, 96, 12
DROPPED = 0.15  #: share of hashed tokens and words that training leaves out
HIDDEN = 24


def blocks_of(html: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path, code points inside links) of each leaf block with text; an unfinished tag at the end is dropped."""
    out, stack, held, at = [], [], [], 0  # stack: (element, tokens)
    linked, link = 0, 0

    def flush():
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append((text, tuple(t for _, ts in stack for t in ts), linked))
        held.clear()
        linked = 0

    while at < len(html):
        lt = html.find("<", at)
        end = len(html) if lt < 0 else lt
        if end > at:
            text = unescape(html[at:end])
            held.append(text)
            linked += len(text) if link else 0
        if lt < 0:
            break
        if html.startswith("<!--", lt):
            done = html.find("-->", lt + 4)
            at = len(html) if done < 0 else done + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            done = html.find(">", lt)
            at = len(html) if done < 0 else done + 1
            continue
        m = TAG.match(html, lt) or ANY.match(html, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]|</?\Z", html[lt : lt + 3]):
                break  # the page ends within a tag
            held.append("<")
            at = lt + 1
            continue
        at, name, closing = m.end(), m[2].lower(), bool(m[1])
        if name in SILENT and not closing:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else len(html)
        elif name == "a":
            link = max(0, link + (-1 if closing else 1))
        elif name == "br":
            held.append(" ")
        elif name in BLOCKS:
            flush()
            link = 0
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name not in EMPTY:
                if name in ("p", "li", "td", "tr", "option", "dt", "dd") and stack and stack[-1][0] == name:
                    stack.pop()
                elif stack and stack[-1][0] == "p":
                    stack.pop()
                marks = [w for x in MARKED.findall(m[3]) for w in re.findall("[a-z]+", "".join(x).lower())]
                stack.append((name, (name, *("." + w for w in marks))))
        elif name in ("td", "th", "img"):
            held.append(" ")
    flush()
    return out


@lru_cache(maxsize=1 << 16)
def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def vectors(blocks: list) -> np.ndarray:
    out = np.zeros((len(blocks), PATH + WORDS + SHARES), np.float32)
    largest = max((len(t) for t, _, _ in blocks), default=1)
    for k, (text, path, linked) in enumerate(blocks):
        for token in path:
            out[k, _slot(token, PATH)] = 1
        leaf = path[-1] if path else ""
        out[k, _slot("leaf " + leaf, PATH)] = 1
        for w in text.lower().split():
            out[k, PATH + _slot(w, WORDS)] += 1
        out[k, PATH : PATH + WORDS] = np.log1p(out[k, PATH : PATH + WORDS]) / 3
        n = len(text)
        out[k, PATH + WORDS :] = (
            min(1, np.log1p(n) / 8), min(1, linked / n), min(1, len(text.split(None, 40)) / 40), text[-1] in ".!?:;\"'", text[:1].isupper(),
            (k + 1) / len(blocks), min(1, k / 20), min(1, (len(blocks) - k) / 20), "©" in text, min(1, len(path) / 12),
            min(1, sum(text.count(c) for c in ",.;:") / (1 + n / 40)), n / largest,
        )
    return out


class Labeller:
    """Two LSTMs and a logistic unit. Sequences are padded to one length; padding changes nothing."""

    def __init__(self, seed: int = 7):
        rng, n = np.random.default_rng(seed), PATH + WORDS + SHARES
        scale = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"wx{d}": scale(n, 4 * HIDDEN), f"wh{d}": scale(HIDDEN, 4 * HIDDEN), f"bias{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"bias{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"out": scale(2 * HIDDEN, 1), "cut": np.zeros(1, np.float32)}

    @staticmethod
    def _sig(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _read(self, x, mask, d):
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        h = np.zeros((len(x), HIDDEN), np.float32)
        c, kept, out = h, {}, np.zeros((*x.shape[:2], HIDDEN), np.float32)
        into = x @ self.p[f"wx{d}"] + self.p[f"bias{d}"]
        for t in steps:
            z = into[:, t] + h @ self.p[f"wh{d}"]
            i, f, o = (self._sig(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            new = f * c + i * g
            kept[t] = (h, c, i, f, o, g, np.tanh(new))
            h, c = m * o * kept[t][6] + (1 - m) * h, m * new + (1 - m) * c
            out[:, t] = h
        return out, kept, list(steps)

    def forward(self, x, mask):
        f, b = self._read(x, mask, "f"), self._read(x, mask, "b")
        both = np.concatenate([f[0], b[0]], axis=2)
        return self._sig((both @ self.p["out"])[..., 0] + self.p["cut"]), both, f, b

    def slopes(self, x, mask, y):
        p, both, f, b = self.forward(x, mask)
        d = ((p - y) * mask / mask.sum()).astype(np.float32)
        grad = {"out": np.tensordot(both, d, ([0, 1], [0, 1]))[:, None], "cut": d.sum(keepdims=True)[0]}
        into = d[..., None] * self.p["out"][:, 0]
        for name, (_, kept, steps), dh_all in (("f", f, into[..., :HIDDEN]), ("b", b, into[..., HIDDEN:])):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            back = np.zeros_like(self.p[f"wh{name}"])
            for t in reversed(steps):
                h, c, i, fg, o, g, tc = kept[t]
                m = mask[:, t : t + 1]
                dh = dh + dh_all[:, t]
                live, state = dh * m, dc * m
                state = state + live * o * (1 - tc**2)
                z = np.concatenate([state * g * i * (1 - i), state * c * fg * (1 - fg), live * tc * o * (1 - o), state * i * (1 - g**2)], axis=1)
                dz[:, t] = z
                back += h.T @ z
                dh = z @ self.p[f"wh{name}"].T + dh * (1 - m)
                dc = state * fg + dc * (1 - m)
            grad |= {f"wx{name}": np.tensordot(x, dz, ([0, 1], [0, 1])), f"wh{name}": back, f"bias{name}": dz.sum((0, 1))}
        return grad

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, the share of certainty that each block is main text. Pages of like length are read together."""
        out: list = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j - i + 1) * len(pages[order[j]]) <= 4096:
                j += 1
            x, mask, _ = padded([pages[k] for k in order[i:j]])
            p = self.forward(x, mask)[0]
            for r, k in enumerate(order[i:j]):
                out[k] = p[r, : len(pages[k])]
            i = j
        return out


def padded(pages: list[np.ndarray], labels: list | None = None):
    n = max(map(len, pages))
    x, mask, y = np.zeros((len(pages), n, pages[0].shape[1]), np.float32), np.zeros((len(pages), n), np.float32), np.zeros((len(pages), n), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
        if labels:
            y[k, : len(p)] = labels[k]
    return x, mask, y


def training(n: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng, pages, labels = np.random.default_rng(seed), [], []
    while len(pages) < n:
        found = [(t.replace(MAIN, "").replace(SIDE, "").strip(), p, a, MAIN in t) for t, p, a in blocks_of(made_page(rng)) if MAIN in t or SIDE in t]
        found = [x for x in found if x[0]]
        if found:
            pages.append(vectors([x[:3] for x in found]))
            labels.append(np.array([x[3] for x in found], np.float32))
    return pages, labels


@lru_cache(maxsize=1)
def trained(n: int = 2000, rounds: int = 6, seed: int = 11) -> Labeller:
    """The labeller, fitted by Adam on n made pages; the same numbers in every process."""
    pages, labels = training(n, seed)
    net, rng = Labeller(), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    order, step = np.argsort([len(p) for p in pages], kind="stable"), 0
    parts = [order[k : k + 32] for k in range(0, n, 32)]
    for r in range(rounds):
        for k in rng.permutation(len(parts)):
            x, mask, y = padded([pages[i] for i in parts[k]], [labels[i] for i in parts[k]])
            x[:, :, : PATH + WORDS] *= rng.random((*x.shape[:2], PATH + WORDS), np.float32) >= DROPPED
            grad = net.slopes(x, mask, y)
            step += 1
            rate = 0.01 if r < rounds - 2 else 0.003
            for name, g in grad.items():
                a, b = moments[name]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                net.p[name] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def main_texts(net: Labeller, pages: list[str]) -> list[str]:
    cut = [blocks_of(h) for h in pages]
    sure = net.label([vectors(b) if b else np.zeros((0, 1), np.float32) for b in cut])
    return ["\n\n".join(b[0] for b, s in zip(blocks, p, strict=True) if s >= 0.5) for blocks, p in zip(cut, sure, strict=True)]


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html), from its whole html.

    Null and empty pages, and pages without main text, have an empty text; null or repeated ids and repeated rows stay;
    an empty table gives no rows; other columns are not looked at. A row's result depends on its html alone.
    """
    net = net or trained()

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 250):
                part = b.slice(i, 250)
                found = main_texts(net, texts(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
