"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees.

Each tree splits the bins of one feature (or of one pair) at most twice on the gradient of the logistic loss and is added
to that feature's table, the features in turn, round after round; pairs follow on what the single tables leave. A
fitted model is bin edges and tables; scoring looks up a bin for each feature and adds.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, utf8

SAMPLE = 20_000  #: labelled rows that a model is fitted on at most, those with the least hash of their id
PIECE = 1 << 20
CLASSES = ("letter", "upper", "digit", "stop", "symbol", "space", "line", "other")
KIND = np.full(256, 7, np.uint8)  # controls and bytes of other characters
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "!#$%&*+/<=>@[\\]^_`{|}~", " \t", "\n\r")):
    KIND[np.frombuffer(_chars.encode(), np.uint8)] = _k
FEATURES = ("size", "lower", "upper", "digits", "stops", "symbols", "spaces", "lines", "others", "word", "short", "long", "marked", "distinct", "doubled", "packed")


def features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FEATURES of texts given as bytes end to end; all of each text is read. An empty text has zeros.

    Texts are taken PIECE bytes at a time; one that is longer is read in pieces itself, to the same numbers.
    """
    n = len(ends) - 1
    out = np.zeros((n, len(FEATURES)))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PIECE, side="right")) - 1)
        part = data[ends[i] : ends[j]]
        out[i:j] = _features(part, ends[i : j + 1] - ends[i]) if len(part) <= PIECE else _long_features(part)
        i = j
    return out


def _long_features(data: np.ndarray) -> np.ndarray:
    """_features of one text, read in pieces."""
    n, sums, kinds = len(data), np.zeros(5), np.zeros(8)  # of words: number, bytes, short, long, marked
    hashes, doubled, before, packer, size = [], 0, None, zlib.compressobj(1), 0
    tail = rest = b""
    for at in range(0, n + 1, PIECE):
        piece = data[at : at + PIECE]
        done = at + PIECE > n
        kinds += np.bincount(KIND[piece], minlength=8)
        size += len(packer.compress(piece.tobytes()))
        raw = tail + piece.tobytes()  # words by spaces, tabs and line ends
        tail = b"" if done else raw[len(raw.rstrip(b" \t\r\n")) and max(raw.rfind(c) for c in (b" ", b"\t", b"\r", b"\n")) + 1 :]
        words = re.findall(rb"[^ \t\r\n]+", raw[: len(raw) - len(tail)])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sums += (len(words), lengths.sum(), (lengths <= 3).sum(), (lengths > 12).sum(), sum(KIND[w[-1]] == 4 for w in words))
        raw = rest + piece.tobytes()  # words by all white space
        split = raw.split()
        rest = b"" if done or not split or raw[-1:].isspace() else split.pop()
        hashes.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split))))
        if split:
            doubled += sum(map(eq, split, split[1:])) + (before == split[0])
            before = split[-1]
    packed = size + len(packer.flush())
    words = max(1, sums[0])
    distinct = len(np.unique(np.concatenate(hashes)))
    return np.array([np.log1p(n), *(kinds / n), *(sums[1:] / words), distinct / words**0.9, doubled / words, packed / (n + 40)])


def _features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n, size = len(ends) - 1, np.diff(ends)
    row = np.repeat(np.arange(n), size)
    kind = KIND[data]
    counts = np.bincount(row * 8 + kind, minlength=8 * n).reshape(n, 8)
    word = (kind != 5) & (kind != 6)
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | (row[1:] != row[:-1])
    end[:-1] &= ~word[1:] | (row[1:] != row[:-1])
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    length, of = e - s + 1, row[s]
    per = lambda w=None: np.bincount(of, weights=w, minlength=n)
    words = np.maximum(per(), 1)
    share = counts / np.maximum(size, 1)[:, None]
    distinct, doubled, packed = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        text = data[ends[k] : ends[k + 1]].tobytes()
        if text:
            split = text.split()
            distinct[k] = len(set(split)) / words[k] ** 0.9
            doubled[k] = sum(map(eq, split, split[1:])) / words[k]
            packed[k] = len(zlib.compress(text, 1)) / (len(text) + 40)
    return np.column_stack([np.log1p(size), share, per(length) / words, per(length <= 3) / words, per(length > 12) / words, per(kind[e] == 4) / words, distinct, doubled, packed])


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    grids: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, k], side="right")]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Best split of bins with gradients g and weights h: its gain, and the first bin on the right."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> np.ndarray:
    """Values for each bin of a tree with at most two splits: the best one, then the best within either side."""
    gain, at = _cut(g, h, least)
    if gain <= 0:
        return np.zeros(len(g))
    parts = [(0, at), (at, len(g))]
    (gl, kl), (gr, kr) = (_cut(g[a:b], h[a:b], least) for a, b in parts)
    if max(gl, gr) > 0:
        parts = [(0, kl), (kl, at), parts[1]] if gl >= gr else [parts[0], (at, at + kr), (at + kr, len(g))]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, n_pairs: int = 6) -> Model:
    """Fits a model; without rows, or with one label only, it is the share of label 1 for every text."""
    width = x.shape[1]
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    model = Model(base, [np.zeros(0)] * width, [np.zeros(1)] * width, [], [np.zeros(0)] * width, [])
    if len(np.unique(y)) < 2:
        return model
    cuts = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
    model.edges = [cuts(x[:, k], bins) for k in range(width)]
    model.coarse = [cuts(x[:, k], 8) for k in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.coarse)]
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(width):
            g, h = slopes()
            n = len(model.tables[k])
            step = rate * _tree(np.bincount(at[k], g, n), np.bincount(at[k], h, n))
            model.tables[k] += step
            total += step[at[k]]
    g, h = slopes()
    found = []
    for a in range(width):
        for b in range(a):
            cell = rough[a] * 16 + rough[b]
            s, w = np.bincount(cell, g, 256), np.bincount(cell, h, 256)
            found.append((float((s**2 / (w + 1)).sum()), a, b))
    for _, a, b in sorted(found, reverse=True)[:n_pairs]:
        model.pairs.append((a, b))
        model.grids.append(np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)))
    for _ in range(rounds // 3):
        for (a, b), grid in zip(model.pairs, model.grids, strict=True):
            g, h = slopes()
            cell = rough[a] * grid.shape[1] + rough[b]
            s, w = (np.bincount(cell, v, grid.size).reshape(grid.shape) for v in (g, h))
            if _cut(s.sum(1), w.sum(1), 1)[0] >= _cut(s.sum(0), w.sum(0), 1)[0]:  # split the first feature, then the second on each side
                k = _cut(s.sum(1), w.sum(1), 1)[1]
                step = np.concatenate([np.tile(_tree(s[r].sum(0), w[r].sum(0)), (len(s[r]), 1)) for r in (slice(0, k), slice(k, None)) if len(s[r])])
            else:
                k = _cut(s.sum(0), w.sum(0), 1)[1]
                step = np.concatenate([np.tile(_tree(s[:, r].sum(1), w[:, r].sum(1))[:, None], (1, s[:, r].shape[1])) for r in (slice(0, k), slice(k, None)) if s[:, r].shape[1]], axis=1)
            grid += rate * step
            total += rate * step.ravel()[cell]
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of `quality` fitted on at most `sample` labelled documents that are not held out.

    Of several labels of an id the least counts, of several documents of an id the least text; null labels and ids, and
    labels without a document, do not. Only whole texts are looked at: no id, source or language.
    """
    known = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for b in batches:
            x = features(*utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])

    named = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # known: at most `sample` rows
    named = named.groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("r")).select("r.quality", "r.text")
    rows = named.mapInArrow(run, "quality int, x array<double>").toArrow()
    x = np.array(rows.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows.column(0).to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same sums whatever the order of rows
    return fit(x[order], y[order])


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, keep_rejected: bool = True, scores: bool = True) -> DataFrame:
    """docs with `score` and `predicted` (1: score >= threshold); or, without scores, docs alone; rejected rows may go.

    Null and empty texts are scored as texts of no bytes. With scores, columns of docs named score or predicted are
    replaced. Rows stay apart whatever their ids; an empty table gives no rows.
    """
    docs = docs.drop("score", "predicted") if scores else docs
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            score = model.score(features(*utf8(b.column(at))))
            good = (score >= threshold).astype(np.int32)
            cols = [*b.columns, *((pa.array(score), pa.array(good)) if scores else ())]
            out = pa.RecordBatch.from_arrays(cols, names=[*names, *(("score", "predicted") if scores else ())])
            yield out if keep_rejected else out.filter(pa.array(good == 1))

    schema = docs.schema
    if scores:
        schema = type(schema)(list(schema.fields)).add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(run, schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, read(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
