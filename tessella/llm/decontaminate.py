"""Benchmark decontamination: a BM25 index of the test items, searched for each training passage by block-max WAND.

Items are few and the index goes to the executors; more than BLOCK bytes of them are taken in blocks, each with its own
index and pass, but the term statistics are those of all items, so a block scores as one index would. Passages are overlapping windows of words over the whole text. Impacts are divided by an item's score for
its own text, so one threshold serves items of all lengths. Frequent terms, which cannot reach a fifth of it in any item, are
set apart: a window whose other words' largest impacts add up to the rest in no range of items needs no search. What is retrieved is verified on the words: question and answer must both be there.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, texts, written

K1, B = 1.2, 0.75
POSTINGS = 32  #: postings of a block
RANGES = 512  #: ranges of items that windows are bounded by
BLOCK = 16 << 20  #: bytes of items for one index
EMPTY, SPACE = b"", b" "  #: no words: the rows of counts among the terms
TABLE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(TABLE).split()


@dataclass(frozen=True)
class Terms:
    """Of all items with words: how many, their mean length, and how many hold each term."""

    n: int
    mean: float
    held: dict[bytes, int]


class Index:
    """items: (id, text). Items without words are left out. terms: the statistics of more items than these."""

    def __init__(self, items: list[tuple], threshold: float, overlap: float, terms: Terms | None = None):
        self.threshold, self.overlap = threshold, overlap
        self.ids, self.words, self.question = [], [], []
        for i, text in items:
            words = words_of(text or "")
            if words:
                last = [x for x in (text or "").replace("\n", ". ").replace("?", ".").replace("!", ".").split(". ") if words_of(x)]
                answer = len(words_of(last[-1])) if len(last) > 1 else 0
                self.ids.append(i)
                self.words.append(words)
                self.question.append(len(words) - (answer if 0 < answer < len(words) else max(1, len(words) // 4)))
        n = len(self.ids)
        terms = terms or Terms(n, sum(map(len, self.words)) / max(1, n), Counter(t for w in self.words for t in set(w)))
        held, mean = terms.held, terms.mean
        raw = [{t: math.log(1 + (terms.n - held[t] + 0.5) / (held[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()} for w in self.words]
        postings: dict[bytes, list] = {}
        for k, impacts in enumerate(raw):
            whole = sum(impacts.values())
            for t, x in impacts.items():
                postings.setdefault(t, []).append((k, x / whole))
        self.docs = {t: [k for k, _ in p] for t, p in postings.items()}
        self.impacts = {t: [x for _, x in p] for t, p in postings.items()}
        self.blocks = {t: [max(x[s : s + POSTINGS]) for s in range(0, len(x), POSTINGS)] for t, x in self.impacts.items()}
        self.most = {t: max(x) for t, x in self.impacts.items()}
        # Terms of many items that add up to no more than a fifth of the threshold in any: a window needs the rest from others.
        common = np.zeros(n)
        self.rare = {}
        for t in sorted(self.docs, key=lambda t: (-len(self.docs[t]), t)):
            grown = common.copy()
            grown[self.docs[t]] += self.impacts[t]
            if grown.max() <= threshold / 5 and not self.rare:
                common = grown
            else:
                self.rare[t] = len(self.rare)
        self.least = threshold - float(common.max(initial=0.0))
        # The largest impact of each other term in each range of items, as arrays: term r has entries first[r] to first[r + 1].
        self.ranges = min(n, RANGES)
        per = -(-n // max(1, self.ranges))
        largest: dict[int, dict[int, float]] = {r: {} for r in self.rare.values()}
        for t, r in self.rare.items():
            for k, x in zip(self.docs[t], self.impacts[t], strict=True):
                largest[r][k // per] = max(x, largest[r].get(k // per, 0.0))
        self.first = np.cumsum([0, *(len(largest[r]) for r in range(len(largest)))])
        self.range_of = np.array([k for r in range(len(largest)) for k in largest[r]], np.int64)
        self.upper = np.array([x for r in range(len(largest)) for x in largest[r].values()])
        self.width = max(64, max(map(len, self.words), default=0))
        self.grams = [self.five(w) for w in self.words]

    @staticmethod
    def five(words: list[bytes]) -> set:
        return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    def search(self, terms) -> list[tuple[int, float]]:
        """Items that score at least the threshold for a set of terms: block-max WAND."""
        cursors = [[self.docs[t][0], 0, t] for t in terms if t in self.docs]
        found, limit = [], self.threshold - 1e-12
        while cursors:
            cursors.sort(key=lambda c: c[0])
            upper, pivot = 0.0, None
            for c in cursors:
                upper += self.most[c[2]]
                if upper >= limit:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            here = [c for c in cursors if c[0] <= pivot]
            bound = 0.0
            for c in here:
                at = bisect_left(self.docs[c[2]], pivot, c[1])
                if at < len(self.docs[c[2]]):
                    bound += self.blocks[c[2]][at // POSTINGS]
            if bound < limit:  # no item up to the end of the nearest of these blocks can do
                ends = [self.docs[c[2]][min(len(self.docs[c[2]]), (bisect_left(self.docs[c[2]], pivot, c[1]) // POSTINGS + 1) * POSTINGS) - 1] for c in here]
                after = [c[0] for c in cursors if c[0] > pivot]
                target = max(pivot + 1, min([max(e, pivot) + 1 for e in ends] + after))
            elif here[0][0] == pivot:
                score = sum(self.impacts[c[2]][c[1]] for c in here)
                if score >= limit:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            rest = []
            for c in cursors:
                if c[0] < target:
                    docs = self.docs[c[2]]
                    c[1] = bisect_left(docs, target, c[1])
                    if c[1] == len(docs):
                        continue
                    c[0] = docs[c[1]]
                rest.append(c)
            cursors = rest
        return found

    def hopeful(self, words: list[bytes], half: int) -> list[int]:
        """Windows, of half k and half k + 1, where the largest impacts in some range of items reach the threshold."""
        get = self.rare.get
        term = np.array([get(w, -1) for w in words], np.int64)
        at, size, n = np.flatnonzero(term >= 0), len(self.rare), max(1, -(-len(words) // half) - 1)
        term, at = term[at], at // half
        held = np.unique(np.concatenate([at[at < n] * size + term[at < n], (at[at > 0] - 1) * size + term[at > 0]]))  # each term of a window once
        window, term = held // max(1, size), held % max(1, size)
        many = self.first[term + 1] - self.first[term]
        entry = np.repeat(self.first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        sums = np.bincount(np.repeat(window, many) * self.ranges + self.range_of[entry], self.upper[entry], n * self.ranges).reshape(n, -1)
        return np.flatnonzero(sums.max(1) >= self.least - 1e-9).tolist()

    def verify(self, item: int, near: list[bytes]) -> tuple[float, float, float]:
        """Shares of the item's five-word runs, of its question's and of its answer's words that the text near a match has."""
        runs = self.grams[item]
        size = min(5, len(self.words[item]))
        there = {b" ".join(near[k : k + size]) for k in range(len(near) - size + 1)}
        have, q = set(near), self.question[item]
        share = lambda ws: sum(w in have for w in ws) / max(1, len(ws))
        return len(runs & there) / len(runs), share(self.words[item][:q]), share(self.words[item][q:])

    def leaks(self, text: str) -> dict[int, tuple[float, float, float, float]]:
        """Item number: score, and the shares that verify gives, of every item that is in the text."""
        words = words_of(text)
        if not words or not self.ids:
            return {}
        half = self.width // 2
        out: dict[int, tuple] = {}
        step = 2048 * half  # so that a long text's sums stay small; parts overlap by half a window
        for k in (b // half + k for b in range(0, len(words), step) for k in self.hopeful(words[b : b + step + half], half)):
            s = k * half
            for item, score in self.search(set(words[s : s + 2 * half])):
                near = words[max(0, s - self.width) : s + 2 * half + self.width]
                runs, question, answer = self.verify(item, near)
                if runs >= self.overlap and question >= self.overlap and answer >= self.overlap and (item not in out or score > out[item][0]):
                    out[item] = (score, runs, question, answer)
        return out


def _terms(items: DataFrame, block: Column) -> DataFrame:
    """(term, n, blocks): how many items hold a term, and in which blocks; the counts of items and of words come as EMPTY, SPACE."""

    def run(batches):
        for b in batches:
            found = Counter()
            for k, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                words = words_of(text)
                found.update((k, t) for t in set(words))
                if words:
                    found[k, EMPTY] += 1
                    found[k, SPACE] += len(words)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["block", "term", "n"])

    each = items.select(block.cast("long").alias("block"), "text").mapInArrow(run, "block long, term binary, n long")
    return each.groupBy("term").agg(F.sum("n").alias("n"), F.collect_set("block").alias("blocks"))


def indexes(benchmark: DataFrame, threshold: float, overlap: float, block: int = BLOCK) -> Iterator[tuple[Index, bool]]:
    """Indexes of the items (item_id, text), each of about `block` bytes of text, one at a time, and whether it is the last."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block + 1
    items = benchmark.select("item_id", "text").where("text is not null")
    of = F.pmod(F.xxhash64("text"), F.lit(blocks))
    terms = written(_terms(items, of), "terms") if blocks > 1 else None
    total = {bytes(r["term"]): r["n"] for r in terms.where("term in (X'', X'20')").collect()} if blocks > 1 else {}
    for k in range(blocks):
        rows = items.where(of == k).collect()
        stats = None
        if terms is not None:
            held = {bytes(r["term"]): r["n"] for r in terms.where(F.array_contains("blocks", F.lit(k).cast("long"))).select("term", "n").collect()}
            stats = Terms(total.get(EMPTY, 0), total.get(SPACE, 0) / max(1, total.get(EMPTY, 0)), held)
        yield Index(sorted(((r[0], r[1]) for r in rows), key=lambda r: (str(r[0]), r[1])), threshold, overlap, stats), k + 1 == blocks


LEAKS = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6, block: int = BLOCK) -> DataFrame:
    """A row of LEAKS for each document (doc_id, text) and each item (item_id, text) that it holds.

    Null and empty texts hold none and null items are not looked for; repeated rows and ids each count; an empty table
    on either side gives no rows; other columns are not looked at. Whole texts are searched. With several blocks of items
    each pass is written before the next index is made, so the driver holds one at a time.
    """
    out = None
    for index, last in indexes(benchmark, threshold, overlap, block):

        def run(batches, index=index):
            for b in batches:
                rows = [(d, index.ids[i], *x) for d, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True) for i, x in index.leaks(t).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.float64()) for k in range(6)], names=[x.split()[0] for x in LEAKS.split(", ")])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LEAKS)
        part = part if last else written(part, "leaks")
        out = part if out is None else out.unionAll(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6, block: int = BLOCK) -> DataFrame:
    """docs without the rows whose text holds an item of the benchmark; nulls, empties, repeats as in contaminated()."""
    at = docs.columns.index("text")
    for index, last in indexes(benchmark, threshold, overlap, block):

        def run(batches, index=index):
            for b in batches:
                yield b.filter(pa.array([not index.leaks(t) for t in texts(b.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = docs if last else written(docs, "clean")
    return docs


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
