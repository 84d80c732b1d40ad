"""SimHash near-dedup with pivot distance tables.

Documents give 64-bit fingerprints; equal ones are grouped first, by map-side minimums, so copies cost one fingerprint.
Fingerprints within a radius meet under a key of bits that they share. Under a key a table holds their Hamming distances
to reference fingerprints (pivots). By the triangle inequality two fingerprints within the radius differ by no more than
it in any coordinate: sorted by the first, each is held against a window, then against the largest coordinate
difference, and the survivors against the Hamming distance itself. Under a key only a spanning star of each linked
group is given on, so links grow with the number of fingerprints, and components are found by distributed star steps.

Keys: for a radius up to 4 the bits are cut in blocks, and every choice of blocks that can be free of differing bits is
a key, so no link is lost (exact). For a larger radius, as similarity 0.8 needs, keys are fixed random choices of bits;
they join the bulk of large groups only. A second way is exact: texts that similar share one of their rarest shingles
(prefix filter), and every pair that meets there in two components, and that no bound rules out, is verified.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWEST, components, discard, groups, read, run_starts, texts, utf8, written

SPREAD = np.array([int.from_bytes(bytes((b >> k) & 1 for k in range(8)), "little") for b in range(256)], np.uint64)
STEP = 200_000  # shingles at a time
PAIRS = 1 << 17  # pairs of fingerprints or sets that are compared at a time
ROWS = 1000  # texts at a time
PIVOTS = 24


PIECE = 1 << 20  #: bytes of a text that are cut into words at a time


def _runs(split: list[bytes], words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, of which there are as many at least."""
    plain = b" ".join(split)
    ends = np.cumsum([len(w) + 1 for w in split]) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(split) - words + 1]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(plain[s:e], 42) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def shingle_pieces(data: bytes, words: int) -> Iterator[np.ndarray]:
    """shingle_hashes of a text, piece by piece: a long one is never held as words."""
    held, tail, some = [], b"", False
    for at in range(0, len(data), PIECE):
        raw = tail + data[at : at + PIECE].lower()
        split = raw.split()  # at bytes 9 to 13 and 32
        tail = b"" if at + PIECE >= len(data) or not split or raw[-1:].isspace() else split.pop()
        held += split
        if len(held) >= words:
            yield _runs(held, words)
            held, some = held[len(held) - words + 1 :], True
    if held and not some:
        yield _runs(held, len(held))


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, lower case A-Z, repeats included; of all words if there are fewer."""
    parts = list(shingle_pieces(data, words))
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def fingerprint(data: bytes, words: int = 3) -> int:
    """Bit k is 1 if it is set in more than half of the shingle hashes; no words: 0."""
    return fold(shingle_pieces(data, words))


def fold(parts: Iterable[np.ndarray]) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        n += len(h)
        for at in range(0, len(h), STEP):
            part = h[at : at + STEP].view(np.uint8).reshape(-1, 8)
            for k in range(8):  # eight byte-wide counters in a word, 255 rows at most before they overflow
                spread = SPREAD[part[:, k]]
                sums = np.add.reduceat(spread, np.arange(0, len(spread), 255))
                counts[8 * k : 8 * k + 8] += sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(counts * 2 > n).tolist()))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row of docs (doc_id, text). Null and empty texts have 0, repeated rows and ids stay, an
    empty table gives no rows, and other columns are not looked at."""

    def run(batches):
        for b in sliced(batches):
            data, ends = utf8(b.column(1))
            fps = np.array([fingerprint(data[s:e].tobytes(), words) for s, e in itertools.pairwise(ends.tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def masks_for(radius: int, tables: int = 160, bits: int = 18) -> list[int]:
    """Bit masks of keys: choices of blocks for a radius up to 4 (exact), else `tables` random choices of `bits` bits."""
    if radius <= 4:
        blocks = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.arange(64), radius + 4)]
        return [sum(c) for c in itertools.combinations(blocks, 4)]
    rng = np.random.default_rng(64)
    return [sum(1 << b for b in rng.permutation(64)[:bits].tolist()) for _ in range(tables)]


def _pivots() -> np.ndarray:
    return np.random.default_rng(1).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def linked_pairs(fps: np.ndarray, radius: int, group: np.ndarray | None = None):
    """Index arrays (i, j) of the pairs of fps (uint64) of one group within the radius, by the pivot table, in bounded blocks."""
    n = len(fps)
    pivots = _pivots()[: PIVOTS if radius <= 4 else 2]  # with a large radius further coordinates discard next to nothing
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int16)
    first = table[:, 0] + (0 if group is None else group.astype(np.int64) * 256)
    order = np.argsort(first, kind="stable")
    first, table, fps = first[order].astype(np.int64), table[order], fps[order]
    upto = np.searchsorted(first, first + radius, side="right")
    start = 0
    while start < n:
        size = np.cumsum(upto[start:] - np.arange(start, n) - 1)
        end = start + max(1, int(np.searchsorted(size, PAIRS, side="right")))
        many = upto[start:end] - np.arange(start, end) - 1
        i = np.repeat(np.arange(start, end), many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        for k in range(1, len(pivots)):
            near = np.abs(table[i, k] - table[j, k]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        yield order[i[near]], order[j[near]]
        start = end


def table_pairs(fps: np.ndarray, radius: int, group: np.ndarray, bits: np.ndarray, most: int):
    """linked_pairs of distinct fps, whose group shares the bits of a mask. Tables of more than `most` are dealt anew first:
    the bits they do not share are cut in blocks, and each choice of four blocks is a key within the group, so that the
    last tables hold a few hundred fingerprints at most and no link is lost."""
    many = np.bincount(group, minlength=1)[group]
    small = np.flatnonzero(many <= most)
    for i, j in linked_pairs(fps[small], radius, group[small]):
        yield small[i], small[j]
    for mask in np.unique(bits[many > most]).tolist():
        at = np.flatnonzero((many > most) & (bits == mask))
        free = [b for b in range(64) if not mask >> b & 1]
        for chosen in itertools.combinations(np.array_split(free, radius + 4), 4):
            own = np.uint64(sum(1 << int(b) for part in chosen for b in part))
            sub = np.unique(np.stack([group[at].astype(np.uint64), fps[at] & own]), axis=1, return_inverse=True)[1].ravel()
            for i, j in linked_pairs(fps[at], radius, sub):
                yield at[i], at[j]


def _low(n: int, pairs) -> np.ndarray:
    """For each of n indexes the smallest that it is linked to, by pairs: each round hooks the larger root to the smaller."""
    root = np.arange(n)
    for i, j in pairs:
        a, b = root[i], root[j]
        while (open_ := a != b).any():
            a, b = a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
            a, b = root[a], root[b]
    return root


def _stars(radius: int, masks: list[int], most: int):
    """From sorted rows key, bits, fp (a key's fingerprints, each once): links (a, b) from each to the first of its group."""
    shared = np.array(masks, np.uint64)

    def run(batches):
        for batch in groups(batches, 2):
            key, bits, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            size = np.diff(run_starts(key, bits))
            of = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(size[of] > 1)
            low = _low(len(at), table_pairs(fp[at].view(np.uint64), radius, of[at], shared[key[at]], most))
            a, b = fp[at], fp[at[low]]
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return run


def _keyed(distinct: DataFrame, masks: list[int], *more: str) -> DataFrame:
    """A row (key, bits, fp and more) for each key of each distinct fingerprint, dealt and sorted by key."""
    each = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("key", "bits")
    return distinct.select(each, "fp", *more).repartition("key", "bits").sortWithinPartitions("key", "bits")


def near_classes(prints: DataFrame, radius: int = 2, most: int = 3000) -> DataFrame:
    """prints (doc_id, fp) with component_id, the smallest doc_id that can be reached by links of at most `radius` bits.

    Exact for a radius up to 4; links run between distinct fingerprints, so copies add nothing to them. Rows without id
    link others like any row and are nobody's smallest id: component_id is null only where all that is reached has none.
    Rows that share an id each have their own fingerprint and class; an empty table gives no rows.
    """
    if radius > 4:
        raise ValueError("the radius is 4 at most")
    prints = written(prints.select("doc_id", "fp"), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    masks = masks_for(radius)
    links = _keyed(distinct, masks).mapInArrow(_stars(radius, masks, most), "a long, b long")
    reached = components(links).toDF("fp", "component")
    classes = distinct.join(reached, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    named = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    return prints.join(classes.join(named, "component").select("fp", "component_id"), "fp")


NEAREST = 4  #: fingerprints that one is paired with under a choice of bits, besides the one of the least id
FIRST = 12  #: choices of bits of the first round; the exact round looks only for links between its components
SKETCH = 64  #: least shingle hashes that a text of the first round is compared by
COMMON = 2  #: least count of a shingle in a stretch of texts for it to be counted there
STRETCH = 1 << 21  #: shingles of a stretch
SHOWN = 1 << 19  #: common shingles that set the order; the others count as unseen
BITS = 256  #: bits of the parities of a text's shingles
HELD = 1 << 20  #: ids of texts that are sent to all tasks at most
PRINTS = "doc_id long, t long, fp long, sketch binary, n int, prefix array<long>, b0 long, b1 long, b2 long, b3 long"


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (ascending) that come often, and how often, by lossy counting over all texts.

    A task counts its texts in stretches of STRETCH shingles and gives those of COMMON texts at least, so a shingle of a
    large share of all texts is in some stretch of some task. The counts set an order only: whatever they are, no link is
    lost. The SHOWN most frequent are kept, 8 MB at most.
    """

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(parts)
        h.sort()
        cuts = run_starts(h)
        count = np.diff(cuts)
        often = np.flatnonzero(count >= COMMON)
        return pa.RecordBatch.from_arrays([pa.array(h[cuts[often]].view(np.int64)), pa.array(count[often].astype(np.int64))], names=["h", "n"])

    def run(batches):
        held, size = [], 0
        for b in sliced(batches):
            data, ends = utf8(b.column(0))
            for s, e in itertools.pairwise(ends.tolist()):
                held.append(np.unique(shingle_hashes(data[s:e].tobytes(), words)))
                size += len(held[-1])
                if size >= STRETCH:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    found = rows.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(SHOWN).toArrow()
    h, count = (found.column(k).to_numpy() for k in range(2))
    h = h.astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], count[order].astype(np.int64)


def prefix(h: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The rarest of distinct shingle hashes h: two sets that similar have one of these in common, whatever the counts are."""
    seen, count = common
    many = np.zeros(len(h), np.int64)
    if len(seen):
        at = np.minimum(np.searchsorted(seen, h), len(seen) - 1)
        many = np.where(seen[at] == h, count[at], 0)
    return h[np.lexsort((h, many))][: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]


def _sketches(words: int, common: tuple[np.ndarray, np.ndarray], similarity: float):
    """From rows doc_id, text: PRINTS, which are doc_id, t (hash of the words), fp, sketch (the SKETCH least distinct shingle
    hashes, ascending), n (the number of distinct ones), prefix, and the parities of the numbers of hashes by their last bits."""

    def run(batches):
        for b in sliced(batches):
            data, ends = utf8(b.column(1))
            t, fp, sketch, n, rare = [], [], [], [], []
            parity = np.zeros((b.num_rows, BITS // 8), np.uint8)
            for k, (s, e) in enumerate(itertools.pairwise(ends.tolist())):
                text = data[s:e].tobytes()
                h = shingle_hashes(text, words)
                u = np.unique(h)
                t.append(xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 7) - (1 << 63))
                fp.append(fold([h]) if len(h) else 0)
                sketch.append(u[:SKETCH].tobytes())
                n.append(len(u))
                rare.append(prefix(u, common, similarity).view(np.int64) if len(u) else np.zeros(0, np.int64))
                parity[k] = np.packbits((np.bincount((u % BITS).astype(np.int64), minlength=BITS) & 1).astype(np.uint8))
            cuts = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
            lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0, np.int64), *rare])))
            fps = np.array(fp, np.uint64).view(np.int64)
            cols = [b.column(0), pa.array(t, pa.int64()), pa.array(fps), pa.array(sketch, pa.binary()), pa.array(n, pa.int32()), lists, *(pa.array(c) for c in parity.view(np.int64).T)]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PRINTS.split(", ")])

    return run


def _windows(token: np.ndarray, comp: np.ndarray, n: np.ndarray, most: np.ndarray, similarity: float):
    """For rows sorted by token and n: index arrays (i, j) of pairs of one token and two components, where j has no more
    shingles than i, similarity times n[i] at least and most[i] at most. In bounded blocks.

    A component that holds most of a token's rows is never paired with itself: its rows meet those of the others only.
    """
    ends = run_starts(token)
    size = int(n.max(initial=0)) + 2
    of = np.repeat(np.arange(len(ends) - 1), np.diff(ends)).astype(np.int64)
    order = np.lexsort((comp, token))
    cuts = run_starts(token[order], comp[order])
    runs, sizes = order[cuts[:-1]], np.diff(cuts)
    last = np.lexsort((sizes, of[runs]))  # the longest run of each token comes last
    last = last[run_starts(of[runs][last])[1:] - 1] if len(last) else last
    chosen = np.where(sizes[last] > 1, comp[runs[last]], LOWEST)
    lead = comp == chosen[of]  # rows of the component that has the most rows of their token
    place = of * size
    for mine, theirs in ((~lead, ~lead), (~lead, lead), (lead, ~lead)):  # equal sizes come twice
        a, b = np.flatnonzero(mine), np.flatnonzero(theirs)
        if not len(a) or not len(b):
            continue
        low = np.searchsorted(place[b] + n[b], place[a] + np.ceil(similarity * n[a] - 1e-6).astype(np.int64), side="left")
        high = np.searchsorted(place[b] + n[b], place[a] + np.minimum(n[a], most[a]), side="right")
        many = np.maximum(high - low, 0)
        total = np.append(0, np.cumsum(many))
        start = 0
        while start < len(a):
            end = max(start + 1, int(np.searchsorted(total, total[start] + PAIRS, side="right")) - 1)
            part = many[start:end]
            i = np.repeat(a[start:end], part)
            j = b[np.repeat(low[start:end] - (np.cumsum(part) - part), part) + np.arange(len(i))]
            apart = comp[i] != comp[j]
            yield i[apart], j[apart]
            start = end


def _meeting(similarity: float):
    """From sorted rows token, n, comp, place, rep, b0..b3: pairs (a, b) of one token and two components that may be that similar.

    With J >= s, sets of x and y hashes have s / (1 + s) * (x + y) in common at least and differ in the rest. That bounds
    the sizes, what is left after the first common token, and the number of parities that differ. No bound drops a link.
    """
    share = similarity / (1 + similarity)

    def run(batches):
        for batch in groups(batches, 1):
            token, n, comp, place, rep, *bits = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            size = np.diff(run_starts(token))
            keep = np.flatnonzero(np.repeat(size, size) > 1)
            token, n, comp, place, rep = (c[keep] for c in (token, n, comp, place, rep))
            bits = np.stack([c[keep] for c in bits], axis=1).view(np.uint64)
            place, n = place.astype(np.int64), n.astype(np.int64)
            most = np.floor((n - place) / share - n + 1e-6).astype(np.int64)  # of the other set, if this is the first common token
            found = [np.zeros((2, 0), np.int64)]
            for i, j in _windows(token, comp, n, most, similarity):
                i, j = (x[most[j] >= n[i]] for x in (i, j))
                good = np.bitwise_count(bits[i] ^ bits[j]).sum(1) <= n[i] + n[j] - 2 * (share * (n[i] + n[j]) - 1e-6)
                i, j = i[good], j[good]
                found.append(np.unique(np.stack([np.maximum(rep[i], rep[j]), np.minimum(rep[i], rep[j])]), axis=1))
                if sum(x.shape[1] for x in found) > 1 << 20:
                    found = [np.unique(np.concatenate(found, axis=1), axis=1)]
                    if found[0].shape[1] > 1 << 19:
                        yield _pairs(found)
                        found = [np.zeros((2, 0), np.int64)]
            yield _pairs(found)

    return run


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def alike(a: bytes, b: bytes) -> float:
    """Estimated share of shingles in common, from two sketches; exact where both hold all shingles."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.union1d(x, y)
    if len(x) == SKETCH or len(y) == SKETCH:
        both = both[:SKETCH]
    return float(np.isin(both, np.intersect1d(x, y, assume_unique=True)).sum()) / max(1, len(both))


def _nearest(radius: int):
    """From sorted rows key, bits, fp, rep, comp: for each fingerprint its nearest ones within the radius, and the one of the
    least id, of those in other components than its own."""

    def run(batches):
        for batch in groups(batches, 2):
            key, bits, fp, rep, comp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = run_starts(key, bits)
            size = np.diff(cuts)
            of = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(size[of] > 1)
            at = at[np.lexsort((rep[at], of[at]))]
            f, r, own, n = fp[at].view(np.uint64), rep[at], comp[at], len(at)
            best, least = np.zeros((3, 0), np.int64), np.full(n, n)
            for i, j in linked_pairs(f, radius, of[at]):
                apart = own[i] != own[j]
                i, j = i[apart], j[apart]
                far = np.bitwise_count(f[i] ^ f[j]).astype(np.int64)
                np.minimum.at(least, np.concatenate([i, j]), np.concatenate([j, i]))
                best = np.concatenate([best, np.stack([i, far, j]), np.stack([j, far, i])], axis=1)
                best = best[:, np.lexsort(best[::-1])]
                first = run_starts(best[0])
                best = best[:, np.arange(best.shape[1]) - np.repeat(first[:-1], np.diff(first)) < NEAREST]
            have = np.flatnonzero(least < n)
            x, y = np.concatenate([best[0], have]), np.concatenate([best[2], least[have]])
            if len(x):
                pairs = np.unique(np.stack([r[np.maximum(x, y)], r[np.minimum(x, y)]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def _verified(words: int, similarity: float):
    """From rows a, b, x, y (two texts): a, b where the shingle sets are that similar."""

    def run(batches):
        for batch in sliced(batches, 200):
            good = []
            for x, y in zip(texts(batch.column(2)), texts(batch.column(3)), strict=True):
                p, q = (np.unique(shingle_hashes(t.encode(), words)) for t in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= similarity * (len(p) + len(q) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return run


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 15, tables: int = FIRST) -> DataFrame:
    """(key, component) of each row of docs (key long, text): rows of one component are copies, or linked by near copies.

    A link is a pair whose shingle sets have `similarity` of their union in common; texts of equal words are grouped
    first. In a first round, candidates are pairs within `radius` bits that agree in one of `tables` choices of bits, each
    of as many bits as tell the fingerprints apart on average: under a choice each fingerprint is paired with its four
    nearest and with the least id near it, and sketches thin them out. That joins large groups cheaply and need not find
    all. The second round is exact: all pairs of two components that share a shingle of their prefixes and that no bound
    rules out. Whole texts decide on every link. Texts of no words are not linked to any other text. Rows that share a
    key have one class, and the least of their texts stands for them.
    """

    def sifted(batches):
        for b in batches:
            near = pa.array([alike(x, y) >= similarity - 0.15 for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(near)

    rows = docs.select(F.col("key").alias("doc_id"), "text")
    prints = written(rows.mapInArrow(_sketches(words, _common(rows, words), similarity), PRINTS), "sketches")
    full = F.length("sketch") > 0
    heads = written(prints.where(full).groupBy("t", "fp").agg(F.min("doc_id").alias("rep")), "heads")
    bits = max(18, math.ceil(math.log2(max(2, heads.count()))))

    def of_pairs(pairs, table, value):
        """a, b and the values x, y of both. Only the rows that a pair has go on; a shuffle deals no others."""
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
        kept = table.join(F.broadcast(ids) if ids.count() <= HELD else ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(value).alias(value))
        return pairs.join(kept.toDF("a", "x"), "a").join(kept.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def verified(pairs):
        pairs = written(pairs, "pairs")
        links = written(of_pairs(pairs, rows, "text").mapInArrow(_verified(words, similarity), "a long, b long"), "links")
        discard(pairs)
        return links

    def joined_by(links):
        return components(links).withColumnRenamed("node", "rep")

    near = _keyed(heads.withColumn("comp", F.col("rep")), masks_for(radius, tables, bits), "rep", "comp").mapInArrow(_nearest(radius), "a long, b long")
    near = written(near.distinct(), "near")
    links = verified(of_pairs(near, prints.select("doc_id", "sketch"), "sketch").mapInArrow(sifted, "a long, b long"))
    discard(near)
    comp = heads.join(joined_by(links), "rep", "left").select("t", "fp", F.col("rep").alias("doc_id"), F.coalesce("component", "rep").alias("comp"))
    met = prints.where(full).drop("sketch").join(comp, ["t", "fp", "doc_id"]).select(F.posexplode("prefix").alias("place", "token"), "comp", "n", F.col("doc_id").alias("rep"), "b0", "b1", "b2", "b3")
    met = met.select("token", "n", "comp", "place", "rep", "b0", "b1", "b2", "b3").repartition("token").sortWithinPartitions("token", "n")
    links = links.union(verified(met.mapInArrow(_meeting(similarity), "a long, b long").where("a <> b").distinct()))
    classes = heads.join(joined_by(links), "rep", "left").select("t", "fp", F.coalesce("component", "rep").alias("component"))
    return prints.select("doc_id", "t", "fp", full.alias("full")).join(classes, ["t", "fp"], "left").select(F.col("doc_id").alias("key"), F.when(F.col("full"), F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs (doc_id, text and others) with one document of each component, that of the least id.

    Null texts are empty and, like all texts without words, stay. Null ids count as the least id. Rows that share an id
    stay or go together; one of equal rows stays.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    classes = near_duplicates(docs.select(key.alias("key"), "text"), words, similarity)
    kept = classes.where("key = component").select("key").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))  # so no name of docs can clash
    return rows.join(kept, "key", "left_semi").select("row.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty; rows with one id each have their fingerprint and share in their classes."""
    found = near_classes(fingerprints(read(spark, sf_dir, "documents")), 2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
