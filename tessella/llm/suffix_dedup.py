"""Removal of repeated passages by common-prefix interval trees over sparse enhanced suffix arrays.

A string of 100 bytes holds a 32-byte anchor: the place with the least hash among its 69. Equal strings have their anchor
at the same offset, so two places of a repeat always meet under one anchor hash.

1. Each document gives its anchors (about one for 31 bytes) with a hash of the text around, 68 bytes before to 100 after.
   Of equal ones in a batch the first goes on, which keeps a text copied everywhere from filling one task.
2. Anchors are dealt by their hash and sorted. Places of one anchor with equal surroundings (64 bits each for anchor and
   surroundings) are a repeat group as they are: all but the first are covered as a whole. The first stands for them.
3. Over the first places of an anchor, which differ in their surroundings, an enhanced suffix array is built: the suffixes
   from the anchor on are sorted, and a stack scan of their common prefixes yields the interval tree. The places of an
   interval are then scanned in the order of the text to their left. An interval of that scan is diverse to the left; if
   its places also lie in more than one child of the right interval it is a maximal repeat group, given with all places.
   Every place of a group but the earliest is covered.
4. Places of an anchor with more than `most` of them are dealt anew: two that share 100 bytes share one of four longer
   strings around the anchor. Where even such a string has more than `most` places, the strings of 100 bytes in them are
   hashed (128 bits) and grouped with map-side minimums, so no group meets in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups, keyed, read, run_starts, utf8, written

ANCHOR = 32
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
PIECE = 1 << 18  # bytes of text whose hashes are held at a time
ROWS = 500  # rows with texts that are held as Python objects at a time


def _slide(a: np.ndarray, op, width: int) -> np.ndarray:
    s = 1
    while s * 2 <= width:
        a, s = op(a[:-s], a[s:]), s * 2
    return op(a[: len(a) - (width - s)], a[width - s :]) if s < width else a


class Anchors:
    """Anchors of texts given end to end. Hashes are polynomials modulo 2**64 over random odd byte values, then mixed."""

    def __init__(self, length: int):
        self.length, self.room = length, length - ANCHOR
        rng = np.random.default_rng(20240229)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.back = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.backs = np.ones(1, np.uint64)

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """hash, hash of the surroundings, row, place in the row, bytes before and after: an array of each."""
        n, width = len(data), self.room + 1
        if n < self.length:
            return tuple(np.zeros(0, t) for t in (np.int64,) * 6)
        if len(self.powers) <= n:
            self.powers = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, self.base)))
            self.backs = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, self.back)))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.backs[:n], out=sums[1:])
        h = self.mix((sums[ANCHOR:] - sums[:-ANCHOR]) * self.powers[: n - ANCHOR + 1])
        lengths = np.diff(ends)
        for e in ends[1:][lengths > 0]:  # no anchor reaches over the end of a text
            h[max(0, e - ANCHOR + 1) : e] = TOP
        least = _slide(h, np.minimum, width)
        pad = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), np.maximum, width) == h) & (h != TOP))
        row = np.searchsorted(ends, at, side="right") - 1
        begin, end = ends[row], ends[row + 1]
        low, high = np.maximum(at - self.room, begin), np.minimum(at + self.length, end)
        near = self.mix((sums[high] - sums[low]) * self.powers[low] + ((at - low) * 1000003 + (high - at)).astype(np.uint64) * self.base)
        return h[at].view(np.int64), near.view(np.int64), row, at - begin, at - low, high - at


def _long_anchors(find: Anchors, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same of one text that is longer than PIECE: each stretch is read with as much around it as decides on its anchors."""
    margin, parts = 2 * find.length, [[] for _ in range(6)]
    for at in range(0, len(data), PIECE):
        low, high = max(0, at - margin), min(len(data), at + PIECE + margin)
        found = find(data[low:high], np.array([0, high - low]))
        mine = (found[3] + low >= at) & (found[3] + low < at + PIECE)
        for p, x, add in zip(parts, found, (0, 0, 0, low, 0, 0), strict=True):
            p.append(x[mine] + add)
    return tuple(np.concatenate(p) for p in parts)


def _pieces(ends: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of about PIECE bytes: the arrays then stay in the processor's cache."""
    out, i = [], 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PIECE, side="right")) - 1)
        out.append((i, j))
        i = j
    return out


def _spans(key, tie, start, end) -> tuple[np.ndarray, ...]:
    """Unions of overlapping or touching spans of each row."""
    order = np.lexsort((start, tie, key))
    key, tie, start, end = key[order], tie[order], start[order], end[order]
    if not len(key):
        return key, tie, start, end
    row = run_starts(key, tie)
    of = np.repeat(np.arange(len(row) - 1), np.diff(row))
    size = int(end.max()) + 2
    reach = np.maximum.accumulate(end + of * size) - of * size
    new = np.ones(len(key), bool)
    new[1:] = (of[1:] != of[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return key[first], tie[first], start[first], reach[np.append(first[1:], len(key)) - 1]


MARKS = "h long, near long, key long, tie long, place long"


def _marks(length: int, merged: bool = True):
    """Rows of MARKS: anchors, place = start * 65536 + before * 256 + after; and, merged, spans known in the batch, place < 0."""

    def run(batches):
        find = Anchors(length)
        for b in batches:
            keys, ties = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, ends = utf8(b.column(2))
            parts = [[] for _ in range(6)]
            for i, j in _pieces(ends):
                part = data[ends[i] : ends[j]]
                found = find(part, ends[i : j + 1] - ends[i]) if j - i > 1 or len(part) <= PIECE else _long_anchors(find, part)
                for p, x in zip(parts, (found[0], found[1], found[2] + i, *found[3:]), strict=True):
                    p.append(x)
            if not parts:
                continue
            h, near, row, at, before, after = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
            key, tie = keys[row], ties[row]
            order = np.lexsort((at, tie, key, near, h))
            h, near, key, tie, at, before, after = (x[order] for x in (h, near, key, tie, at, before, after))
            first = np.full(len(h), not merged)
            first[run_starts(h, near)[:-1]] = True
            rest = ~first & (before + after >= length)
            k, t, s, e = _spans(key[rest], tie[rest], (at - before)[rest], (at + after)[rest])
            place = (at << 16) | (before << 8) | after
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x[first], y])) for x, y in ((h, k * -7046029254386353131 + t), (near, s), (key, k), (tie, t), (place, -e))], names=["h", "near", "key", "tie", "place"]
            )

    return run


KNOWN = "kind int, h long, key long, tie long, a long, b long"


def _classes(length: int, most: int):
    """From sorted MARKS: kind 0, the span a to b of a row; kind 1, a first place a to compare; kind 2, the same of an anchor with more than `most`."""

    def run(batches):
        last = None  # h and near of the last row
        held: list[np.ndarray] = []  # first places of the last h, at most `most`
        many = None  # an h that has more
        for b in batches:
            h, near, key, tie, place = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            out = []
            known = place < 0
            if known.any():
                out.append((0, h[known], key[known], tie[known], near[known], -place[known]))
            h, near, key, tie, place = (x[~known] for x in (h, near, key, tie, place))
            if len(h):
                first = np.zeros(len(h), bool)
                first[run_starts(h, near)[:-1]] = True
                first[0] = last != (h[0], near[0])
                at, before, after = place >> 16, (place >> 8) & 255, place & 255
                rest = ~first & (before + after >= length)
                k, t, s, e = _spans(key[rest], tie[rest], (at - before)[rest], (at + after)[rest])
                out.append((0, np.zeros_like(k), k, t, s, e))
                cols = np.stack([h[first], key[first], tie[first], place[first]])
                last = (h[-1], near[-1])
                if held:
                    cols = np.concatenate([*held, cols], axis=1)
                starts = run_starts(cols[0])
                sizes = np.diff(starts)
                of = np.repeat(sizes, sizes)
                large = (of > most) | (cols[0] == many if many is not None else False)
                end = int(starts[-2]) if len(sizes) else 0
                if len(sizes) and (sizes[-1] > most or cols[0, -1] == many):
                    many, end = cols[0, -1], cols.shape[1]
                held = [cols[:, end:]]
                for kind, take in ((1, (of > 1) & ~large), (2, large)):
                    take = take[:end]
                    c = cols[:, :end][:, take]
                    out.append((kind, c[0], c[1], c[2], c[3], np.zeros_like(c[0])))
            yield _known(out)
        if held and held[0].shape[1] > 1:
            c = held[0]
            yield _known([(1, c[0], c[1], c[2], c[3], np.zeros_like(c[0]))])

    return run


def _known(out: list) -> pa.RecordBatch:
    kinds = np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in out]) if out else np.zeros(0, np.int32)
    cols = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(1, 6)]
    return pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, cols)], names=["kind", "h", "key", "tie", "a", "b"])


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    d = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (d.bit_length() + 7) // 8


def intervals(suffixes: list[bytes], least: int):
    """(length, places) of every common-prefix interval of at least `least` bytes: one stack scan of the sorted suffixes.

    places index `suffixes`; all that share the prefix are given, inner intervals before the outer ones.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    stack: list[tuple[int, int]] = []  # common prefix, first rank
    for r in range(1, len(order) + 1):
        shared = common(suffixes[order[r - 1]], suffixes[order[r]]) if r < len(order) else 0
        begin = r - 1
        while stack and stack[-1][0] > shared:
            size, begin = stack.pop()
            yield size, order[begin:r]
        if shared >= least and (not stack or stack[-1][0] < shared):
            stack.append((shared, begin))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int):
    """(bytes before, bytes after, places) of every maximal repeat group of at least `length` bytes around one anchor.

    lefts are reversed, so that a common prefix is common text before the anchor. A group has all the places that share
    its string; it is maximal, as no longer string in the given texts has the same places.
    """
    if len(lefts) == 2:
        before, after = common(*lefts), common(*rights)
        if before + after >= length:
            yield before, after, [0, 1]
        return
    rank = sorted(range(len(lefts)), key=lefts.__getitem__)
    position = {x: r for r, x in enumerate(rank)}
    reach = [common(lefts[rank[r]], lefts[rank[r + 1]]) for r in range(len(rank) - 1)]
    child = [-1 - x for x in range(len(lefts))]  # the interval below the present one that a place lies in, or itself
    for number, (size, members) in enumerate(intervals(rights, ANCHOR)):
        if len(members) == 2:
            x, y = members
            if child[x] != child[y] and (before := common(lefts[x], lefts[y])) + size >= length:
                yield before, size, members
            child[x] = child[y] = number
            continue
        members = sorted(members, key=position.__getitem__)
        gaps = [min(reach[position[x] : position[y]]) if position[y] - position[x] < 9 else common(lefts[x], lefts[y]) for x, y in zip(members, members[1:], strict=False)]
        least = length - size
        stack: list[tuple[int, int]] = []  # common text to the left, first place
        for r, gap in enumerate([*gaps, -1] if max(gaps) >= least else (), 1):
            begin = r - 1
            while stack and stack[-1][0] > gap:
                before, begin = stack.pop()
                one = child[members[begin]]
                if any(child[x] != one for x in members[begin + 1 : r]):
                    yield before, size, members[begin:r]
            if gap >= least and (not stack or stack[-1][0] < gap):
                stack.append((gap, begin))
        for x in members:
            child[x] = number


CONTEXTS = "h long, key long, tie long, at long, left binary, right binary"


def _contexts():
    """From rows key, tie, text, at (array of struct(h, place)): CONTEXTS, with the bytes to the left of a place reversed."""

    def run(batches):
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            out = [[] for _ in range(6)]
            for key, tie, text, ats in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = (text or "").encode()
                for x in ats:
                    place = x["a"]
                    at, before, after = place >> 16, (place >> 8) & 255, place & 255
                    for o, v in zip(out, (x["h"], key, tie, at, data[at - before : at][::-1], data[at : at + after]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), *(pa.array(x, pa.binary()) for x in out[4:])], names=["h", "key", "tie", "at", "left", "right"])

    return run


GROUPS = "g long, before int, after int, n int, key long, tie long, at long"


def _groups(length: int, everywhere: bool = False):
    """From CONTEXTS sorted by h: a row of GROUPS for each place of each maximal repeat group, the earliest place first; g is
    the hash of the group's string. everywhere: only groups whose anchor follows from the string, so that it is one wherever
    the string is."""

    find = Anchors(length)

    def follows(string: bytes, at: int) -> bool:
        return at in find(np.frombuffer(string, np.uint8), np.array([0, len(string)]))[3]

    def run(batches):
        for b in groups(batches, 1):
            h = b.column(0).to_numpy(zero_copy_only=False)
            place = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], axis=1)
            left, right = b.column(4).to_pylist(), b.column(5).to_pylist()
            rows: list[np.ndarray] = []
            cuts = run_starts(h).tolist()
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j - i < 2:
                    continue
                places = [tuple(x) for x in place[i:j].tolist()]
                for before, after, members in maximal_repeats(left[i:j], right[i:j], length):
                    members = sorted(members, key=places.__getitem__)
                    if len(members) > 1:
                        x = i + members[0]
                        string = left[x][:before][::-1] + right[x][:after]
                        if everywhere and not follows(string, before):
                            continue
                        g = xxhash.xxh64_intdigest(string) - (1 << 63)
                        rows.append(np.array([(g, before, after, len(members), *places[x]) for x in members], np.int64))
                if sum(map(len, rows)) > 1 << 16:
                    yield _rows_of(rows)
                    rows = []
            yield _rows_of(rows)

    return run


def _rows_of(rows: list[np.ndarray]) -> pa.RecordBatch:
    cols = np.concatenate([np.zeros((0, 7), np.int64), *rows]).T
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if 0 < k < 4 else c) for k, c in enumerate(cols)], names=[x.split()[0] for x in GROUPS.split(", ")])


def _covered(length: int):
    """From CONTEXTS sorted by h: the spans (key, tie, s, e) of all places of a maximal repeat group but the earliest."""

    def run(batches):
        for b in groups(batches, 1):
            h = b.column(0).to_numpy(zero_copy_only=False)
            place = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], axis=1)
            left, right = b.column(4).to_pylist(), b.column(5).to_pylist()
            found: list[tuple[int, int, int]] = []  # row, bytes before and after
            cuts = run_starts(h).tolist()
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j - i < 2:
                    continue
                order = [0] * (j - i)
                for r, x in enumerate(np.lexsort(place[i:j].T[::-1]).tolist()):
                    order[x] = r
                most = [-1] * (j - i)  # bytes before, of what covers a place so far; of its groups those with more bytes after come first
                for before, after, members in maximal_repeats(left[i:j], right[i:j], length):
                    first = min(members, key=order.__getitem__)
                    for x in members:
                        if before > most[x] and x != first:
                            most[x] = before
                            found.append((i + x, before, after))
                if len(found) > 50_000:
                    yield spans(place, found)
                    found = []
            yield spans(place, found)

    def spans(place: np.ndarray, found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        row, before, after = np.array(found, np.int64).reshape(-1, 3).T
        key, tie, at = place[row].T if len(row) else np.zeros((3, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _spans(key, tie, at - before, at + after)], names=["key", "tie", "s", "e"])

    return run


def _subkeys(length: int):
    """From CONTEXTS: the same and `subs`, hashes of four strings around the anchor; two places with `length` common bytes
    share one. With room = length - 32 bytes to share on both sides, the k-th has k quarters of it before the anchor and
    3 - k after, so that the share before decides which one it is."""
    room = length - ANCHOR
    quarter = -(-room // 4)

    def run(batches):
        for b in batches:
            subs = []
            for h, left, right in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                own = []
                for k in range(4):
                    x, y = min(room, k * quarter), ANCHOR + max(0, room - (k + 1) * quarter)
                    if len(left) >= x and len(right) >= y:
                        own.append(xxhash.xxh64_intdigest(left[:x] + b"|" + right[:y], (h + k) & (1 << 64) - 1) - (1 << 63))
                subs.append(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(subs, pa.list_(pa.int64()))], names=[*b.schema.names, "subs"])

    return run


def _strings(length: int):
    """From CONTEXTS: a 128-bit hash of every string of `length` bytes around each anchor, and its start."""

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for key, tie, at, left, right in zip(*(b.column(k).to_pylist() for k in range(1, 6)), strict=True):
                data = left[::-1] + right
                n = max(0, len(data) - length + 1)
                for o, v in zip(out, ([hashlib.blake2b(data[s : s + length], digest_size=16).digest() for s in range(n)], [key] * n, [tie] * n, range(at - len(left), at - len(left) + n)), strict=True):
                    o += v
            sums = np.frombuffer(b"".join(out[0]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(sums[:, 0]), pa.array(sums[:, 1]), *(pa.array(x, pa.int64()) for x in out[1:])], names=["x", "y", "key", "tie", "s"])

    return run


def _places(docs: DataFrame, known: DataFrame, kind: int) -> DataFrame:
    """CONTEXTS of the places of a kind of KNOWN."""
    places = known.where(F.col("kind") == kind).groupBy("key", "tie").agg(F.collect_list(F.struct("h", "a")).alias("at"))
    return docs.select("key", "tie", "text").join(places, ["key", "tie"]).mapInArrow(_contexts(), CONTEXTS)


def _crowded(docs: DataFrame, known: DataFrame, length: int, full: int) -> tuple[DataFrame, DataFrame]:
    """For places of anchors with more than `most`: contexts to be grouped by their h, which is a sub-key now; and those of
    sub-keys with more than `full`."""
    contexts = written(_places(docs, known, 2).mapInArrow(_subkeys(length), f"{CONTEXTS}, subs array<long>"), "crowded")
    each = contexts.select(F.explode("subs").alias("sub"), "key", "tie", "at", "left", "right")
    over = written(each.groupBy("sub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > full).select("sub"), "full")
    few = each.join(over, "sub", "left_anti").withColumnRenamed("sub", "h")
    return few.select("h", "key", "tie", "at", "left", "right"), each.join(over, "sub", "left_semi").withColumnRenamed("sub", "h").dropDuplicates(["key", "tie", "at"])


def repeated_spans(docs: DataFrame, length: int = 100, most: int = 5000, full: int = 20_000) -> DataFrame:
    """(key, tie, s, e): byte spans of the rows of keyed(docs) that hold only strings of `length` bytes which start earlier."""
    if not ANCHOR < length <= 255:
        raise ValueError(f"length must be from {ANCHOR + 1} to 255")
    marks = docs.select("key", "tie", "text").mapInArrow(_marks(length), MARKS)
    known = written(marks.repartition("h").sortWithinPartitions("h", "near", "key", "tie", "place").mapInArrow(_classes(length, most), KNOWN), "known")
    spans = known.where("kind = 0").select("key", "tie", F.col("a").alias("s"), F.col("b").alias("e"))
    near = _places(docs, known, 1)
    if not known.where("kind = 2").isEmpty():
        few, many = _crowded(docs, known, length, full)
        near = near.unionByName(few)
        strings = many.select("h", "key", "tie", "at", "left", "right").mapInArrow(_strings(length), "x long, y long, key long, tie long, s long")
        first = strings.groupBy("x", "y").agg(F.min(F.struct("key", "tie", "s")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        spans = spans.union(strings.join(first, ["x", "y"]).where("struct(key, tie, s) > first").select("key", "tie", "s", (F.col("s") + length).alias("e")))
    return spans.union(near.repartition("h").sortWithinPartitions("h").mapInArrow(_covered(length), "key long, tie long, s long, e long"))


def repeat_groups(docs: DataFrame, length: int = 100, most: int = 20_000) -> DataFrame:
    """(group, length, n, doc_id, start): every maximal repeat group of at least `length` bytes with all its places.

    group is the hash of the string. Strings are those around an anchor, up to length - 32 bytes before and `length` bytes
    after its start; longer repeats come as several groups. n is the number of places. Nulls, ties and repeats are as in suffix_dedup(); an empty table has no groups.
    Places of one anchor meet in one task: `most` bounds that, and an anchor with more is an error here.
    """
    rows = keyed(docs)
    marks = rows.select("key", "tie", "text").mapInArrow(_marks(length, merged=False), MARKS)
    counts = marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bound = F.when(F.col("n") > most, F.raise_error(F.lit("an anchor has too many places")).cast("int")).otherwise(F.lit(1))
    places = marks.join(counts, "h").select(bound.alias("kind"), "h", "key", "tie", F.col("place").alias("a"))
    found = _places(rows, places, 1).repartition("h").sortWithinPartitions("h").mapInArrow(_groups(length, everywhere=True), GROUPS)
    found = found.join(rows.select("key", "tie", "doc_id"), ["key", "tie"])
    return found.select(F.col("g").alias("group"), (F.col("before") + F.col("after")).alias("length"), "n", "doc_id", (F.col("at") - F.col("before")).alias("start")).distinct()


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(batches):
    for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
        rows = []
        for doc, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = (text or "").encode()
            kept, runs, gone, upto = [], 0, 0, 0
            end = -1
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if s > end:
                    runs += 1
                    kept.append(data[upto:s])
                    gone += e - s
                    end = upto = e
                elif e > end:
                    gone += e - end
                    end = upto = e
            kept.append(data[upto:])
            rest = b"".join(kept)
            rows.append((doc, len(data), gone, runs, hashlib.sha256(rest).hexdigest(), rest))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.string(), pa.binary()), strict=True)], names=[x.split()[0] for x in OUT.split(", ")])


def suffix_dedup(docs: DataFrame, length: int = 100, most: int = 5000, full: int = 20_000) -> DataFrame:
    """One row of OUT for each document (doc_id, text): what is left without bytes in strings of `length` bytes that start earlier.

    Earlier is a smaller doc_id, or the same text and a smaller start; all is judged on the input. Null texts are empty
    and keep nothing; null ids come first; rows with the same id are ordered by their texts. An empty table gives no rows.
    Other columns are not looked at. `kept` is bytes, as a cut can divide a character.
    """
    rows = keyed(docs)
    spans = repeated_spans(rows, length, most, full).groupBy("key", "tie").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return rows.join(spans, ["key", "tie"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, OUT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).drop("kept")
