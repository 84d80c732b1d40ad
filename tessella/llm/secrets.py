"""Secret scans: fixed patterns, and a battery of randomness tests on the other long runs of key characters.

A run of [A-Za-z0-9+/_=-] is cut at every `=` that is not at its end (padding); a part of 20 or more outside the
patterns' spans is a candidate. Its encoding is inferred from its characters (hex, base32, base64). Three tests ask whether
its symbols are drawn at random from that alphabet: chi-squared uniformity over classes of symbols (letters that are frequent
in text apart from the others), runs above and below the middle, and serial correlation. Fisher's sum of their p-values is
compared with what running text of the same length gives (simulated once with a fixed seed), which yields the p-value of
"this is text". The Benjamini-Hochberg procedure over the candidates of the whole table, each weighted by its length, keeps
the share of false discoveries at RATE; a find must also not be rejected as random. For that a first pass counts the
weighted p-values in a histogram of fixed size; the second one has the cut that follows from it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, texts

# The patterns of the base scan.
WORDS = rb"(?:password|passwd|secret|token|api_?key)"
ASSIGN = re.compile(WORDS + rb"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
NAME_END = re.compile(WORDS + rb"\Z", re.I)
LONGEST = len("password")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

RUN, RATE, FLOOR = 20, 0.01, 1e-3
SLICE = 500  #: rows that are scanned at a time
PART = re.compile(rb"[^=]+(?:=+\Z)?")  #: what `=` divides in a run; `=` at its end is padding


def _members(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX, KEY = _members(DIGITS + "abcdef"), _members(DIGITS + LOWER + UPPER + "+/_=-")
FREQUENT = "etaoinsr"  #: letters that make up most of a text


def _alphabet(name: str, pattern: str, symbols: str, *classes: str):
    """name, pattern, place of each symbol, class of each place, share of each class."""
    of = [next(k for k, c in enumerate(classes) if x in c) for x in symbols]
    return name, re.compile(pattern.encode()), {c: k for k, c in enumerate(symbols.encode())}, np.array(of), np.bincount(of) / len(symbols)


ALPHABETS = (
    _alphabet("hex", "[0-9a-f]+|[0-9A-F]+", DIGITS + "abcdef", "01", "23", "45", "67", "89", "ab", "cd", "ef"),
    _alphabet("base32", "[A-Z2-7]+=*", UPPER + "234567", "AEIOU", "HLNRST", UPPER, DIGITS),
    _alphabet("base64", "[A-Za-z0-9+/_-]+=*", UPPER + LOWER + DIGITS + "+/", FREQUENT, LOWER, FREQUENT.upper(), UPPER, DIGITS, "+/"),
)
BINS, FINE = 4000, 40  #: of the histogram, and of a factor of ten


def runs_of(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of at least `least` True."""
    edge = np.flatnonzero(np.diff(member.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    s, e = edge[::2], edge[1::2]
    long = e - s >= least
    return s[long], e[long]


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi(x: float, df: int) -> float:
    """Upper tail of chi-squared, by Wilson and Hilferty's approximation."""
    z = ((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(value: bytes) -> tuple[str, float, float] | None:
    """Encoding, p-value of "random in that encoding", and Fisher's statistic of the three tests."""
    for name, pattern, symbols, of, shares in ALPHABETS:
        if not pattern.fullmatch(value):
            continue
        plain = value.rstrip(b"=").lower() if name == "hex" else value.rstrip(b"=").translate(STANDARD)
        x = np.array([symbols[c] for c in plain], float)
        n = len(x)
        if n < RUN // 2:
            return None
        counts = np.bincount(of[x.astype(int)], minlength=len(shares))
        spread = _chi(float(((counts - n * shares) ** 2 / (n * shares)).sum()), len(shares) - 1)
        high = x >= len(symbols) / 2
        a, b = int(high.sum()), n - int(high.sum())
        if a and b:
            mean = 2 * a * b / n + 1
            sd = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
            turns = _tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / sd)
        else:
            turns = 2.0 ** max(1 - n, -1000)
        d = x - x.mean()
        serial = _tail(float((d[1:] * d[:-1]).sum() / (d * d).sum()) * math.sqrt(n)) if (d * d).sum() > 0 else 2.0 ** max(1 - n, -1000)
        fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (spread, turns, serial))
        return name, _chi(fisher, 6), fisher
    return None


STANDARD = bytes.maketrans(b"-_", b"+/")
LENGTHS = (20, 32, 64, 128, 256)


@lru_cache(maxsize=8)
def text_law(encoding: str) -> tuple[float, float, float]:
    """Of the logarithm of Fisher's statistic for running text: slope and start of its mean over the logarithm of the length,
    and deviation; fitted to 150 texts of each of LENGTHS, made with a fixed seed."""
    rng = np.random.default_rng(5)
    syllables = ["the", "an", "er", "in", "re", "st", "ou", "ti", "le", "on", "de", "ch", "que", "ment", "ver", "ung", "ado", "ci"]
    means, spreads = [], []
    for length in LENGTHS:
        found = []
        for k in range(150):
            words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(length // 2 + 1)]
            if encoding == "hex":
                text = "".join(rng.choice(["dead", "face", "0000", "cafe", "beef", "1234", "aaaa", "2021", "1111"], length // 4 + 1))
            elif encoding == "base32":
                text = "".join(words).upper()
            else:
                text = ("-", "_", "/", "")[k % 4].join(w.title() if k % 3 else w for w in words)
                if k % 5 == 0:
                    text = text[: length - 4] + str(1990 + k % 40)
            got = battery(text[:length].encode())
            if got and got[0] == encoding:
                found.append(math.log(got[2] + 1))
        means.append(float(np.mean(found)))
        spreads.append(float(np.std(found)))
    slope, start = np.polyfit(np.log(LENGTHS), means, 1)
    return float(slope), float(start), max(0.15, max(spreads))


def rank(value: bytes) -> int:
    """Bin of the p-value of "this is text" divided by the length, higher for smaller ones; 0 for what is not random."""
    got = battery(value)
    if not got or got[1] < FLOOR:
        return 0
    slope, start, sd = text_law(got[0])
    z = (slope * math.log(len(value.rstrip(b"="))) + start - math.log(got[2] + 1)) / sd
    p = 0.5 * math.erfc(z / math.sqrt(2))
    return min(BINS - 1, 1 + int(FINE * -math.log10(max(p / len(value), 1e-300))))


def cut_of(histogram: list[tuple[int, int, int]]) -> int:
    """The least bin of a discovery, from (bin, candidates, their bytes): weighted Benjamini-Hochberg at RATE."""
    m, size = sum(n for _, n, _ in histogram), sum(b for _, _, b in histogram)
    best, upto = BINS, 0
    for k, n, _ in sorted(histogram, reverse=True):
        upto += n
        if k and 10.0 ** (-(k - 1) / FINE) * (size / m) <= RATE * upto / m:
            best = k
    return best


def spans_of(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of texts joined by line ends, which no span holds."""
    a = np.frombuffer(data, np.uint8)
    out, upto = [], 0
    for at in np.flatnonzero((a == ord(":")) | (a == ord("="))).tolist():
        if at < upto:
            continue
        end = at
        while end > upto and (spaces := end - max(upto, end - 64) - len(data[max(upto, end - 64) : end].rstrip(b" "))):
            end -= spaces
        if end > upto and data[end - 1] in b"\"'":
            end -= 1
        if (name := NAME_END.search(data, max(upto, end - LONGEST), end)) and (m := ASSIGN.match(data, name.start())):
            upto = m.end()
            if len(m[1]) >= LEAST["assign"]:
                out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST["access"]]
    out += [(s, e, "hex") for s, e in zip(*(x.tolist() for x in runs_of(HEX[a], LEAST["hex"])), strict=True)]
    return out


def candidates(rows: list[str]) -> list[tuple[bytes, list, list]]:
    """For each text its bytes, its base spans and, apart from these, the runs that the battery tests: (start, end, value)."""
    encoded = [t.encode() for t in rows]
    data = b"\n".join(encoded)
    starts = np.cumsum([0, *(len(x) + 1 for x in encoded)])
    base: list[list] = [[] for _ in rows]
    found = spans_of(data)
    if found:
        for (s, e, kind), row in zip(found, (np.searchsorted(starts, [x[0] for x in found], side="right") - 1).tolist(), strict=True):
            base[row].append((s - int(starts[row]), e - int(starts[row]), kind))
    runs: list[list] = [[] for _ in rows]
    s, e = runs_of(KEY[np.frombuffer(data, np.uint8)], RUN)
    for i, j, row in zip(s.tolist(), e.tolist(), (np.searchsorted(starts, s, side="right") - 1).tolist(), strict=True):
        i -= int(starts[row])
        runs[row] += [(i + m.start(), i + m.end(), m[0]) for m in PART.finditer(encoded[row][i : j - int(starts[row])]) if len(m[0]) >= RUN]
    return [(raw, own, [x for x in more if not any(a < x[1] and x[0] < b for a, b, _ in own)]) for raw, own, more in zip(encoded, base, runs, strict=True)]


def counts_of(rows: list[str]) -> Counter:
    """(bin, bytes) of each candidate of the texts."""
    return Counter((rank(value), e - s) for _, _, more in candidates(rows) for s, e, value in more)


def histogram_of(counts: Counter) -> list[tuple[int, int, int]]:
    bins: dict[int, list[int]] = {}
    for (k, size), n in counts.items():
        held = bins.setdefault(k, [0, 0])
        held[0] += n
        held[1] += n * size
    return [(k, *v) for k, v in bins.items()]


def scan(rows: list[str], cut: int | None = None) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text its base spans and its further random spans, (kind, start, end) in code points, in order.

    cut is the least bin of a random span; without it, the texts are the table that the cut follows from.
    """
    cut = cut_of(histogram_of(counts_of(rows))) if cut is None else cut
    out = []
    for raw, own, more in candidates(rows):
        new = [(s, e, "random") for s, e, value in more if rank(value) >= cut]
        count = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]) if own or new else [0]
        order = lambda xs: sorted(((k, int(count[s]), int(count[e])) for s, e, k in xs), key=lambda x: (x[1], KINDS.index(x[0])))  # noqa: B023, E731
        out.append((order(own), order(new)))
    return out


def table_cut(docs: DataFrame) -> int:
    """cut_of() over all rows of docs (text): a pass that gives at most BINS rows a task."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                h = histogram_of(counts_of(texts(b.column(0).slice(i, SLICE))))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in h], pa.int64()) for k in range(3)], names=["bin", "n", "size"])

    found = docs.select("text").mapInArrow(run, "bin long, n long, size long").groupBy("bin").agg(F.sum("n"), F.sum("size")).collect()  # at most BINS rows
    return cut_of([tuple(r) for r in found])


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_documents(docs: DataFrame, cut: int | None = None) -> DataFrame:
    """One row of OUT for each row of docs (doc_id, text): the spans of its whole text.

    Base spans depend on the text alone; random ones also on the cut, by default that of the table. Null and empty texts
    have none; null or repeated ids and repeated rows stay; an empty table gives no rows; other columns are not looked at.
    """
    cut = table_cut(docs) if cut is None else cut

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                rows = []
                for base, new in scan(texts(part.column(1)), cut):
                    every = sorted([*base, *new], key=lambda x: (x[1], KINDS.index(x[0])))
                    rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS[:3]), hashlib.sha256(told(base).encode()).hexdigest(), told(every)))
                cols = [pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.string()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def redact(text: str, mask: str = "[SECRET]") -> str:
    """A text with every span, or overlapping spans, replaced by the mask; the text alone is the table."""
    return redact_all([text], mask)[0]


def redact_all(rows: list[str], mask: str = "[SECRET]", cut: int | None = None) -> list[str]:
    out = []
    for text, (base, new) in zip(rows, scan(rows, cut), strict=True):
        parts, upto = [], 0
        for _, s, e in sorted([*base, *new], key=lambda x: x[1]):
            if s >= upto:
                parts += [text[upto:s], mask]
            upto = max(upto, e)
        out.append("".join([*parts, text[upto:]]) if parts else text)
    return out


def redact_documents(docs: DataFrame, mask: str = "[SECRET]", cut: int | None = None) -> DataFrame:
    """docs with every span in `text` replaced by the mask and n_chars, if there, counted anew; a null text stays null.

    All rows and columns stay, whatever their ids; an empty table gives no rows. cut as in scan_documents().
    """
    cut = table_cut(docs) if cut is None else cut
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                new = [None if t is None else r for t, r in zip(part.column(at).to_pylist(), redact_all(texts(part.column(at)), mask, cut), strict=True)]
                cols = list(part.columns)
                cols[at] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read(spark, sf_dir, "documents"))

