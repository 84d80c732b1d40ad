"""SentencePiece (merge type) encoding with a table of each prefix's last token, and decoding.

Of the tokens that end at a place exactly one can be the last token of the encoded prefix: the one that merging would not
join or split next to the last token before it. An automaton gives the tokens that end at each place, the pair test says
which of them fits, and the ids are read off backwards. No token holds a space mark after another character, so a text is
cut there and pieces of text are looked up in a bounded memo.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, texts

MARK = "▁"
SAFE = re.compile(rf"(?<!{MARK}){MARK}|\n")
CHUNK = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
SLICE, MEMO = 1 << 20, 200_000


class Pieces:
    """Encoder and decoder for the bytes of a model file: merge type, byte fallback, identity normaliser."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        self.eos, size = sp.eos_id(), sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.byte = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.unknown = sp.unk_id()
        if size > 1 << 15 or self.unknown:
            raise ValueError("ids must be below 32,768, and 0 that of the unknown piece")
        plain = [i for i in range(size) if i not in self.silent and i not in self.byte and i != self.unknown and not sp.is_unused(i)]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character, or a line end")
        self.known = {p for p in self.ids if len(p) == 1}
        self.sizes = [len(p) for p in self.pieces]
        self.plain = [p.replace(MARK, " ") for p in self.pieces]
        self.mute = {*self.byte, *self.silent, self.unknown}
        self.parents: dict[str, tuple[str, str]] = {}  # the last merge that makes a piece
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if (m := self.merged(p, pair := [])) == [p]:  # others are never the outcome of merging
                self.automaton.add_word(p, (i, len(p)))
                if len(m[0]) > 1:
                    self.parents[p] = pair[-1]
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def merged(self, text: str, pairs: list | None = None) -> list[str]:
        """Merging as defined: the best score first, the leftmost of equals. pairs: gets what was merged."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            if pairs is not None:
                pairs.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens as they are when they stand side by side.

        Goes back through the merges of both at their common edge, the latest first: the tokens that met there in
        between must not make a piece that would have been merged before either grew.
        """
        a, b = self.pieces[left], self.pieces[right]
        if self.tied(a) or self.tied(b):
            return self.merged(a + b) == [a, b]
        scores, parents = self.scores, self.parents
        until = None  # score of the merge that ended the pair; None: it stands to the end
        while True:
            joined = scores.get(a + b)
            if joined is not None and (until is None or joined > until or (joined == until and right_ended)):
                return False
            x, y = parents.get(a), parents.get(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and scores[a] < scores[b]):
                until, right_ended, a = scores[a], False, x[1]
            else:
                until, right_ended, b = scores[b], True, y[0]

    @staticmethod
    def tied(piece: str) -> bool:
        return MARK * 2 in piece or piece == MARK

    def table(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        known, sizes = self.fits.get, self.sizes
        last = [-1] * (len(text) + 1)  # by the end of a prefix
        last[0] = 0
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - size]
                if before >= 0:
                    fits = known(before << 15 | token)
                    if fits is None:
                        fits = self.fits[before << 15 | token] = not before or self.fit(before, token)
                    if fits:
                        last[end] = token
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        out, at = [], len(text)
        while at:
            token = last[at]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def chunk(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as text, and what they decode to."""
        if self.known.issuperset(text):
            ids = self.table(text)
        else:
            ids, start = [], 0
            for k, c in enumerate(text):
                if c not in self.known:
                    ids += self.table(text[start:k]) + [self.of_byte[b] for b in c.encode()]
                    start = k + 1
            ids += self.table(text[start:])
        return len(ids), " ".join(map(str, ids)), self.decoded(ids)

    def look(self, text: str) -> tuple[int, str, str]:
        found = self.memo.get(text)
        if found is None:
            found = self.older.pop(text, None) or self.chunk(text)
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            if len(text) < 64:
                self.memo[text] = found
        return found

    def forget(self) -> None:
        """Lets go of what was kept of texts: a worker that stays would hold it beside whatever runs in it next."""
        self.memo, self.older, self.fits = {}, {}, {}

    def parts(self, text: str):
        """Lists of chunks' results, for slices of a text that are cut where no token reaches over."""
        if not text:
            return
        text, at = MARK + text.replace(" ", MARK), 0
        while at < len(text):
            cut = SAFE.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut.start() if cut else len(text)
            yield [self.look(c) for c in CHUNK.findall(text, at, end)]
            at = end

    def encode(self, text: str, eos: bool = True) -> array:
        out = array("i")
        for found in self.parts(text):
            for x in found:
                out.extend(map(int, x[1].split()))
        if eos:
            out.append(self.eos)
        return out

    def decoded(self, ids) -> str:
        if self.mute.isdisjoint(ids):
            return "".join([self.plain[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte:
                held.append(self.byte[i])
                continue
            if held:
                out.append(loose(bytes(held)))
                held.clear()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.plain[i])
        return "".join([*out, loose(bytes(held))])

    def decode(self, ids) -> str:
        """Text of ids, exact for what encode gives: the space mark that encoding puts before the first piece goes."""
        first = next((i for i in ids if i not in self.silent), self.unknown)
        text = self.decoded(ids)
        return text if first == self.unknown else text.removeprefix(" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, and the SHA-256 of the ids as text and of what they decode to."""
        n, ids, back, first = 1, hashlib.sha256(), hashlib.sha256(), True
        for found in self.parts(text):
            n += sum([x[0] for x in found])
            ids.update((" ".join([x[1] for x in found]) + " ").encode())
            plain = "".join([x[2] for x in found])
            back.update((plain.removeprefix(" ") if first else plain).encode())
            first = False
        ids.update(str(self.eos).encode())
        return n, ids.hexdigest(), back.hexdigest()


def loose(data: bytes) -> str:
    """UTF-8, each byte that is part of none as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def _encoding(model: bytes, f, schema: str, types: tuple):
    """From rows doc_id, text: doc_id and what f gives for a text. Nothing of the texts is kept when it ends."""

    def run(batches):
        own = pieces(model)
        try:
            for b in batches:
                for i in range(0, b.num_rows, 2000):
                    part = b.slice(i, 2000)
                    rows = [f(own, t) for t in texts(part.column(1))]
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=[x.split()[0] for x in schema.split(", ")])
        finally:
            own.forget()

    return run


def _mapped(docs: DataFrame, model_path: str, f, schema: str, types: tuple) -> DataFrame:
    with open(model_path, "rb") as file:  # the driver's own vocabulary file; half a megabyte goes with the tasks
        model = file.read()

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoding(model, f, schema, types), schema)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int, the end id last) for each row of docs (doc_id, text).

    Null and empty texts have the end id alone; null or repeated ids and repeated rows stay as they are; an empty table
    gives no rows; other columns are not looked at.
    """
    return _mapped(docs, model_path, lambda p, t: (len(ids := p.encode(t)), ids), "doc_id long, n_tokens long, ids array<int>", (pa.int64(), pa.list_(pa.int32())))


def decode_ids(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text for each row of rows (doc_id, ids); null ids give an empty text."""
    with open(model_path, "rb") as file:
        model = file.read()

    def run(batches):
        own = pieces(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the ids that encode_documents gives and of their decoded text."""
    return _mapped(docs, model_path, lambda p, t: p.digest(t), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", (pa.int64(), pa.string(), pa.string()))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
