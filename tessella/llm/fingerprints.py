"""Document fingerprints (SimHash) and their search by permuted block tables, by DataFrame operations alone.

Terms are the words of a text in lower case. A term votes with its 64-bit hash: +weight on each set bit, -weight on each
other; the fingerprint has the bits whose sum is above zero. The weight, twice the length beyond three characters, keeps
the frequent short words of a language from making all its texts alike. Sums of two bits share a long, which cannot
overflow: weights stay below two for each byte of a text, and a text below 2**31 bytes.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWEST, read, written

BOTH, LOW = 0x0000000100000001, 0xFFFFFFFF
LONGEST = 32  #: code points of a term that count towards its weight


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def hex64(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal bits."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def fold(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and `fp`, the fingerprint of the text of each of them. keys tell the rows apart; no words: 0."""
    words = rows.select(*keys, F.explode_outer(F.split(F.lower(text), r"\s+")).alias("term"))
    size = F.least(F.char_length("term"), F.lit(LONGEST))
    weight = F.when(F.coalesce(size, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), 2 * (size - 3))).cast("long")
    votes = words.select(*keys, F.xxhash64("term").alias("h"), weight.alias("w"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(BOTH)) * F.col("w")).alias(f"s{i}") for i in range(32)]
    found = votes.groupBy(*keys).agg(F.sum("w").alias("all"), *sums)
    fp = F.lit(0).cast("long")
    for i in range(32):
        for at, part in ((i, F.col(f"s{i}").bitwiseAND(F.lit(LOW))), (i + 32, F.shiftrightunsigned(f"s{i}", 32))):
            fp = fp.bitwiseOR(F.when(part * 2 > F.col("all"), F.lit(signed(1 << at))).otherwise(F.lit(0)).cast("long"))
    return found.select(*keys, fp.alias("fp"))


def _bucket(edges: list[tuple[int, int]]) -> tuple[Column, Column]:
    """The number of the last of sorted edges that is not above (key, h) of a row, and the array of the edges."""
    if not edges:
        return F.lit(0), F.array().cast("array<struct<key:bigint,h:bigint>>")
    held = F.arrays_zip(*[F.lit([e[k] for e in edges]).cast("array<bigint>").alias(c) for k, c in enumerate(("key", "h"))])
    own = F.struct("key", "h")
    steps = F.array(*[F.lit(1 << k) for k in range(len(edges).bit_length(), -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(held, p + s) <= own, p + s).otherwise(p)), held


def _edges(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """(key, h) of the first row of each of about n ranges of rows (key, h), at most 2 * n.

    Ranges are cut at approximate percentiles of the keys; a key that fills several is cut between its values of h.
    """
    low, cuts = rows.agg(F.min("key"), F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n))).first()
    if low is None:
        return []
    many = Counter([low, *(cuts if n > 1 else ())])
    inside, most = {}, max(many.values())
    if most > 1:
        large = [k for k, m in many.items() if m > 1]
        found = rows.where(F.col("key").isin(large)).groupBy("key").agg(F.percentile_approx("h", [i / most for i in range(1, most)], max(10_000, 4 * n)).alias("hs"))
        inside = {r["key"]: r["hs"][:: max(1, most // many[r["key"]])] for r in found.collect()}  # at most n cuts in all
    about = sorted({(k, h) for k in many for h in [LOWEST, *inside.get(k, [])]})
    firsts = rows.groupBy(_bucket(about)[0].alias("bucket")).agg(F.min(F.struct("key", "h")).alias("first")).select("first.*")
    return sorted((r["key"], r["h"]) for r in firsts.collect())  # one for each range


def in_sequence(docs: DataFrame, rows_each: int = 4000) -> DataFrame:
    """(bucket, rn, ghost, doc_id, text, next): the text of the next row in the order of doc_id; the first follows the last.

    Rows of one id are in the order of their texts' hashes, then of the texts. Buckets are ranges of about rows_each rows,
    so no task gets all rows; the first row of a bucket comes again at the end of the bucket before, as a ghost. Null ids
    come first, null texts are empty.
    """
    key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), F.coalesce("text", F.lit(""))
    ids = docs.select(key.alias("key"), F.xxhash64(text).alias("h"))
    edges = _edges(ids, min(1 << 16, max(1, math.ceil(ids.count() / rows_each))))
    at, held = _bucket(edges)
    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("bucket", at)
    before = F.when(F.col("bucket") == 0, len(edges) - 1).otherwise(F.col("bucket") - 1)
    head = F.get(held, F.col("bucket")) == F.struct("key", "h")
    places = F.filter(F.array(F.struct(F.col("bucket"), F.lit(False).alias("ghost")), F.when(head, F.struct(before.alias("bucket"), F.lit(True).alias("ghost")))), lambda p: p.isNotNull())
    rows = rows.select("key", "h", "doc_id", "text", F.explode(places).alias("p")).select("key", "h", "doc_id", "text", "p.bucket", "p.ghost")
    order = Window.partitionBy("bucket").orderBy("ghost", "key", "h", "text")
    return rows.select("bucket", F.row_number().over(order).alias("rn"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): n_chars, its fingerprint, that of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of the next row's text.
    One row is its own next; an empty table gives no rows; repeated ids are in the order of in_sequence(); other columns
    are not looked at. One shuffle: all later steps keep the buckets of in_sequence.
    """
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = in_sequence(docs).select(
        "bucket", "rn", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("next", F.lit("")), F.lit(1), quarter)).alias("edited"),
    )
    own = ["bucket", "rn", "ghost", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select(
        "bucket", "rn", "ghost", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("which", "t"),
    )
    prints = fold(both, [*own, "which"], "t").groupBy(*own).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    follow = F.lead("fp").over(Window.partitionBy("bucket").orderBy("rn"))
    return prints.select("*", follow.alias("next_fp")).where("not ghost").drop("bucket", "rn", "ghost")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of docs (doc_id, text)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return fold(rows, ["row", "doc_id"], "text").drop("row")


def find_within(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fp, distance): all distinct fingerprints of prints (fp) within the radius of those of queries (fp).

    Permuted block tables: the 64 bits are cut in radius + 3 blocks; two fingerprints that differ in at most `radius` bits
    agree in three of them at least. Each choice of three is a table keyed by those bits; a match there is verified. Null
    fingerprints match nothing; an empty table on either side gives no rows.
    """
    size = 64 / (radius + 3)
    blocks = [sum(1 << b for b in range(round(k * size), round((k + 1) * size))) for k in range(radius + 3)]
    masks = [signed(sum(c)) for c in itertools.combinations(blocks, 3)]

    def tables(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col("fp").alias(name)).where("fp is not null").distinct().select(name, F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(m)) for m in masks])).alias("t", "bits"))

    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    return tables(queries, "query").join(tables(prints, "fp"), ["t", "bits"]).where(distance <= radius).select("query", "fp", distance.alias("distance")).distinct()


def neighbours(rows: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, n_within): for each distinct fingerprint of queries (fp), the rows of rows (fp) within the radius of it."""
    held = rows.where("fp is not null").groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    return find_within(held, queries, radius).join(held, "fp").groupBy(F.col("query").alias("fp")).agg(F.sum("n").alias("n_within"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_within, for ids divisible by 50 (else null): the documents within three bits, found by the block tables."""
    rows = written(edited_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text")), "prints")
    query = F.col("doc_id") % 50 == 0
    found = neighbours(rows, rows.where(query)).withColumnRenamed("fp", "_query")
    rows = rows.join(found, F.when(query, F.col("fp")) == F.col("_query"), "left")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", hex64("fp").alias("fingerprint"), hex64("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "n_within",
    )
