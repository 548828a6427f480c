"""Document fingerprints by Order MinHash, which follow edit distance where plain MinHash follows sets.

Every k-mer (k code points) is numbered by its occurrence in the text, so repeats count. For each of `size` hash functions the
`picks` smallest numbered k-mers are chosen, put back in text order, and their tuple is hashed to one signature component. Two
fingerprints are as like as the share of their equal components: text moved to another place changes tuples although the set of
k-mers stays.

Memory is about 60 bytes per code point of the longest text. Defined cases: null and empty texts have the empty k-mer alone; a
text shorter than k is one k-mer; equal texts have equal fingerprints; repeated rows follow each other in hash order of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from regrove.llm.common import blocks, pick, table

KMER, SIZE, PICKS = 8, 32, 2
_BASE = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _functions(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the hash functions, fixed by their number."""
    seeds = _mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(_BASE))
    return (seeds[:size] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[size:] >> np.uint64(32)).astype(np.uint32)


def numbered_kmers(text: str, k: int) -> np.ndarray:
    """Hashes of the text's k-mers with their occurrence numbers, in text order."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    k = min(k, len(points))
    if not k:
        return _mix(np.ones(1, np.uint64))
    # polynomial hashes of 1, 2, 4 ... code points, put together to k by its binary digits
    power, width, part = _BASE, 1, points
    whole, done = None, 0
    while True:
        if k & width:
            n = len(points) - k + 1
            piece = part[done:done + n]
            whole = piece.copy() if whole is None else whole * np.uint64(pow(_BASE, width, _MASK + 1)) + piece
            done += width
        if width * 2 > k:
            break
        part = part[:-width] * np.uint64(power) + part[width:]
        power = power * power & _MASK
        width *= 2
    order = np.argsort(whole, kind="stable")
    runs = whole[order]
    first = np.concatenate(([True], runs[1:] != runs[:-1]))
    starts = np.flatnonzero(first)
    number = np.empty(len(runs), np.uint64)
    number[order] = (np.arange(len(runs)) - np.repeat(starts, np.diff(np.append(starts, len(runs))))).astype(np.uint64)
    return _mix(whole + number * np.uint64(0xD6E8FEB86659FD93))


def signature(text: str | None, k: int = KMER, size: int = SIZE, picks: int = PICKS) -> np.ndarray:
    """`size` components of 32 bits."""
    kmers = numbered_kmers(text or "", k)
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    times, plus = _functions(size)
    chosen = np.empty((size, min(picks, len(kmers))), np.int64)
    values = np.empty_like(short)
    for j in range(size):
        np.multiply(short, times[j], out=values)
        values += plus[j]
        for i in range(chosen.shape[1]):
            at = int(values.argmin())
            chosen[j, i] = at
            values[at] = np.uint32(2**32 - 1)
    chosen.sort(axis=1)  # text order
    mixed = np.zeros(size, np.uint64)
    for i in range(chosen.shape[1]):
        mixed = _mix(mixed * np.uint64(_BASE) + kmers[chosen[:, i]])
    return (mixed >> np.uint64(32)).astype(np.uint32)


def to_text(components: np.ndarray) -> str:
    return components.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = KMER, size: int = SIZE, picks: int = PICKS) -> DataFrame:
    """Per document: id and fingerprint (8 hex digits per component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            found = [to_text(signature(t, k, size, picks)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], [id, "fingerprint"])

    picked = pick(docs, id, text)
    return picked.mapInArrow(run, T.StructType([picked.schema[id], T.StructField("fingerprint", T.StringType())]))


def with_next(docs: DataFrame, id: str, text: str, pieces: int) -> DataFrame:
    """Rows dealt into buckets of neighbouring ids, each with the first row of the following bucket as its sentinel, sorted by descending id.

    Bucket bounds are approximate percentiles of the (numeric) ids; null ids come last, dealt to as many buckets by ranges of the text's
    hash, which orders them. Only one narrow row per bucket comes to the driver.
    """
    named = pick(docs, id, text).select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    shares = [i / pieces for i in range(1, pieces)]
    bounds = sorted(set(named.agg(F.percentile_approx("id", shares, 100 * pieces)).first()[0] or [])) if shares else []
    kind = named.schema["id"].dataType
    listed = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast(T.ArrayType(kind))
    part = F.shiftright("hash", 32) + (1 << 31)  # 0 to 2^32, growing with the hash
    unnamed = -1 - F.shiftright(part * pieces, 32).cast("int")
    named = named.withColumn("bucket", F.when(F.col("id").isNull(), unnamed).otherwise(F.size(F.filter(listed, lambda b: b < F.col("id")))))
    # a bucket's first row: the highest id, then the lowest hash
    heads = {r["bucket"]: r["head"] for r in named.groupBy("bucket").agg(F.max(F.struct("id", F.bitwise_not("hash").alias("turned"))).alias("head")).collect()}
    order = sorted(heads, reverse=True)
    rows = [(b, heads[b]["id"], ~heads[b]["turned"], order[i - 1]) for i, b in enumerate(order)]  # order[-1]: the last bucket is followed by the first
    small = docs.sparkSession.createDataFrame(rows, T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("head", kind), T.StructField("head_hash", T.LongType()), T.StructField("before", T.IntegerType())]))
    named = named.join(F.broadcast(small), "bucket")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("sentinel"))
    sent = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("sentinel"))
    places = F.when(F.col("id").eqNullSafe(F.col("head")) & (F.col("hash") == F.col("head_hash")), F.array(own, sent)).otherwise(F.array(own))
    dealt = named.select(F.explode(places).alias("place"), "id", "text").select("place.bucket", "place.sentinel", "id", "text")
    count = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(count, "bucket").sortWithinPartitions("bucket", "sentinel", F.desc_nulls_last("id"), F.xxhash64("text"), "text")


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = KMER, size: int = SIZE, picks: int = PICKS) -> DataFrame:
    """Each document beside its edited text (second half replaced by the start of the next document) and its next document."""
    count = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: tuple, text: str, print_: np.ndarray) -> tuple:
            _, key, own, own_print = held
            cut = len(own) // 2
            edited = own[:len(own) - cut] + text[:cut]
            edited_print = signature(edited, k, size, picks)
            return (key, len(own), hashlib.sha256(edited.encode()).hexdigest(), to_text(own_print), to_text(edited_print),
                    likeness(own_print, edited_print), likeness(own_print, print_))

        held = None
        for part in blocks(batches):
            out = []
            for bucket, sentinel, key, value in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if sentinel and held is None:
                    continue  # further rows that equal the head
                print_ = signature(value, k, size, picks)
                if held is not None:
                    out.append(row(held, value, print_))
                held = None if sentinel else (bucket, key, value, print_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (key_type, *kinds), strict=True)], names)

    dealt = with_next(docs, id, text, 4 * count)
    names = [id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    key_type = to_arrow_type(dealt.schema["id"].dataType)
    added = [T.LongType(), *[T.StringType()] * 3, *[T.DoubleType()] * 2]
    schema = T.StructType([T.StructField(id, dealt.schema["id"].dataType), *[T.StructField(n, t) for n, t in zip(names[1:], added, strict=True)]])
    return dealt.mapInArrow(run, schema)


def op7_order_minhash(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
