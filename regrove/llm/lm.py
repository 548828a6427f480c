"""Language-model scores: a bigram model over hashed words, held in Elias-Fano tries that are sharded over the cluster.

Tokens are lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` and one end per text, which is also the context of a text's first word.
p(w | v) = (c(v w) + mu * u(w)) / (c(v) + mu), u(w) = (c(w) + add) / (N + add * (V + 1)): a Dirichlet prior around the smoothed unigram.
The trie keeps c(v w) / (c(v) + mu) in 8-bit codes of a logarithmic scale; the rest is worked out from exact counts.

Nothing that grows with the corpus meets in one place. Texts are tokenised in batches of about `batch_chars` characters with a
vocabulary of their own (a written table). Vocabularies are split by word hash into shards, which count words and number them; the
counts go back to the batches. Each batch then sends every shard its distinct bigrams with their training counts and the documents
they occur in; a shard merges the counts, builds its trie, looks all bigrams up, and returns sums per document. Words of high count
are split over shards by their successors. A bigram in more than an eighth of a batch's documents is sent without them and
answered by its value alone.

Limits: 2^32 distinct words; equal 64-bit hashes would merge two words. Defined cases: null and empty texts are one end token;
with no training token all counts are 0; null ids are in training as crc32 of the empty text says; repeated rows each count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from regrove.llm.common import blocks, crc_of, pick, table, words_of, written
from regrove.llm.elias_fano import Trie

BATCH_CHARS = 8_000_000
SHARD_WORDS, SHARD_TOKENS = 2_000_000, 2_000_000
ADD, MU = 0.1, 20.0
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; bytes of equal weight side by side, which compresses better."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], np.int64).tobytes()
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + head + pa.compress(body, "zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    size, count = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    head = np.frombuffer(blob, np.int64, 2 * count, 16)
    body = pa.decompress(blob[16 + 16 * count:], size, "zstd", asbytes=True) if size else b""
    out, at = [], 0
    for kind, n in head.reshape(-1, 2).tolist():
        dtype = np.dtype(chr(kind))
        raw = np.frombuffer(body, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(raw.T).reshape(-1).view(dtype))
        at += n * dtype.itemsize
    return out


def tokenised(docs: DataFrame, id: str, text: str, train: Column, batch_chars: int) -> DataFrame:
    """(batch, ids, train, data): data holds tokens per text, the texts' tokens as local numbers, the words' sorted hashes (0: the
    end, number 0) and their counts in training texts."""
    named = pick(docs, id, text)
    named = named.select(F.col(id).alias("id"), train.alias("train"), F.col(text).alias("text"))
    kind = to_arrow_type(named.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def flush(ids: list, trains: list, sizes: list, tokens: list, vocabulary: dict) -> pa.RecordBatch:
            digest = xxhash.xxh64_intdigest
            hashes = np.array([0] + [digest(w) or 1 for w in list(vocabulary)[1:]], np.uint64)
            names, local = np.unique(hashes, return_inverse=True)
            seq = local[np.concatenate(tokens)].astype(np.int32)
            learnt = np.repeat(np.array(trains, bool), sizes)
            counts = np.bincount(seq[learnt], minlength=len(names)).astype(np.int64)
            blob = packed(np.array(sizes, np.int32), seq, names, counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{number}"]), pa.array([ids], pa.list_(kind)), pa.array([trains], pa.list_(pa.bool_())), pa.array([blob], pa.binary()),
                 pa.array([len(names)], pa.int64()), pa.array([len(seq)], pa.int64())], ["batch", "ids", "train", "data", "n_words", "n_tokens"])

        ids, trains, sizes, tokens, chars = [], [], [], [], 0
        vocabulary: defaultdict = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        vocabulary[None] = 0
        for rows in blocks(batches):
            for key, learn, value in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                words = words_of(value)
                tokens.append(np.fromiter((vocabulary[w] for w in words), np.int32, len(words)))
                tokens.append(np.zeros(1, np.int32))
                ids.append(key)
                trains.append(bool(learn))
                sizes.append(len(words) + 1)
                chars += len(value or "")
                if chars >= batch_chars:
                    yield flush(ids, trains, sizes, tokens, vocabulary)
                    number += 1
                    ids, trains, sizes, tokens, chars = [], [], [], [], 0
                    vocabulary.clear()
                    vocabulary[None] = 0
        if ids:
            yield flush(ids, trains, sizes, tokens, vocabulary)

    schema = T.StructType([
        T.StructField("batch", T.StringType()), T.StructField("ids", T.ArrayType(named.schema["id"].dataType)), T.StructField("train", T.ArrayType(T.BooleanType())),
        T.StructField("data", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return named.mapInArrow(run, schema)


def word_counts(batches: DataFrame, shards: int) -> DataFrame:
    """(batch, shard, reply, distinct, seen, total): training counts and numbers inside the shard for each batch's words, in hash order."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
        for part in parts:
            for batch, blob in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                _, _, names, counts = unpacked(blob.as_py())
                at = [0, *np.searchsorted(names, bounds).tolist(), len(names)]
                rows = [(s, batch, packed(names[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(at, at[1:])) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["shard", "batch", "data"])

    def merge(rows: pa.Table) -> pa.Table:
        shard, batches_ = rows.column("shard")[0].as_py(), rows.column("batch").to_pylist()
        slices = [unpacked(b.as_py()) for b in rows.column("data")]
        names, local = np.unique(np.concatenate([s[0] for s in slices]), return_inverse=True)
        counts = np.bincount(local, weights=np.concatenate([s[1] for s in slices]), minlength=len(names)).astype(np.int64)
        replies, at = [], 0
        for own, _ in slices:
            numbers = local[at:at + len(own)]
            replies.append(packed(numbers.astype(np.int32), counts[numbers]))
            at += len(own)
        n = len(replies)
        return pa.table({
            "batch": batches_, "shard": pa.array([shard] * n, pa.int64()), "reply": pa.array(replies, pa.binary()), "distinct": pa.array([len(names)] * n, pa.int64()),
            "seen": pa.array([int((counts > 0).sum())] * n, pa.int64()), "total": pa.array([int(counts.sum())] * n, pa.int64())})

    sliced = batches.select("batch", "data").mapInArrow(cut, "shard long, batch string, data binary")
    return sliced.groupBy("shard").applyInArrow(merge, "batch string, shard long, reply binary, distinct long, seen long, total long")


def _places(first: np.ndarray, second: np.ndarray, count: np.ndarray, most: float, shards: int) -> np.ndarray:
    """Shard of each bigram: by its first word, and by its second too in so many parts as the first word's count asks for."""
    parts = (count // max(1.0, most)).astype(np.uint64) + np.uint64(1)
    mixed = (first * _GOLDEN + second % parts + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def batch_bigrams(left: pa.Table, right: pa.Table, offsets: list[int], total: int, seen: int, shards: int, add: float) -> list[tuple]:
    """Rows (shard, batch, data, ids, train) of one batch: a slice of bigrams per shard, and under a negative shard what the batch keeps."""
    batch, ids, train = (left.column(c)[0].as_py() for c in ("batch", "ids", "train"))
    sizes, seq, names, _ = unpacked(left.column("data")[0].as_py())
    replies = sorted(zip(right.column("shard").to_pylist(), right.column("reply").to_pylist()))
    parts = [(s, *unpacked(r)) for s, r in replies]
    numbers = np.concatenate([n.astype(np.uint64) + np.uint64(offsets[s]) for s, n, _ in parts])
    counts = np.concatenate([c for _, _, c in parts])
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    logs = np.log10((counts + add) / (total + add * (seen + 1)))
    base = np.add.reduceat(logs[seq], starts)
    known = np.add.reduceat((counts[seq] > 0).astype(np.int64), starts)
    before = np.concatenate(([0], seq[:-1]))  # every text ends with the end, number 0 of each batch's words
    keys = numbers[before] << np.uint64(32) | numbers[seq]
    order = np.lexsort((doc, keys))
    keys, doc_of, tokens = keys[order], doc[order], order
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc_of[1:] != doc_of[:-1])))
    at = np.flatnonzero(new)  # one entry per bigram and document
    times = np.diff(np.append(at, len(keys))).astype(np.int32)
    keys, doc_of, tokens = keys[at], doc_of[at], tokens[at]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    in_docs = np.diff(np.append(first, len(keys)))
    learnt = np.add.reduceat(np.where(np.array(train, bool)[doc_of], times, 0), first).astype(np.int64)
    own, v, w = keys[first], before[tokens[first]], seq[tokens[first]]
    place = _places(own >> np.uint64(32), own & np.uint64(2**32 - 1), counts[v], total / (4 * shards), shards)
    hot = (in_docs > len(sizes) / 8) & (len(sizes) >= 16)
    entry_hot = np.repeat(hot, in_docs)
    rows = [(-1 - (xxhash.xxh64_intdigest(batch) >> 2), batch, packed(sizes.astype(np.int64), known, base, own[hot], in_docs[hot].astype(np.int64), doc_of[entry_hot], times[entry_hot]), ids, train)]
    kept = np.where(hot, 0, in_docs)
    by_place = np.argsort(place, kind="stable")
    entry_first = np.concatenate(([0], np.cumsum(kept)))
    doc_of, times = doc_of[~entry_hot], times[~entry_hot]
    edges = np.flatnonzero(np.diff(place[by_place])) + 1
    for group in np.split(by_place, edges):
        lengths = kept[group]
        entries = np.repeat(entry_first[group] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        data = packed(own[group], learnt[group], counts[v[group]], counts[w[group]], lengths.astype(np.int32), doc_of[entries], times[entries])
        rows.append((int(place[group[0]]), batch, data, None, None))
    return rows


def shard_scores(rows: pa.Table, total: int, seen: int, add: float, mu: float) -> list[tuple]:
    """Answers (batch, data, ids, train) of one shard to each batch: sums per document, and values of the bigrams sent without documents."""
    if rows.column("shard")[0].as_py() < 0:
        return list(zip(*(rows.column(c).to_pylist() for c in ("batch", "data", "ids", "train")), strict=True))
    blobs = rows.column("data")
    keys, learnt, of_first = [], [], []
    for blob in blobs:
        k, n, c, *_ = unpacked(blob.as_py())
        keys.append(k[n > 0])
        learnt.append(n[n > 0])
        of_first.append(c[n > 0])
    every, local = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(local, weights=np.concatenate(learnt), minlength=len(every))
    context = np.zeros(len(every))
    context[local] = np.concatenate(of_first)
    trie = Trie(every, counts / (context + mu))
    out = []
    for batch, blob in zip(rows.column("batch").to_pylist(), blobs, strict=True):
        k, _, c_first, c_second, lengths, doc, times = unpacked(blob.as_py())
        p = trie.look_up(k) + mu / (c_first + mu) * (c_second + add) / (total + add * (seen + 1))
        logs = np.log10(p)
        sums = np.bincount(doc, weights=np.repeat(logs, lengths) * times)
        docs = np.unique(doc)
        alone = lengths == 0
        out.append((batch, packed(docs.astype(np.int32), sums[docs].astype(np.float32), k[alone], logs[alone]), None, None))
    return out


def score_texts(
    docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", add: float = ADD, mu: float = MU, batch_chars: int = BATCH_CHARS,
    shard_words: int = SHARD_WORDS, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Per document: id, in_training, n_tokens, n_known, train_tokens, base_score (unigram), score (the model's log10 probability).

    `train` is a condition on the column `id` of `docs`.
    """
    batches = written(tokenised(docs, id, text, train, batch_chars), "lm-batches")
    id_type = batches.schema["ids"].dataType
    kinds = {"shard": pa.int64(), "batch": pa.string(), "data": pa.binary(), "ids": pa.list_(to_arrow_type(id_type.elementType)), "train": pa.list_(pa.bool_())}
    sizes = batches.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    shards = lambda n, most: max(1, -(-(n or 0) // most))
    counts = written(word_counts(batches, shards(sizes[0], shard_words)), "lm-words")
    per_shard = counts.groupBy("shard").agg(F.first("distinct"), F.first("seen"), F.first("total")).orderBy("shard").collect()  # a row per shard
    offsets, at = {}, 0
    for shard, distinct, _, _ in per_shard:
        offsets[shard] = at
        at += distinct
    if at >= 2**32:
        raise ValueError(f"{at} distinct words; word numbers have 32 bits")
    seen, total, n_shards = sum(r[2] for r in per_shard), sum(r[3] for r in per_shard), shards(sizes[1], shard_tokens)
    as_table = lambda rows, names: pa.table([pa.array(v, kinds[n]) for v, n in zip(zip(*rows, strict=True), names, strict=True)], list(names))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        return as_table(batch_bigrams(left, right, offsets, total, seen, n_shards, add), ("shard", "batch", "data", "ids", "train"))

    def answer(rows: pa.Table) -> pa.Table:
        return as_table(shard_scores(rows, total, seen, add, mu), ("batch", "data", "ids", "train"))

    def add_up(rows: pa.Table) -> pa.Table:
        own = next(i for i, x in enumerate(rows.column("ids")) if x.is_valid)
        n_tokens, n_known, base, hot, in_docs, doc, times = unpacked(rows.column("data")[own].as_py())
        score, values = np.zeros(len(n_tokens)), np.zeros(len(hot))
        for i, blob in enumerate(rows.column("data")):
            if i != own:
                docs_, sums, keys, logs = unpacked(blob.as_py())
                score[docs_] += sums
                values[np.searchsorted(hot, keys)] = logs
        score += np.bincount(doc, weights=np.repeat(values, in_docs) * times, minlength=len(score))
        ids, trained = rows.column("ids")[own].values, rows.column("train")[own].values
        return pa.table([ids, trained, n_tokens, n_known, pa.array(np.full(len(score), total)), base, score], ["id", "in_training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    row = T.StructType([T.StructField("batch", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("ids", id_type), T.StructField("train", T.ArrayType(T.BooleanType()))])
    sent = batches.select("batch", "data", "ids", "train").groupBy("batch").cogroup(counts.select("batch", "shard", "reply").groupBy("batch")).applyInArrow(
        send, T.StructType([T.StructField("shard", T.LongType()), *row]))
    answers = sent.groupBy("shard").applyInArrow(answer, row)
    result = T.StructType([T.StructField("id", id_type.elementType), T.StructField("in_training", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return answers.groupBy("batch").applyInArrow(add_up, result).withColumnRenamed("id", id)


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), crc_of("doc_id") % 10 != 0)
    return scored.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
