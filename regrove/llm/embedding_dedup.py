"""Near-duplicate embeddings by sorted projection passes.

A pass hashes every vector with the signs of `BITS` random projections, joined to one number, and orders the vectors by it: vectors
at a small angle agree in most signs, so in some passes they stand next to each other. Each vector is compared with the `window`
vectors before it, by cosine in double precision, and pairs below the threshold fall out. The verified pairs of all passes are united
to components. How many passes are made follows from the number of vectors and the recall asked for at the threshold itself: a pair
meets in a pass if it agrees in about log2(vectors / window) leading signs, each with probability 1 - angle / pi.

A window is bounded, a group of near copies is not: so links are counted by comparing all vectors of a component, in cells of two
blocks of bounded size. What the windows must find is only that a vector belongs to its component, through any of its neighbours.
No pair is written: windows send out spanning forests, cells send out counts.

Vectors with the same components are one node with a count from the start. Defined cases: vectors that are null, empty or zero, or
hold a null or non-finite component, link with nothing; vectors of different lengths never link; null ids are never a component's id
unless all of it are null; repeated rows each keep their own; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regrove.llm.common import blocks, pick, table, written
from regrove.llm.graph import components
from regrove.llm.simhash import cells, whole_cells

COSINE = 0.95
#: Signs per pass: enough for 2^48 windows.
BITS = 48
WINDOW = 64
#: Chance that a pair at the threshold is met in some pass.
RECALL = 0.995
#: Passes whose rows are shuffled at a time; their shuffle files go before the next ones are written.
TOGETHER = 3
#: Vectors of a component that are compared in one piece, and least rows of a sorted partition.
BLOCK, LEAST_ROWS = 512, 8192


@contextmanager
def shuffle_files_released(spark: SparkSession):
    """Shuffle files go when their job ends: every table here is written, so none is needed later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def n_passes(vectors: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    agree = 1 - math.acos(cosine) / math.pi
    met = agree ** max(0.0, math.log2(max(1, vectors) / window))
    return 1 if met >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def digests(rows: DataFrame, id: str, vector: str, keep_vector: bool) -> DataFrame:
    """id, digest (null for vectors that link with nothing) and, if asked for, vec (its components' bytes) and dim."""
    picked = pick(rows, id, vector)
    wide = picked.schema[vector].dataType.elementType != T.FloatType()
    kind = np.dtype("<f8" if wide else "<f4")
    picked = picked.select(F.col(id).alias("id"), F.col(vector).cast("array<double>" if wide else "array<float>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 4096):
            lists = part.column(1)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat = np.asarray(pc.fill_null(lists.flatten(), math.nan)).astype(kind)
            out: list[list] = [[], [], []]
            for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                own = flat[end - size:end]
                good = size and np.isfinite(own).all() and own.any()
                raw = own.tobytes() if good else None
                out[0].append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
                out[1].append(raw)
                out[2].append(size)
            found = [part.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32())]
            yield pa.RecordBatch.from_arrays(found if keep_vector else found[:2], ["id", "digest", "vec", "dim"][:4 if keep_vector else 2])

    fields = [picked.schema["id"], T.StructField("digest", T.BinaryType()), T.StructField("vec", T.BinaryType()), T.StructField("dim", T.IntegerType())]
    return picked.mapInArrow(run, T.StructType(fields if keep_vector else fields[:2]))


def units(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows of length one, in doubles. Scaled by the largest component first, so no square overflows or vanishes."""
    rows = np.frombuffer(b"".join(raw), np.dtype("<f8") if len(raw[0]) == 8 * dim else np.dtype("<f4")).astype(np.float64).reshape(len(raw), dim)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def projected(nodes: DataFrame, passes: list[int], seed: int) -> DataFrame:
    """(pass, dim, key, node, vec): every vector once per pass, under its signs."""
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for part in blocks(batches, 2048):
            dims = part.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                own = part.filter(pa.array(dims == dim))
                rows = units(own.column(2).to_pylist(), dim)
                for number in passes:
                    if (number, dim) not in planes:
                        planes[number, dim] = np.random.default_rng((seed, number, dim)).standard_normal((dim, BITS))
                    key = (rows @ planes[number, dim] > 0) @ weights
                    fixed = [pa.array(np.full(len(key), x, np.int32)) for x in (number, dim)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(key), own.column(0), own.column(2)], ["pass", "dim", "key", "node", "vec"])

    return nodes.select("node", "dim", "vec").mapInArrow(run, "pass int, dim int, key long, node long, vec binary")


def _forest(rows: np.ndarray, nodes: np.ndarray, label: np.ndarray, first: int, cosine: float, window: int, step: int = 64) -> list[tuple[int, int]]:
    """Links of rows from `first` on to the `window` rows before each, a spanning forest of them; `label` is kept up."""
    found = []
    for start in range(first, len(rows), step):
        lo, hi = max(0, start - window), min(len(rows), start + step)
        near = rows[lo:hi] @ rows[start:hi].T >= cosine
        i, j = np.nonzero(near)
        i, j = i + lo, j + start
        apart = j - i
        inside = (apart > 0) & (apart <= window)
        i, j = i[inside], j[inside]
        while len(i):
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
            if len(i):
                a, b = i[0], j[0]
                found.append((int(nodes[a]), int(nodes[b])))
                x, y = label[a], label[b]
                part = label[lo:hi]
                part[part == max(x, y)] = min(x, y)
    return found


_COMPARED = "a long, b long, edge int, side int, place int, pass int, dim int, vec binary"


def compared(dealt: DataFrame, cosine: float, window: int) -> DataFrame:
    """Links (a, b) inside the sorted partitions of `dealt`; and the rows (a) that stand within a window of an edge between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        names = [x.split()[0] for x in _COMPARED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

        def edge(rows: pa.Table, which: int, side: int) -> pa.RecordBatch:
            n = rows.num_rows
            columns = [rows.column("node"), pa.nulls(n, pa.int64()), pa.array([which] * n), pa.array([side] * n), pa.array(range(n)), rows.column("pass"), rows.column("dim"), rows.column("vec")]
            flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(flat, kinds, strict=True)], names)

        head: pa.Table | None = None
        tail: pa.Table | None = None
        group, rows, nodes, label = None, None, None, None
        for part in blocks(batches, 4096):
            if not part.num_rows:
                continue
            here = pa.table(part)
            head = here.slice(0, window) if head is None else head if head.num_rows >= window else pa.concat_tables([head, here.slice(0, window - head.num_rows)])
            tail = here.slice(max(0, here.num_rows - window)) if tail is None or here.num_rows >= window else pa.concat_tables([tail, here]).slice(max(0, tail.num_rows + here.num_rows - window))
            both = part.column(0).to_numpy().astype(np.int64) << 32 | part.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(both)) + 1).tolist(), len(both)]
            found = []
            for lo, hi in zip(cuts, cuts[1:]):
                own = units(part.column(4).slice(lo, hi - lo).to_pylist(), int(both[lo] & 0xFFFFFFFF))
                names_ = part.column(3).slice(lo, hi - lo).to_numpy()
                if both[lo] != group:
                    group, rows, nodes, label = both[lo], own[:0], names_[:0], np.zeros(0, np.int64)
                first = len(rows)
                fresh = int(label.max()) + 1 if first else 0
                rows, nodes, label = np.concatenate([rows, own]), np.concatenate([nodes, names_]), np.concatenate([label, np.arange(fresh, fresh + len(own))])
                found += _forest(rows, nodes, label, first, cosine, window)
                rows, nodes, label = rows[-window:], nodes[-window:], label[-window:].copy()
            if found:
                pairs = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.nulls(len(pairs), k) for k in kinds[2:])], names)
        if head is not None:
            yield edge(head, number, 1)
            yield edge(tail, number + 1, 0)

    return dealt.mapInArrow(run, _COMPARED)


def across_edges(edges: DataFrame, cosine: float, window: int) -> DataFrame:
    """Links (a, b) between rows that two neighbouring partitions hold (columns job and those of `compared`)."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("place", "ascending")])
        both = np.asarray(rows.column("pass")).astype(np.int64) << 32 | np.asarray(rows.column("dim"))
        side, found = np.asarray(rows.column("side")), []
        meet = both[side == 0][-1:]
        own = rows.filter(pa.array(both == meet[0])) if len(meet) else rows.slice(0, 0)
        side = np.asarray(own.column("side"))
        if len(side) and side[-1]:
            at = int((side == 0).sum())
            found = _forest(units(own.column("vec").to_pylist(), int(meet[0] & 0xFFFFFFFF)), np.asarray(own.column("a")), np.arange(len(side)), at, cosine, window)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return edges.groupBy("job", "edge").applyInArrow(run, "a long, b long")


def window_links(nodes: DataFrame, passes: int, cosine: float = COSINE, window: int = WINDOW, seed: int = 5, together: int = TOGETHER) -> DataFrame:
    """(a, b): verified links between nodes (columns node, dim, vec) that some pass puts within a window, up to those that others imply."""
    spark, n = nodes.sparkSession, nodes.count()
    jobs = []
    for job, start in enumerate(range(0, passes, together)):
        these = list(range(start, min(passes, start + together)))
        parts = max(1, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(these) // LEAST_ROWS))
        dealt = projected(nodes, these, seed).repartitionByRange(parts, "pass", "dim", "key").sortWithinPartitions("pass", "dim", "key", "node")
        jobs.append(written(compared(dealt, cosine, window), "window-links").withColumn("job", F.lit(job)))
    every = jobs[0]
    for part in jobs[1:]:
        every = every.union(part)
    return every.where("edge is null").select("a", "b").union(across_edges(every.where("edge is not null"), cosine, window))


def link_counts(members: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(node, links): weights (m) of the other nodes at that cosine, for nodes (columns root, node, m, dim, vec) of one component each."""
    dealt = cells(members.select("root", "node", "m", "dim", "vec"), "root", "node", block).repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches, 3):
            keys = np.stack([np.asarray(rows.column(c)).astype(np.int64) for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), keys.shape[1]]
            side, node, m = (np.asarray(rows.column(c)).astype(np.int64) for c in ("side", "node", "m"))
            total = np.zeros(len(node), np.int64)
            for lo, hi in zip(cuts, cuts[1:]):
                own = units(rows.column("vec").slice(lo, hi - lo).to_pylist(), rows.column("dim")[lo].as_py())
                if side[lo] < 0:
                    near = own @ own.T >= cosine
                    np.fill_diagonal(near, False)
                    total[lo:hi] = near @ m[lo:hi]
                else:
                    left, right = np.flatnonzero(side[lo:hi] == 0), np.flatnonzero(side[lo:hi] == 1)
                    near = own[left] @ own[right].T >= cosine
                    total[lo + left], total[lo + right] = near @ m[lo + right], near.T @ m[lo + left]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], ["node", "links"])

    return dealt.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(
    rows: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL, passes: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """Per row of `rows`: id, n_links (other rows at that cosine or more), component (the smallest id reachable), kept (its own id is that)."""
    with shuffle_files_released(rows.sparkSession):
        given = digests(rows, id, vector, True).where("digest is not null")
        nodes = given.groupBy("digest").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("least"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
        nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
        made = passes or n_passes(nodes.count(), cosine, window, recall)
        roots = written(components(window_links(nodes, made, cosine, window)), "vector-roots")
        members = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        counts = written(link_counts(members.join(nodes.select("node", "m", "dim", "vec"), "node"), cosine, block), "link-counts")
        narrow = nodes.select("digest", "node", "m", "least")
        linked = members.join(narrow, "node")
        reached = linked.groupBy("root").agg(F.min("least").alias("component"))
        linked = linked.join(reached, "root").join(counts, "node").select("digest", (F.col("m") - 1 + F.col("links")).alias("n_links"), "component")
        single = narrow.join(members, "node", "left_anti").select("digest", (F.col("m") - 1).alias("n_links"), F.col("least").alias("component"))
        classes = written(linked.union(single), "vector-classes")
    every = digests(rows, id, vector, False)
    known = every.where("digest is not null").join(classes, "digest").select("id", "n_links", "component")
    alone = every.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return known.union(alone).select(F.col("id").alias(id), "n_links", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op12_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")
