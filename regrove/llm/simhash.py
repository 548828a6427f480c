"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64 values of the text's word shingles. Two
fingerprints within `max_bits` bits differ in at most so many bytes, so they share at least n_bytes - max_bits positional bytes.
The index posts every distinct fingerprint under sets of `key_bytes` positional bytes, chosen so that any two fingerprints
sharing the guaranteed number of positional bytes meet under at least one set (Turan's block constructions). Inside a posting
list the shared positional bytes of each pair are tallied, pairs below the guaranteed minimum fall out, and the rest is verified
bit by bit.

Equal fingerprints are one node from the start. A posting list sends out a spanning forest of its links, never all its pairs:
the components are the same. Lists beyond `block` rows are dealt into cells of two blocks each, so no task holds a whole list.

Defined cases: null and empty texts have no shingles and fingerprint zero, linked like any other; a text of fewer words than
a shingle is one shingle; null ids are never a component's id unless all of it are null; repeated rows each keep their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regrove.llm.common import blocks, pick, table, words_of, written
from regrove.llm.graph import components

SEED = 42
#: Rows of a posting list that are compared in one piece.
BLOCK = 4096
#: Narrow rows (some 20 to 60 bytes) that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `shingle` words, space-joined, repeats included; of all words where there are fewer."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())], np.uint64)


def fingerprint_of(text: str | None, shingle: int = 4) -> bytes:
    """The fingerprint, big-endian."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 16_384):
        part = hashes[start:start + 16_384].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", shingle: int = 4) -> DataFrame:
    """The columns `keep` and fp (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            found = [fingerprint_of(t, shingle) for t in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(found, pa.binary())], [*keep, "fp"])

    picked = pick(docs, *keep, text)
    return picked.mapInArrow(run, T.StructType([*(picked.schema[c] for c in keep), T.StructField("fp", T.BinaryType())]))


def key_sets(n_bytes: int, shared: int, key_bytes: int) -> list[tuple[int, ...]]:
    """Sets of `key_bytes` positions such that any `shared` positions contain one of them.

    Two positions: `shared - 1` blocks, all pairs inside a block. Three: Turan's three blocks in a ring for four shared
    positions (triples inside a block, or two of one and one of the next), per group of positions where more are shared.
    """
    if key_bytes == 2:
        groups = np.array_split(np.arange(n_bytes), max(1, shared - 1))
        return [pair for g in groups for pair in itertools.combinations(g.tolist(), 2)]
    if key_bytes != 3:
        raise ValueError("keys have two or three bytes")
    found = []
    for group in np.array_split(np.arange(n_bytes), max(1, (shared - 1) // 3)):
        ring = [g.tolist() for g in np.array_split(group, 3)]
        for k, g in enumerate(ring):
            found += list(itertools.combinations(g, 3))
            found += [(*two, one) for two in itertools.combinations(g, 2) for one in ring[(k + 1) % 3]]
    return found


def postings(nodes: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(bucket, fp): each fingerprint under each of its keys; a bucket is a key set and the bytes at its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 4096):
            fps = batch.column(0).to_pylist()
            if not fps:
                continue
            by = np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1).astype(np.int64)
            for number, positions in enumerate(sets):
                bucket = np.full(len(fps), number, np.int64)
                for p in positions:
                    bucket = bucket << 8 | by[:, p]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0)], ["bucket", "fp"])

    return nodes.select("fp").mapInArrow(run, "bucket long, fp binary")


_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def forest(cell: np.ndarray, side: np.ndarray, by: np.ndarray, shared: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs, a spanning forest per cell. Rows are sorted by cell; side -1 pairs with all, 0 and 1 with each other."""
    label = np.arange(len(cell))
    left, right = [], []
    at, step = np.arange(len(cell)), 1
    while True:
        at = at[at + step < len(cell)]
        at = at[cell[at + step] == cell[at]]
        if not len(at):
            break
        open_ = at[(label[at] != label[at + step]) & ((side[at] < 0) | (side[at] != side[at + step]))]
        for start in range(0, len(open_), 65_536):
            i = open_[start:start + 65_536]
            j = i + step
            i = i[(by[i] == by[j]).sum(1) >= shared]  # the tally of shared positional bytes
            i = i[_BITS[by[i] ^ by[i + step]].sum(1, dtype=np.int64) <= max_bits]
            for a in i.tolist():
                b = a + step
                x, y = label[a], label[b]
                if x != y:
                    left.append(a)
                    right.append(b)
                    lo, hi = np.searchsorted(cell, cell[a]), np.searchsorted(cell, cell[a], "right")
                    inside = label[lo:hi]
                    inside[inside == max(x, y)] = min(x, y)
        step += 1
    return np.array(left, np.int64), np.array(right, np.int64)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcasting if it has at most so many (narrow) rows; else Spark shuffles for it."""
    return F.broadcast(df) if df.count() <= rows else df


def cells(rows: DataFrame, group: str, key: str, block: int) -> DataFrame:
    """`rows` with lo, hi, side: groups of over `block` rows are dealt by hash into blocks, and each row goes to every cell of two
    blocks that holds its own. In a cell lo = hi all rows meet (side -1), else rows of side 0 meet those of side 1."""
    large = written(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "large-groups")
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(block)), F.lit(1)).cast("int")
    dealt = rows.join(small_or_not(large), group, "left").select(*rows.columns, parts.alias("parts"), F.pmod(F.xxhash64(key), parts).cast("int").alias("own"))
    dealt = dealt.select(*rows.columns, "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return dealt.select(
        group, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), *[c for c in rows.columns if c != group])


def whole_cells(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first `n_keys` columns, in pieces that hold all rows of each key in them."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
        keys = np.stack([rows.column(c).to_numpy() for c in range(n_keys)])
        last = np.flatnonzero((keys != keys[:, -1:]).any(0))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on in the next batch
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield held


def links(nodes: DataFrame, sets: list[tuple[int, ...]], shared: int, max_bits: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that meet under a key set, share `shared` positional bytes at least
    and differ in `max_bits` bits at most, up to those that others imply."""
    dealt = cells(postings(nodes, sets), "bucket", "fp", block).repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: pa.Table) -> pa.RecordBatch:
            keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in range(3)])
            cell = np.cumsum(np.concatenate(([0], (keys[:, 1:] != keys[:, :-1]).any(0).astype(np.int64))))
            fps = rows.column(4).to_pylist()
            by = np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1)
            a, b = forest(cell, rows.column(3).to_numpy(), by, shared, max_bits)
            return pa.RecordBatch.from_arrays([pa.array([fps[i] for i in a.tolist()], pa.binary()), pa.array([fps[i] for i in b.tolist()], pa.binary())], ["a", "b"])

        yield from map(work, whole_cells(batches, 3))

    return dealt.mapInArrow(run, "a binary, b binary")


def reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root) of the fingerprints that have a link."""
    roots = written(components(edges), "roots")
    return roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root").distinct())


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4, key_bytes: int = 3, block: int = BLOCK) -> DataFrame:
    """Per row of `docs`: id, fp (binary, 64 bits), component (the smallest id reachable over links, its own included).

    The index is complete: two fingerprints within `max_bits` (at most 6) bits share 8 - max_bits positional bytes.
    """
    prints = written(fingerprints(docs, (id,), text, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id).alias("own")), "nodes")
    linked = reach(nodes, links(nodes, key_sets(8, 8 - max_bits, key_bytes), 8 - max_bits, max_bits, block)).join(nodes, "fp")
    least = linked.groupBy("root").agg(F.min("own").alias("component"))
    linked = linked.join(least, "root").select("fp", "component", F.lit(True).alias("linked"))
    found = nodes.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component")).otherwise(F.col("own")).alias("component"))
    found = written(found, "classes")  # so both sides of the next join come straight from a shuffle and a hot fingerprint can be split
    return prints.join(found, "fp").select(id, "fp", "component")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of `docs`, one of each group that `near_duplicates` links: that of the smallest id (null ids last, then the first row).

    Rows are written with numbers of their own before anything is decided, so a number means the same row when a task is run again.
    Texts without words are one group of exact copies; an empty table stays empty.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, value = (names[docs.columns.index(c)] for c in (id, text))
    numbered = written(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "numbered")
    ordered = numbered.select("row", F.struct(F.isnull(key).alias("n"), F.col(key).alias("id"), F.col("row")).alias("own"), F.col(value).alias("text"))
    found = near_duplicates(ordered, "own", "text", shingle, max_bits)
    dropped = written(found.where("own.row <> component.row").select("own.row"), "dropped")
    return numbered.join(dropped, "row", "left_anti").select(*names).toDF(*docs.columns)


def op1_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
