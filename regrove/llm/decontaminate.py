"""Benchmark passages in documents: one Aho-Corasick automaton over normalised windows, each text scanned once.

Normal form: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` joined by one space. A window is `window` consecutive
words of an item; an item of fewer words (but not none) is one window. Patterns and texts carry a space at both ends, so
matches begin and end at words. Word numbers lead back to code points of the original text.

Defined cases: null or empty text has no words and no hits; null item ids count as the item "null"; null or wordless items have
no windows; repeated items or rows each keep their own result; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regrove.llm.common import UPPER, blocks, lower_sql, pick, table, written

WINDOW = 10
#: Windows in one automaton (about 0.5 kB each in memory, their patterns alone are broadcast). A larger benchmark is scanned in blocks of so many.
BLOCK_WINDOWS = 200_000

_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_NORMAL = bytes.maketrans(UPPER.encode() + _SEPARATORS, UPPER.lower().encode() + b" " * len(_SEPARATORS))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN = T.StructType([
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
])
HITS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("seen", T.ArrayType(T.LongType())), T.StructField("spans", T.ArrayType(SPAN)),
]


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


def windows(benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(pattern, item): the distinct windows of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            ids, patterns = [], []
            for key, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = normal_words(value)
                found = {b" ".join(words[i:i + window]).decode() for i in range(max(1, len(words) - window + 1))} if words else ()
                ids += [key] * len(found)
                patterns += sorted(found)
            yield pa.record_batch({"item": pa.array(ids, pa.string()), "pattern": pa.array(patterns, pa.string())})

    named = pick(benchmark, item, text).select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(cut, "item string, pattern string").select("pattern", "item").distinct()


def automaton(patterns: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """Of numbered patterns, over UTF-8 bytes, each shown as one character, so its positions are byte positions."""
    found = ahocorasick.Automaton()
    for number, pattern in patterns:
        found.add_word(f" {pattern.encode().decode('latin-1')} ", (number, len(pattern.encode()) + 2))
    found.make_automaton()
    return found


#: The automaton that this worker has built last, with the scan it belongs to: one is built per worker, not per task.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _kept_automaton(scan: str, patterns: list[tuple[int, str]]) -> ahocorasick.Automaton | None:
    if scan not in _BUILT:
        _BUILT.clear()
        _BUILT[scan] = automaton(patterns) if patterns else None
    return _BUILT[scan]


def hits_of(text: str | None, machine: ahocorasick.Automaton | None) -> tuple[int, np.ndarray, set[int]]:
    """Number of words, which of them are hit, and the numbers of the patterns that occur."""
    words = normal_words(text)
    hit, seen = np.zeros(len(words), bool), set()
    if machine and words:
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        starts: list[int] = []
        for end, (number, length) in machine.iter(line):
            if not starts:
                starts = (np.cumsum([0] + [len(w) + 1 for w in words]) + 1).tolist()
            seen.add(number)
            hit[bisect_left(starts, end - length + 2):bisect_left(starts, end + 1)] = True
    return len(words), hit, seen


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words, with their code points in the original text (end exclusive)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    if not len(edges):
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [{"first_word": a, "last_word": b - 1, "start": places[a][0], "end": places[b - 1][1]} for a, b in edges.reshape(-1, 2).tolist()]


def _scan(docs: DataFrame, keep: tuple[str, ...], text: str, patterns: list[tuple[int, str]]) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex
    renamed = [f"k{i}" for i in range(len(keep))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from regrove.llm.decontaminate import _kept_automaton  # the worker's own module, whose memory outlives the task

        machine = _kept_automaton(name, shared.value)
        for part in blocks(batches):
            out: dict[str, list] = {f.name: [] for f in HITS}
            for value in part.column(len(keep)).to_pylist():
                n, hit, seen = hits_of(value, machine)
                out["n_words"].append(n)
                out["n_hit"].append(int(hit.sum()))
                out["seen"].append(sorted(seen))
                out["spans"].append(spans_of(value, hit) if seen else [])
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([(f.name, pa.int64()) for f in SPAN])))
            yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], [*renamed, *out])

    picked = pick(docs, *keep, text)
    fields = [T.StructField(n, picked.schema.fields[i].dataType) for i, n in enumerate(renamed)]
    picked = picked.toDF(*renamed, "scanned")
    return picked.mapInArrow(scan, T.StructType([*fields, *HITS]))


def _merged(parts: DataFrame) -> DataFrame:
    """(row, hits) over the blocks of windows: the blocks' spans, sorted, laid over each other, so words that two blocks hit count once."""
    return parts.groupBy("k0").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("seen"))).alias("seen"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    ).withColumn("spans", F.expr(
        "aggregate(spans, cast(array() as array<struct<first_word:bigint,last_word:bigint,start:bigint,end:bigint>>), (a, s) -> "
        "case when size(a) > 0 and element_at(a, -1).last_word >= s.first_word - 1 then concat(slice(a, 1, size(a) - 1), array(named_struct("
        "'first_word', element_at(a, -1).first_word, 'last_word', greatest(element_at(a, -1).last_word, s.last_word), "
        "'start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))) else concat(a, array(s)) end)",
    )).withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.last_word - s.first_word + 1)"))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", bench_text: str = "text", bench_id: str = "item_id",
    window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, items: bool = True,
) -> DataFrame:
    """Per document: the columns `keep`, n_words, n_hit, spans (runs of hit words) and, if asked for, items (ids as text, sorted).

    The windows are counted first. Up to `block_windows` go to every task; a larger set is dealt into blocks by hash, the
    documents are scanned once per block, and the blocks' spans are merged per document. Tasks know windows by number. Which items
    hold a window is joined afterwards, once for each distinct set of windows that some document holds.
    """
    pairs = written(windows(benchmark, bench_text, bench_id, window), "windows")
    numbered = written(pairs.select("pattern").distinct().withColumn("number", F.monotonically_increasing_id()), "patterns")
    n_blocks = max(1, -(-numbered.count() // block_windows))
    names = [f"k{i}" for i in range(len(keep))]
    if n_blocks == 1:
        scanned = _scan(docs, keep, text, [(r["number"], r["pattern"]) for r in numbered.collect()])
    else:
        plain = pick(docs, *keep, text)
        rows = written(plain.toDF(*names, "scanned").withColumn("row", F.monotonically_increasing_id()), "numbered")
        every = None
        for k in range(n_blocks):
            block = numbered.where(F.pmod(F.xxhash64("pattern"), F.lit(n_blocks)) == k).collect()
            part = _scan(rows, ("row",), "scanned", [(r["number"], r["pattern"]) for r in block])
            every = part if every is None else every.union(part)
        merged = _merged(every).withColumnRenamed("k0", "row")
        scanned = rows.select("row", *names).join(merged, "row").select(*names, "n_words", "n_hit", "seen", "spans")
    if not items:
        return scanned.select(*names, "n_words", "n_hit", "spans").toDF(*keep, "n_words", "n_hit", "spans")
    scanned = written(scanned, "scanned")
    held = numbered.join(pairs, "pattern").select("number", "item")
    sets = scanned.where("size(seen) > 0").select("seen").distinct()
    named = sets.select("seen", F.explode("seen").alias("number")).join(held, "number").groupBy("seen").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = written(named, "item-sets")
    hit = scanned.where("size(seen) > 0").join(named, "seen").select(*names, "n_words", "n_hit", "items", "spans")
    clean = scanned.where("size(seen) = 0").select(*names, "n_words", "n_hit", F.array().cast("array<string>").alias("items"), "spans")
    return hit.union(clean).toDF(*keep, "n_words", "n_hit", "items", "spans")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL.format(lower_sql("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL.format(lower_sql("coalesce(text, '')"))} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS pattern
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM p),
g AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS pattern
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT g.r, g.k, g.i, p.item_id FROM g JOIN p USING (k, pattern)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS varchar) AS s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
