"""Toxicity of texts: gradient-boosted trees over dense features, with isotonic calibration.

Features come from the text alone: densities of a seed lexicon and of two lexicons learned from labels (words and word stems), how
near hits stand to words of the second person, capitals, punctuation, and obfuscated words (letters mixed with signs or digits,
read again with the usual substitutes). The learned lexicons hold terms by their smoothed log-odds between toxic and other
labelled documents. Trees never see features from a lexicon that saw their row: training rows are in two folds, each featured
with the lexicon of the other. A part of the rows is kept from the trees and calibrates their probabilities.

Training uses at most about `max_rows` labelled rows, chosen by hash (a documented bound); scoring covers every row and whole
texts. Rows with crc32(id as text) mod 4 = 2 are held out of everything that is learned.

Defined cases: null text is empty and gets a score like any other; null ids have no label; null labels are ignored; an id with
several labels takes their rounded mean; with no labelled row of either kind every score is the share of toxic labels (0 if none).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regrove.llm.common import blocks, crc_of, pick, table, written
from regrove.session import ensure_checkpoint_dir

MAX_ROWS = 20_000
MAX_TERMS = 4_000
THRESHOLD = 0.3

#: A start where labels are few: common insults.
SEED = frozenset("idiot idiots stupid moron morons dumb fool loser losers trash garbage scum pathetic disgusting worthless clown ugly hate jerk shut".split())
_YOU = frozenset("you your yours yourself u ur du dich dir dein deine euch euer tu te toi ton ta vous votre vos tú usted ustedes tus vosotros".split())
_EDGE = ".,;:!?\"'()[]{}<>|*#%&$-_/\\…«»“”„"
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": "", "+": "t"})
STEMS = (4, 5, 6)
FEATURES = (
    "words", "seed", "seed_density", "hits", "density", "strength", "strongest", "stem_hits", "stem_density", "you_density", "near_you",
    "capitals", "shouted", "punctuation", "exclaimed", "obfuscated", "uncovered", "digits", "distinct",
)


def terms_of(word: str) -> list[str]:
    """A word and its stems (marked by a trailing star)."""
    return [word, *[f"{word[:k]}*" for k in STEMS if len(word) > k]]


def features(text: str | None, lexicon: dict[str, float], memo: dict[str, tuple[float, float]]) -> list[float]:
    """FEATURES of one text. `memo` keeps the weights of words seen before."""
    raw = (text or "").split()
    n = max(1, len(raw))
    words = [w.strip(_EDGE).lower() for w in raw]
    seed = hits = stems = you = near = odd = uncovered = 0
    strength = strongest = 0.0
    last_hit = last_you = -100
    for i, w in enumerate(words):
        known = memo.get(w)
        if known is None:
            known = (lexicon.get(w, 0.0), max((lexicon.get(f"{w[:k]}*", 0.0) for k in STEMS if len(w) > k), default=0.0))
            if len(memo) < 500_000:
                memo[w] = known
        own, stem = known
        if own or stem:
            hits += own > 0
            stems += stem > 0
            strength += max(own, stem)
            strongest = max(strongest, own, stem)
        hit = own > 0 or stem > 0
        if w in SEED:
            seed += 1
            hit = True
        if not w.isalpha() and w and not w.isdigit():
            plain = w.translate(_LEET)
            if plain != w and plain.isalpha():
                odd += 1
                if plain in SEED or lexicon.get(plain):
                    uncovered += 1
                    hit = True
        if hit:
            last_hit = i
            near += i - last_you <= 5
        if w in _YOU:
            you += 1
            last_you = i
            near += i - last_hit <= 5
    size = max(1, len(text or ""))
    text = text or ""
    letters = text.upper()
    capitals = sum(map(str.isupper, raw))
    upper = sum(1 for a, b in zip(text, letters) if a == b and a.isalpha()) if len(letters) == len(text) else 0
    marks = sum(text.count(c) for c in ".,;:?\"'()-")
    return [
        math.log1p(len(raw)), math.log1p(seed), seed / n, math.log1p(hits), hits / n, strength / math.sqrt(n), strongest, math.log1p(stems), stems / n,
        you / n, math.log1p(near), upper / size, capitals / n, marks / size, text.count("!") / size, odd / n, math.log1p(uncovered),
        sum(text.count(c) for c in "0123456789") / size, len(set(words)) / n,
    ]


def term_counts(rows: DataFrame) -> DataFrame:
    """(fold, term, toxic, other): documents of each kind that hold a term. `rows` has text, label, fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 512):
            seen: dict[tuple[int, int], Counter] = {}
            for text, label, fold in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = {w.strip(_EDGE).lower() for w in (text or "").split()}
                seen.setdefault((fold, label), Counter()).update({t for w in words if w for t in terms_of(w)})
            keys = [(fold, term, count if label else 0, 0 if label else count) for (fold, label), c in seen.items() for term, count in c.items()]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*keys, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["fold", "term", "toxic", "other"])

    counted = rows.select("text", "label", "fold").mapInArrow(run, "fold int, term string, toxic long, other long")
    return counted.groupBy("fold", "term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _lexicon(counts: DataFrame, n_toxic: int, n_other: int, least: int, max_terms: int) -> dict[str, float]:
    """The strongest terms by log-odds, weighed by how often they occur; at most `max_terms` of them come to the driver."""
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    best = counts.where(F.col("toxic") >= least).withColumn("odds", odds).where("odds > 1.5")
    best = best.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(max_terms)
    return {r["term"]: r["odds"] for r in best.select("term", "odds").collect()}


def featured(rows: DataFrame, text: str, lexicons: list[dict[str, float]], which: str | None = None) -> DataFrame:
    """`rows` and `_features` (array); column `which` numbers the row's lexicon (else the first)."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)  # bounded by max_terms
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = shared.value
        memos: list[dict] = [{} for _ in lexicons]
        for part in blocks(batches):
            texts = part.column(names.index(text)).to_pylist()
            chosen = part.column(names.index(which)).to_pylist() if which else [0] * len(texts)
            found = [features(t, lexicons[k], memos[k]) for t, k in zip(texts, chosen, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.float64()))], [*names, "_features"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_features", T.ArrayType(T.DoubleType()))]))


def _training_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, max_rows: int) -> DataFrame:
    """text, label, fold, calibrate of at most about `max_rows` labelled rows outside the held-out quarter."""
    known = labels.where("label is not null and id is not null").groupBy("id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    known = known.where(crc_of("id") % 4 != 2)
    total = known.count()
    share = min(1.0, 0.97 * max_rows / max(1, total))
    known = known.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))
    crc = F.floor(crc_of("id") / 4)
    known = known.select("id", "label", (crc % 2).cast("int").alias("fold"), (F.floor(crc / 2) % 10 < 3).alias("calibrate"))
    rows = pick(docs, id, text).select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.join(F.broadcast(known), "id").select("text", "label", "fold", "calibrate")  # bounded by max_rows


def score_toxicity(
    docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
    label: str = "toxic", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS, threshold: float = THRESHOLD, trees: int = 25, depth: int = 4,
) -> DataFrame:
    """Columns `keep` of every row, held_out, score (0 to 1) and predicted (score >= threshold)."""
    ensure_checkpoint_dir(docs.sparkSession)
    given = pick(labels, label_id, label).select(F.col(label_id).alias("id"), F.col(label).cast("double").alias("label"))
    rows = written(_training_rows(docs, given, id, text, max_rows), "toxic-rows")
    sizes = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    n = [sum(c for (_, y), c in sizes.items() if y == k) for k in (0, 1)]
    every = pick(docs, *dict.fromkeys((*keep, id, text)))
    held = (crc_of(id) % 4 == 2).alias("held_out")
    if not n[0] or not n[1]:
        score = F.lit(n[1] / max(1, sum(n)))
        return every.select(*keep, held, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    counts = written(term_counts(rows), "terms")
    least = max(2, min(5, n[1] // 100))
    of = lambda fold: (sizes.get((fold, 1), 0), sizes.get((fold, 0), 0))
    # a row of fold 0 is featured by fold 1's lexicon and the other way round
    crossed = [_lexicon(counts.where(F.col("fold") == 1 - fold), *of(1 - fold), least, max_terms) for fold in (0, 1)]
    whole = _lexicon(counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), n[1], n[0], least, max_terms)
    table_ = written(featured(rows, "text", crossed, "fold").drop("text").withColumn("_features", array_to_vector("_features")), "toxic-features")
    trees_ = GBTClassifier(
        featuresCol="_features", labelCol="label", predictionCol="_predicted",
        maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=5,
    ).setProbabilityCol("_probability").setRawPredictionCol("_raw")
    fit_rows, calibration = table_.where("not calibrate"), table_.where("calibrate")
    if fit_rows.select("label").distinct().count() < 2 or calibration.select("label").distinct().count() < 2:
        fit_rows = calibration = table_
    model = trees_.fit(fit_rows)
    probability = vector_to_array("_probability")[1]
    step = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_calibrated").fit(
        model.transform(calibration).withColumn("_p", probability).select("_p", F.col("label").cast("double").alias("label")))
    scored = featured(every, text, [whole]).withColumn("_features", array_to_vector("_features"))
    scored = step.transform(model.transform(scored).withColumn("_p", probability))
    # steps of the calibration hold many rows; a thousandth of the trees' probability orders them
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("_calibrated") + 0.001 * F.col("_p")))
    scored = scored.select(*keep, held, score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
