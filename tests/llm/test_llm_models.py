"""Toxicity, mixing, the language model and its Elias-Fano tries."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from texts import prose

from regrove.llm import elias_fano, lm, mixing, toxicity
from regrove.llm.common import crc_of, words_of


# Elias-Fano

def test_sequences_hold_and_find_their_values():
    r = np.random.default_rng(1)
    for universe, n in ((10, 10), (1, 1), (1000, 3), (10**12, 5000), (5000, 4000)):
        values = np.unique(r.integers(0, universe, n)).astype(np.uint64)
        held = elias_fano.EliasFano(values, universe)
        assert (held.access(np.arange(len(values))) == values).all()
        asked = r.integers(0, universe, 500).astype(np.uint64)
        place = {int(v): i for i, v in enumerate(values)}
        assert held.find(asked).tolist() == [place.get(int(x), -1) for x in asked]
    assert elias_fano.EliasFano(np.zeros(0, np.uint64), 1).find(np.array([0, 5], np.uint64)).tolist() == [-1, -1]


def test_directories_take_an_eighth_of_what_they_index():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 3000, 200_000).astype(np.uint64) << np.uint64(32) | r.integers(0, 20_000, 200_000).astype(np.uint64))
    trie = elias_fano.Trie(keys, r.uniform(1e-5, 1, len(keys)))
    held = trie.successors
    assert held.ones.nbytes + held.zeros.nbytes <= held.high.nbytes / 8
    assert trie.bytes <= 2.5 * len(keys)  # the keys alone are 8 bytes each, their numbers as many


def test_trie_looks_up_numbers_within_a_code_step():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 300, 20_000).astype(np.uint64) << np.uint64(32) | r.integers(0, 1000, 20_000).astype(np.uint64))
    numbers = r.uniform(1e-5, 1, len(keys))
    trie = elias_fano.Trie(keys, numbers)
    assert np.abs(np.log10(trie.look_up(keys) / numbers)).max() <= trie.step
    assert (trie.look_up(keys ^ np.uint64(1 << 20)) == 0).all()
    assert (elias_fano.Trie(np.zeros(0, np.uint64), np.zeros(0)).look_up(keys[:3]) == 0).all()


# Language model

@pytest.mark.parametrize("sizes", [{}, {"batch_chars": 500, "shard_words": 50, "shard_tokens": 300}])
def test_scores_match_brute_force(messy, messy_rows, sizes):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, *r[1:]) for r in lm.score_texts(messy, crc_of("doc_id") % 10 != 0, **sizes).collect()))
    tokens = [words_of(r[1]) + [None] for r in messy_rows]
    train = [bool(zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10) for r in messy_rows]
    words, pairs = Counter(), Counter()
    for t, own in zip(tokens, train):
        if own:
            words.update(t)
            pairs.update(zip([None, *t[:-1]], t))
    n, v = sum(words.values()), len(words)
    u = lambda w: (words[w] + 0.1) / (n + 0.1 * (v + 1))
    p = lambda a, w: (pairs[a, w] + lm.MU * u(w)) / (words[a] + lm.MU)
    expected = sorted((r[0] is None, r[0] or 0, own, len(t), sum(words[w] > 0 for w in t), n, sum(math.log10(u(w)) for w in t), sum(math.log10(p(a, w)) for a, w in zip([None, *t[:-1]], t)))
                      for r, t, own in zip(messy_rows, tokens, train))
    assert [g[:6] for g in got] == [e[:6] for e in expected]
    for g, e in zip(got, expected):
        assert g[6] == pytest.approx(e[6], abs=1e-6) and g[7] == pytest.approx(e[7], abs=0.02 * e[3])
    total = sum(p("x", w) for w in words) + lm.MU * 0.1 / (n + 0.1 * (v + 1)) / (words["x"] + lm.MU)
    assert total == pytest.approx(1)  # the seen words and one unseen


def test_scores_without_training_text(messy, nothing):
    rows = lm.score_texts(messy, F.lit(False)).collect()
    assert len(rows) == messy.count() and all(r["train_tokens"] == r["n_known"] == 0 and r["score"] == pytest.approx(0) for r in rows)
    assert lm.score_texts(nothing, F.lit(True)).count() == 0


# Mixing

def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        rest = (left - sum(full.values())) / max(1, sum(weight[s] for s in open_))
        above = [s for s in open_ if rest * weight[s] > 2 * sizes[s] + 1e-9]
        if not above:
            return full | {s: rest * weight[s] for s in open_}
        full |= {s: 2.0 * sizes[s] for s in above}


def check_mix(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [tuple(r) for r in mixing.mix(frame).collect()]
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len((text or "").split())
    targets = brute_targets(sizes)
    assert sorted((r[0] is None, r[0] or 0, r[2]) for r in got) == sorted((i is None, i or 0, len((t or "").split())) for i, _, t in rows)
    for _, source, size, source_size, target, copies, words in got:
        assert source_size == sizes[source] and target == pytest.approx(targets[source]) and words == copies * size <= 2 * size
        taken[source] += words
    largest = max(len((t or "").split()) for _, _, t in rows)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 2 * largest + 0.01 * targets[s]
    return got


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 7}", "w " * (1 + i * i % 60)) for i in range(3000)] + [(None, None, None), (5, "z", ""), (6, None, "a b"), (6, None, "a b")]
    first = check_mix(spark, rows)
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    by = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, mixing.mix(frame).collect()), key=by) == sorted(first, key=by)


def spark_hash(*values, seed=42):
    """Spark's xxhash64 of strings, longs and (as bytes) ints, nulls left out, as a signed number."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_mix(rows, seed=7):
    """The reduction tree of duels in plain Python, from the same hashes: id, source, size, target, copies."""
    one, chunk = mixing.ONE, mixing.CHUNK
    sizes = [(id, source, len(words_of(text))) for id, source, text in rows]
    source_size = Counter()
    for _, source, size in sizes:
        source_size[source] += size
    names = sorted(source_size, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * sum(source_size.values()) - 2 * sum(source_size[s] for s in full)
        share = left / max(1, sum(weights[s] for s in names if s not in full))
        more = {s for s in names if s not in full and 2 * source_size[s] < share * weights[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * source_size[s] if s in full else share * weights[s] for s in names}
    f = {s: round(min(2.0, target[s] / source_size[s]) * one) if source_size[s] else 0 for s in names}
    units, settled = [], []
    for (id, source, size), m in Counter(sizes).items():
        h = spark_hash(None if id is None else str(id), source, size, struct.pack("<i", seed))
        unit = [size, h, id, m, m * (f[source] % one) // one, m * (f[source] % one) % one]
        (settled if not unit[5] or not size else units).append((source, math.floor(math.log2(max(size, 1)) * 4), unit))
    for _, _, unit in settled:
        unit[5] = 0
    count = Counter((s, band) for s, band, _ in units)
    chunks = {k: -(-n // chunk) for k, n in count.items()}
    level = defaultdict(list)
    for s, band, unit in units:
        level[s, band, unit[1] % chunks[s, band]].append(unit)
    most, depth, out = max(chunks.values(), default=0), 0, [(s, u) for s, _, u in settled]
    while True:
        rest = {}
        for place, own in level.items():
            carry = None
            for x in sorted(own, key=lambda u: (u[0], u[1], u[2] is not None, u[2] or 0), reverse=True):
                if carry is None:
                    carry = x
                    continue
                draw, both = spark_hash(carry[1], x[1], seed + depth) % one, carry[5] + x[5]
                if both < one:
                    stays = draw * both < carry[5] * one
                    kept, done, p, q = (carry, x, both, 0) if stays else (x, carry, both, 0)
                elif both == one:
                    kept, done, p, q = (carry, x, one, 0) if draw < carry[5] else (x, carry, one, 0)
                else:
                    first = draw * (2 * one - both) < (one - x[5]) * one
                    kept, done, p, q = (x, carry, both - one, one) if first else (carry, x, both - one, one)
                out.append((place[0], [*done[:5], q]))
                kept = [*kept[:5], p]
                if both == one:
                    out.append((place[0], kept))
                    kept = None
                carry = kept
            if carry is not None:
                rest[place] = carry
        level = defaultdict(list)
        if most > 1:
            most = -(-most // chunk)
            for (s, band, slot), unit in rest.items():
                level[s, band, slot // chunk].append(unit)
        elif most >= 0:
            most = -1
            for (s, _, _), unit in rest.items():
                level[s, 0, 0].append(unit)
        else:
            out += [(s, [*u[:5], one if spark_hash(u[1], struct.pack("<i", seed - 1)) % one < u[5] else 0]) for (s, _, _), u in rest.items()]
            break
        depth += 1
    found = []
    for s, (size, _, id, m, k, p) in out:
        extra = k + p // one
        found += [(id, s, size, f[s] // one + (i < extra)) for i in range(m)]
    return found


def test_mix_matches_the_duels_in_plain_python(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 7}", "w " * (1 + i * i % 60)) for i in range(1500)] + [(None, None, None), (5, "z", ""), (6, None, "a b"), (6, None, "a b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got) == Counter(brute_mix(rows))


def test_mix_of_repeated_rows(spark):
    got = check_mix(spark, [(1, "a", "w w w")] * 500 + [(2, "b", "w")] * 3 + [(3, "c", "w w")] * 900)
    assert len(got) == 1403


def test_very_many_equal_rows_are_told_off_in_stretches(spark, monkeypatch):
    rows = [(1, "a", "w w w")] * 500 + [(2, "b", "w")] * 3 + [(3, "c", "w w")] * 900
    whole = Counter(check_mix(spark, rows))
    monkeypatch.setattr(mixing, "STRETCH", 64)
    assert Counter(check_mix(spark, rows)) == whole


def test_fractions_are_kept_in_expectation(spark):
    rows = [(i, "abc"[i % 3], "w " * 10) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").cache()
    copies = defaultdict(list)
    for seed in range(6):
        for r in mixing.mix(frame, seed=seed).collect():
            copies[r["source"]].append((r["copies"], r["target"] / r["source_size"]))
    for values in copies.values():
        assert sum(c for c, _ in values) / len(values) == pytest.approx(values[0][1], abs=0.02)


def test_mix_of_messy_rows(messy, nothing):
    assert mixing.mix(messy).count() == messy.count()
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(messy.where("text is null or text = ''")).agg(F.sum("taken")).first()[0] == 0


# Toxicity

def test_toxicity_learns_planted_words_and_leaves_held_out_labels_alone(spark):
    insults = ["blarg", "grumf", "zwosh"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = prose(i, 60).split()
        if toxic:
            for k in range(3):
                words[(7 * i + 11 * k) % 60] = insults[(i // 4 + k) % 3] + "x" * (k == 2)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, given, trees=5).join(given, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in held) and sum(r["held_out"] for r in scored) == len(held) > 100
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    flipped = given.withColumn("toxic", F.when(crc_of("doc_id") % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, flipped, trees=5).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in scored)


def test_toxicity_of_messy_rows(spark, messy, nothing):
    few = spark.createDataFrame([(1, 1), (2, None), (None, 1), (100, 0), (101, 0), (102, 1), (102, 0), (103, 0), (104, 1)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(messy, few, keep=tuple(c for c in messy.columns if c not in ("score", "held_out")), trees=2)
    assert scored.count() == messy.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    for labels in (few.where("toxic = 0"), few.limit(0)):
        assert {r["score"] for r in toxicity.score_toxicity(messy, labels).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing, few).count() == 0
