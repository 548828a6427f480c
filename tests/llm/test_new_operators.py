"""Importance resampling, embedding near-duplicates and tokenizer alignment against brute force on messy rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import DOCS, prose

from regrove.llm import embedding_dedup as ed
from regrove.llm import resample as rs
from regrove.llm import token_alignment as ta


# Importance resampling

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_resample(rows, target, max_words=1, least=20, share=(10, 100), seed=2024):
    def features(text):
        w = words(text)
        return [" ".join(w[i:i + n]) for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for text in texts for f in features(text)) for texts in ([r[1] for r in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * float(T + 10_000) / ((s[b] + 1.0) * float(S + 10_000))))
    out = []
    for id, text in rows:
        f = features(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        out.append([id, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(order[:share[0] * len(order) // share[1]], 1):
        r.append(rank)
    return sorted([tuple(r) if len(r) == 6 else (*r, None) for r in out], key=str)


@pytest.mark.parametrize("options", [{}, {"bits": 3, "block": 4}, {"max_words": 3, "share": (1, 2)}, {"share": (1, 1), "least_words": 0, "bits": 5, "block": 7}])
def test_resampling_matches_brute_force(spark, messy, messy_rows, options):
    target = [prose(1, 50), prose(3, 40), None, "", "word WORD"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in rs.resample(messy, frame, **options).collect()), key=str)
    brute = {"max_words": "max_words", "share": "share", "least_words": "least"}
    assert got == brute_resample([(r[0], r[1]) for r in messy_rows], target, **{brute[k]: v for k, v in options.items() if k in brute})


def test_a_gain_is_the_targets_share_over_the_sources(spark, messy_rows, tmp_path):
    """By the contract: floor(1000 * ln((t + 1) * (S + 10000) / ((s + 1) * (T + 10000)))), S and s of documents, T and t of the benchmark."""
    assert rs.gains(np.array([3, 0, 1]), np.array([0, 2, 0])).tolist() == [math.floor(1000 * math.log(x)) for x in (1 * 7 / (4 * 5), 3 * 7 / (1 * 5), 1 * 7 / (2 * 5))]
    target = [prose(1, 50), prose(3, 40), None, "", "word WORD"]
    spark.createDataFrame(messy_rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    s, t = (Counter(zlib.crc32(w.encode()) % 10_000 for text in texts for w in words(text)) for texts in ([r[1] for r in messy_rows], target))
    S, T = s.total(), t.total()
    expected = []
    for id, text, *_ in messy_rows:
        buckets = [zlib.crc32(w.encode()) % 10_000 for w in words(text)]
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in buckets)
        h = int(hashlib.sha256(f"2024:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        expected.append([id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = sorted((r for r in expected if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(long[:len(long) // 10], 1):
        r[4] = rank
    got = rs.op11_resample(spark, str(tmp_path)).collect()
    assert sorted((list(r) for r in got), key=str) == sorted(expected, key=str)


def test_resampling_of_nothing(spark, messy, nothing):
    empty = messy.select("text").limit(0)
    assert rs.resample(nothing, messy).count() == 0
    assert rs.resample(messy, empty).count() == messy.count()


@pytest.mark.parametrize("bits,block", [(11, None), (2, 3), (8, 100)])
def test_radix_ranks_sort_any_whole_numbers(spark, bits, block):
    r = random.Random(bits)
    edge = [None, -2**63, 2**63 - 1, 0, -1, 1]
    rows = [(r.choice([*edge, r.randint(-9, 9)]), r.choice([*edge, r.getrandbits(40)]), i) for i in range(400)] + [(7, 7, 1000 + i) for i in range(200)]
    frame = spark.createDataFrame(rows, "x long, y long, i long").repartition(5)
    got = sorted(rs.radix_ranks(frame, [("x", True), ("y", False)], bits, block).collect(), key=lambda r: r["place"])
    assert [g["place"] for g in got] == list(range(len(rows)))
    order = lambda x, y: ((x is None, -(x or 0)), (y is None, y or 0))
    assert [(g["x"], g["y"]) for g in got] == sorted(((x, y) for x, y, _ in rows), key=lambda p: order(*p))
    assert sorted(g["i"] for g in got) == sorted(i for *_, i in rows)
    same = rs.radix_ranks(spark.createDataFrame([(1, 1)] * 9, "x long, y long").repartition(3), [("x", True), ("y", False)])
    assert sorted(r["place"] for r in same.collect()) == list(range(9))


# Embeddings

def brute_vectors(rows):
    unit = []
    for _, v in rows:
        good = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None)
    near = [[i != j and a is not None and b is not None and len(a) == len(b) and float(a @ b) >= 0.95 for j, b in enumerate(unit)] for i, a in enumerate(unit)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near[i][j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {k: min((r[0] for r, x in zip(rows, label) if x == k and r[0] is not None), default=None) for k in set(label)}
    return sorted(((r[0], sum(n), least[x], r[0] is not None and r[0] == least[x]) for r, n, x in zip(rows, near, label)), key=str)


def vector_rows():
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + r.normal(scale=0.12, size=16)).tolist()) for i in range(150)]
    rows += [(500 + i, (centres[0] * (i + 1)).tolist()) for i in range(70)] + [(700 + i, centres[1].tolist()) for i in range(90)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [math.nan] * 16), (904, [1.0] * 15 + [None]), (905, [math.inf] + [1.0] * 15), (906, [1.0, 2.0]), (907, [1.0, 2.1])]
    return [*rows, (None, centres[2].tolist()), (700, centres[1].tolist()), (None, None), (908, [1e-38] * 16), (909, [1e37] * 16)]


@pytest.mark.parametrize("options", [{}, {"window": 4, "block": 16}])
@pytest.mark.parametrize("kind", ["double", "float"])
def test_vectors_match_brute_force(spark, options, kind):
    rows = vector_rows()
    if kind == "float":
        rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("label", "node", "digest", "root")})
    got = sorted((tuple(r) for r in ed.near_vectors(frame.repartition(3), **options).collect()), key=str)
    assert got == brute_vectors(rows)


def test_vectors_of_nothing(spark):
    assert ed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ed.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first()["n_links"] == 0


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of cosine 0.95 exactly: the passes are made for these."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        a, b = r.normal(size=(2, 32))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.9501 * a + math.sqrt(1 - 0.9501**2) * b / np.linalg.norm(b)).tolist())]
    found = ed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.where("n_links = 1").count() >= 0.97 * len(rows)


def test_passes_grow_with_the_logarithm():
    assert ed.n_passes(0) == ed.n_passes(64) == 1
    assert 5 <= ed.n_passes(1000) <= ed.n_passes(100_000) <= 20 < ed.n_passes(10**9) < 100


# Tokenizer alignment

@pytest.fixture(scope="module")
def pair():
    return ta.Pair(*ta._vocabularies(f"{ta.VOCABULARIES}/{ta.A_FILE}", f"{ta.VOCABULARIES}/{ta.B_FILE}"))


def brute_groups(pair, text):
    import sentencepiece  # noqa: F401

    spaced = f" {text or ''}"
    a, b = pair.a.encode(spaced, add_special_tokens=False).ids, pair.b.encode(text or "")
    if not text or any(b"".join(t[i] for i in x) != spaced.encode() for t, x in ((pair.a_bytes, a), (pair.b_bytes, b))):
        return [], [], []
    ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
    ends_a, ends_b = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        to_i, to_j = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append((a[i:to_i], b[j:to_j]))
        i, j = to_i, to_j
    return a, b, groups


def brute_alignment(pair, rows):
    each, corpus = [], Counter()
    for id, text in rows:
        a, b, groups = brute_groups(pair, text)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        corpus.update(links.keys())
        shown = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        each.append((id, len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(shown.encode()).hexdigest() if groups else "", links))
    best = defaultdict(int)
    for (a, _), n in corpus.items():
        best[a] = max(best[a], n)
    return sorted(((*r[:6], sum(n for p, n in r[6].items() if corpus[p] == best[p[0]]), sum(n * corpus[p] for p, n in r[6].items())) for r in each), key=str)


ODD = ["<|endoftext|> and <s> or <unk></s>", "▁ sign", "\x00\x01 nul", "x", " ", "\n\n  \t two", "𝔘𝔫𝔦 漢字かな交じり文 \U0001f469‍\U0001f469‍\U0001f467", "é" * 50, "a" * 700, "aé1 " * 300, "​zero", "don't  stop", "ｆｕｌｌ　ｗｉｄｔｈ", "1234567890" * 30]


@pytest.mark.parametrize("options", [{}, {"batch_chars": 300}])
def test_alignment_matches_brute_force(spark, messy_rows, pair, options):
    rows = [(r[0], r[1] if r[0] != 8 else r[1][:20_000]) for r in messy_rows] + [(3000 + i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("batch", "id", "pair", "listed")})
    got = sorted((tuple(r) for r in ta.align(frame.repartition(3), **options).collect()), key=str)
    assert got == brute_alignment(pair, rows)


def test_alignment_of_nothing(spark):
    assert ta.align(spark.createDataFrame([], DOCS)).count() == 0
    row = ta.align(spark.createDataFrame([(1, None, "en", "a", 0)], DOCS)).first()
    assert row["groups_sha256"] == "" and row["n_a"] == row["count_sum"] == 0


def test_cuts_hold_both_sequences(spark, pair):
    rows = list(enumerate(ODD))
    for r in ta.cuts(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        a, b, groups = brute_groups(pair, ODD[r["doc_id"]])
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        assert [len(g[0]) for g in groups] == np.diff([0, *r["a_stop"]]).tolist() and [len(g[1]) for g in groups] == np.diff([0, *r["b_stop"]]).tolist()
        assert r["byte"][-1:] == ([len(f" {ODD[r['doc_id']]}".encode())] if groups else [])


@pytest.mark.parametrize("lane", [1, 3, 512])
def test_lanes_part_texts_without_changing_groups(pair, lane):
    texts = [prose(k, 5 * k + 1) + ODD[k % len(ODD)] for k in range(40)]
    tokens = [t for t in pair.encode(texts) if len(t[0])]
    a, b = (np.concatenate([t[k] for t in tokens]) for k in (0, 1))
    stops = [np.cumsum([len(t[k]) for t in tokens]) for k in (0, 1)]
    first = [s - [len(t[k]) for t in tokens] for k, s in enumerate(stops)]
    ends = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    whole = ta.lockstep(*ends, first[0], first[1], stops[0], 10**9)
    assert (ta.lockstep(*ends, first[0], first[1], stops[0], lane) == whole).all()
    assert np.intersect1d(*ends).tolist() == ends[0][whole[2] - 1].tolist()


def test_long_stretches_without_a_cut_count_all_links(monkeypatch):
    r = np.random.default_rng(2)
    a, b = r.integers(0, 5, 40), r.integers(0, 7, 30)
    groups = np.array([[0, 1], [0, 25], [25, 40], [0, 20], [20, 30]])
    count = lambda: sum((Counter(dict(zip(*map(np.ndarray.tolist, ta._summed(k, t))))) for k, t in ta.link_pairs(groups, a, b)), Counter())
    plain = count()
    monkeypatch.setattr(ta, "PLAIN_LINKS", 200)
    assert count() == plain and sum(plain.values()) == 25 * 20 + 15 * 10


def test_merging_by_rank_is_the_files_merging(pair):
    assert pair.ranks is not None
    assert all(pair.ranks._core_bpe.encode_single_piece(t) == [i] for i, t in enumerate(pair.a_bytes[:-1]))
    r = random.Random(1)
    letters = [chr(c) for c in range(0x250)]
    texts = [f" {a}{c}{b}" for c in letters for a in ("", "a", "1", " ") for b in ("", "a", "!", "\n", "'s")]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["".join(r.choice("aA1 \n\t'.é") for _ in range(60)) for _ in range(3000)]
    assert all(ta._PLAIN.match(t) for t in texts)
    assert [x.ids for x in pair.a.encode_batch(texts, add_special_tokens=False)] == [pair.ranks.encode_ordinary(t) for t in texts]
