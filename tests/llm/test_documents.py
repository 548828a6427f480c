"""SimHash, decontamination, secrets, Order MinHash and personal data against brute force on messy rows."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from texts import DOCS, prose

from regrove.llm import decontaminate, order_minhash, pii, secrets, simhash
from regrove.llm.graph import components


def key(row):
    return tuple((v is None, v) for v in row)


# SimHash

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        ones.update(i for i in range(64) if h >> i & 1)
    return sum(1 << i for i, n in ones.items() if n * 2 > len(shingles))


def brute_components(nodes, linked):
    label = list(range(len(nodes)))
    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_simhash_matches_brute_force(messy, messy_rows):
    got = sorted(((r["doc_id"], int.from_bytes(r["fp"], "big"), r["component"]) for r in simhash.near_duplicates(messy).collect()), key=key)
    prints = [brute_fingerprint(r[1]) for r in messy_rows]
    label = brute_components(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {k: min((r[0] for r, x in zip(messy_rows, label) if x == k and r[0] is not None), default=None) for k in set(label)}
    assert got == sorted(((r[0], p, least[x]) for r, p, x in zip(messy_rows, prints, label)), key=key)


def test_simhash_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.drop_near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("shared,size", [(4, 3), (4, 2), (5, 3), (3, 2)])
def test_key_sets_cover_every_choice_of_shared_bytes(shared, size):
    import itertools

    sets = [set(s) for s in simhash.key_sets(8, shared, size)]
    assert all(any(s <= set(c) for s in sets) for c in itertools.combinations(range(8), shared))


def test_links_in_small_blocks_give_the_same_components(spark):
    r = random.Random(4)
    prints = {r.getrandbits(64)}
    while len(prints) < 120:  # chains of near fingerprints share most posting lists
        prints.add(r.choice(sorted(prints)) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    nodes = spark.createDataFrame([(bytearray(p.to_bytes(8, "big")),) for p in prints], "fp binary")
    for block in (7, 4096):
        edges = simhash.links(nodes, simhash.key_sets(8, 4, 3), 4, 4, block)
        roots = {bytes(x["node"]): bytes(x["root"]) for x in components(edges).collect()}
        listed = sorted(p.to_bytes(8, "big") for p in prints)
        label = brute_components([int.from_bytes(p, "big") for p in listed], lambda a, b: bin(a ^ b).count("1") <= 4)
        assert [roots.get(p, p) for p in listed] == [listed[k] for k in label]


def test_one_document_of_each_group_stays(messy, messy_rows):
    kept = simhash.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    label = brute_components([brute_fingerprint(r[1]) for r in messy_rows], lambda a, b: bin(a ^ b).count("1") <= 4)
    expected = [min((r[0] is None, r[0] or 0) for r, x in zip(messy_rows, label) if x == k) for k in set(label)]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == sorted(expected)


def test_without_ids_the_first_row_of_a_group_stays(spark):
    rows = [(None, prose(k, 12), "en", "a", 1) for k in (1, 2, 1, 1, 2)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted(r["text"] for r in kept.collect()) == sorted({r[1] for r in rows})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201), (201, 201), (None, 3)], "a int, b int")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 201: 200}


# Decontamination

def brute_hits(text, items):
    words = decontaminate.normal_words(text)
    hit, found = set(), set()
    for name, item in items:
        w = decontaminate.normal_words(item)
        for k in range(max(1, len(w) - 9) if w else 0):
            window = w[k:k + 10]
            for i in range(len(words) - len(window) + 1):
                if words[i:i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(str(name) if name is not None else "null")
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [200_000, 3])
def test_contamination_matches_brute_force(spark, messy_rows, block):
    items = [(1, prose(1, 40)), (2, "ONE"), (3, None), (4, ""), (5, "Word, word! word"), (None, prose(3, 3)), (6, prose(1, 40))]
    bench = spark.createDataFrame(items, "item_id int, text string")
    rows = [*messy_rows, (50, "x " + prose(1, 40).upper().replace(" ", " -- ") + " y one", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = decontaminate.find_contamination(docs, bench, block_windows=block).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=key)
    assert got == sorted(((r[0], *brute_hits(r[1], items)) for r in rows), key=key)
    text = rows[-1][1]
    spans = next(r["spans"] for r in found if r["doc_id"] == 50)
    assert decontaminate.normal_words(text[spans[0]["start"]:spans[0]["end"]]) == decontaminate.normal_words(prose(1, 40))


def test_a_window_that_very_many_items_hold(spark):
    """Item ids stay in Spark: neither the driver nor a broadcast gets them."""
    passage = prose(77, 14)
    bench = spark.range(100_000).select(F.col("id").alias("item_id"), F.lit(passage).alias("text"))
    docs = spark.createDataFrame([(1, f"{prose(1, 9)} {passage}"), (2, passage), (3, prose(2, 40))], "doc_id long, text string")
    found = {r["doc_id"]: r["items"] for r in decontaminate.find_contamination(docs, bench).collect()}
    assert found[1] == found[2] == sorted(str(i) for i in range(100_000)) and found[3] == []
    plain = decontaminate.find_contamination(docs, bench, items=False)
    assert sorted((r["doc_id"], r["n_hit"]) for r in plain.collect()) == [(1, 14), (2, 14), (3, 0)] and "items" not in plain.columns


def test_contamination_of_nothing(spark, messy, nothing):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.find_contamination(nothing, none).count() == 0
    assert decontaminate.find_contamination(messy, none).where("n_hit > 0").count() == 0


# Secrets

def brute_secrets(text):
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [("assign", *m.span())] if len(m[2]) >= 8 else []
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]


def test_base_secrets_match_brute_force():
    r = random.Random(1)
    parts = ["password", "Token", "apikey", "API_KEY", "passwd", "=", ":", " ", '"', "'", "abcdef12", "AKIA", "ABCD1234EFGH", "0" * 20, "deadbeef" * 3, "é", "ſecret", "x.y-z"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert sorted(secrets.base_spans(text)) == sorted(brute_secrets(text)), text


ALPHABETS = {
    "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
}


def drawn(r, name, n):
    return "".join(r.choice(ALPHABETS[name]) for _ in range(n))


@pytest.mark.parametrize("name", list(ALPHABETS))
@pytest.mark.parametrize("n", [20, 24, 40, 80])
def test_p_values_of_evenly_drawn_tokens_are_even(name, n):
    r = random.Random(n)
    p = sorted(secrets.battery(drawn(r, name, n))[1] for _ in range(1500))
    distance = max(max((i + 1) / len(p) - x, x - i / len(p)) for i, x in enumerate(p))
    assert distance * len(p) ** 0.5 < 1.95  # Kolmogorov, 0.1 %


def test_battery_knows_encodings_and_tells_keys_from_words():
    r = random.Random(5)
    keys = [drawn(r, "base62", 40) for _ in range(50)]
    words = ["Verkehrsinfrastrukturfinanzierung", "counterrevolutionaries-and-others", "com/example/Service2/Impl3/V4Handler", "SomeCamelCaseClassNameFactoryBean",
             "20240105T100000-20240106T110000", "a" * 40, "=" * 30, "ab" * 20, "550e8400-e29b-41d4-a716-446655440000"]
    assert min(secrets.battery(k)[1] for k in keys) > 10 * max(secrets.battery(w)[1] for w in words)
    # the same counts of characters: evenly used for 16 characters, not for 32
    even, odd = "0123456789abcdef" * 3, "ABCDEFGHIJKLMNO2" * 3
    assert secrets.encoding_of(even) == "hex" and secrets.encoding_of(odd) == "base32"
    p = [secrets._pairs_p(t, Counter(map(secrets._cell, t)), e) for t, e in ((even, "hex"), (odd, "base32"))]
    assert p[0] == pytest.approx(1, abs=1e-3) and p[1] < p[0] / 10


def test_alphabet_tail_is_chi_squared():
    # 95 % points of chi-squared with 1, 10 and 40 degrees of freedom
    for freedom, point in ((1, 3.841), (10, 18.307), (40, 55.758)):
        assert secrets._upper_gamma(freedom / 2, point / 2) == pytest.approx(0.05, abs=1e-4)


def test_moments_of_equal_pairs_and_changes_by_simulation():
    r = np.random.default_rng(4)
    n, size = 12, 26
    counts = np.array([np.bincount(x, minlength=size) for x in r.integers(0, size, (40_000, n))])
    pairs = (counts * (counts - 1) // 2).sum(1)
    mean, variance, third = secrets._pair_moments(((n, size),))
    assert pairs.mean() == pytest.approx(mean, rel=0.02) and pairs.var() == pytest.approx(variance, rel=0.05)
    classes = [0] * 9 + [1] * 4 + [2] * 3
    z = [secrets._changes_z(r.permutation(classes).tolist(), float(r.random())) for _ in range(20_000)]
    assert np.mean(z) == pytest.approx(0, abs=0.03) and np.std(z) == pytest.approx(1, abs=0.02)
    assert secrets._runs_p("abcdefgh12345678") < 1e-3 and secrets._serial_p("banabanabanabana") < 1e-3
    assert 0 < secrets._runs_p("abcdefgh") < 1 and 0 < secrets._serial_p("01234567") < 1


def test_names_and_paths_of_a_corpus_are_no_keys_and_planted_keys_are_found(spark):
    r = random.Random(11)
    words = [prose(i, 1) + prose(i + 7000, 1) for i in range(3000)] + "service handler factory bean example implementation request context manager stream buffer reader".split() * 50
    word = lambda: r.choice(words)
    rows = []
    for i in range(400):
        names = ["".join(word().capitalize() for _ in range(5)), f"com/{word()}/{word().capitalize()}{i % 9}/{word().capitalize()}Impl{i % 7}", "_".join(word() for _ in range(5)), f"2024{i:04}T100000-2024{i:04}T110000"]
        rows.append((i, " ".join(x for n in names for x in (*[word() for _ in range(40)], n))))
    planted = {1000 + i: drawn(r, name, n) for i, (name, n) in enumerate((k, n) for k in ("base62", "base36", "base62") for n in (24, 28, 32, 40, 64) for _ in range(4))}
    rows += [(i, f"{word()} {word()} {key} {word()}") for i, key in planted.items()]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    wrong = sum(s["kind"] == "random" for i in range(400) for s in got[i])
    found = sum(any(s["kind"] == "random" for s in got[i]) for i in planted)
    assert found >= 0.9 * len(planted) and wrong <= 2, (found, wrong)


def test_secrets_in_long_dense_texts_take_linear_time():
    import time

    r = random.Random(3)
    text = " ".join(f"token={drawn(r, 'base36', 9)} {drawn(r, 'base62', 22)}" for _ in range(20_000))
    began = time.perf_counter()
    spans = secrets.text_spans(text)
    assert len(spans) == 40_000 and time.perf_counter() - began < 20


def test_secrets_of_messy_rows(spark, messy, nothing):
    r = random.Random(6)
    hidden = "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(44))
    docs = messy.select("doc_id", "text").union(spark.createDataFrame([(900, f"see {hidden} now")], "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[900]] == [("random", 4, 48)]
    assert [s["kind"] for s in got[13]] == ["assign", "access", "hex"]
    assert got[4] == got[5] == []
    assert secrets.find_secrets(nothing).count() == 0


def test_added_secrets_match_a_plain_run_of_the_method(spark, messy, messy_rows):
    """Counts, fit, weights and step-up in plain Python over all rows at once."""
    r = random.Random(9)
    rows = [(row[0], row[1]) for row in messy_rows] + [(900 + i, f"see {drawn(r, 'base62', 22 + i)} or {'Word' * (6 + i)} now") for i in range(20)]
    codes = Counter(c for _, t in rows for c in secrets.text_codes(t))
    chances = secrets.text_p_values(codes)
    tokens = [(i, s) for i, t in rows for s in secrets.text_spans(t) if s["kind"] == "random"]
    weights = [secrets.LENGTHS[secrets.length_group(s["length"])] for _, s in tokens]
    mean = sum(weights) / len(weights)
    p = [chances[s["bin"] // 1000][s["bin"] % 1000] * mean / w for (_, s), w in zip(tokens, weights)]
    most = max((x for k, x in enumerate(sorted(p), 1) if x <= secrets.FDR * k / len(p)), default=-1)
    expected = sorted((i or 0, s["start"], s["end"]) for (i, s), x in zip(tokens, p) if x <= most)
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((x["doc_id"] or 0, s["start"], s["end"]) for x in got for s in x["spans"] if s["kind"] == "random") == expected and expected


def test_step_up_is_weighted_benjamini_hochberg():
    tests = [(0.5, 1.0, 900, "a"), (0.01, 2.0, 60, "b"), (1e-4, 1.0, 10, "c"), (1e-5, 0.5, 20, "d"), (1e-6, 1.0, 10, "e")]
    mean = sum(w * n for _, w, n, _ in tests) / 1000
    p = sorted((x * mean / w, key) for x, w, n, key in tests for _ in range(n))
    most = max((i for i, (x, _) in enumerate(p, 1) if x <= 0.01 * i / len(p)), default=0)
    assert secrets.step_up(tests, 0.01) == {key for _, key in p[:most]} == {"c", "d", "e"}
    assert secrets.step_up([], 0.01) == set() and secrets.step_up([(0.9, 1.0, 5, "x")], 0.01) == set()


# Order MinHash

def test_order_minhash_follows_order_and_edits():
    text = " ".join(f"w{i}x" for i in range(300))
    half = len(text) // 2
    like = lambda a, b: order_minhash.likeness(order_minhash.signature(a, size=256), order_minhash.signature(b, size=256))
    assert like(text, text) == 1
    assert like(text, text[:200] + "?" + text[201:]) > like(text, text[:-half] + "z" * half) > 0
    assert like("ab" * 200, "ab" * 100) < 0.6  # occurrences count


def test_occurrences_are_numbered():
    kmers = order_minhash.numbered_kmers("aaaaaaaaaaaa", 8)
    assert len(set(kmers.tolist())) == len(kmers) == 5
    for k in range(1, 12):
        text = "abcabcabcabd"
        got, seen, names = order_minhash.numbered_kmers(text, k), Counter(), []
        for i in range(len(text) - k + 1):
            seen[text[i:i + k]] += 1
            names.append((text[i:i + k], seen[text[i:i + k]]))
        assert len(set(zip(names, got.tolist()))) == len(set(names)) == len(got)


def test_edited_texts_match_brute_force(messy, messy_rows, nothing):
    got = sorted((tuple(r) for r in order_minhash.edited_fingerprints(messy).collect()), key=lambda r: key(r[:3]))
    rows = [(r[0], r[1] or "") for r in messy_rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))  # ties are equal rows here
    sign = order_minhash.signature
    expected = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 2
        edited = text[:len(text) - cut] + after[:cut]
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), order_minhash.to_text(sign(text)), order_minhash.to_text(sign(edited)),
                         order_minhash.likeness(sign(text), sign(edited)), order_minhash.likeness(sign(text), sign(after))))
    assert got == sorted(expected, key=lambda r: key(r[:3]))
    assert order_minhash.edited_fingerprints(nothing).count() == 0
    assert order_minhash.edited_fingerprints(messy.where("doc_id = 10")).first()["near_next"] == 1.0


def test_texts_without_ids_are_dealt_by_their_hash(spark):
    rows = [(None, prose(i % 150, 6)) for i in range(200)] + [(7, "x"), (7, "x"), (7, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = order_minhash.with_next(frame, "doc_id", "text", 8).where("sentinel = 0 and id is null")
    assert dealt.select("bucket").distinct().count() >= 6
    hashed = {r["text"]: r["h"] for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]], r[1]))
    expected = Counter()
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(text) // 2
        expected[i, hashlib.sha256((text[:len(text) - cut] + after[:cut]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in order_minhash.edited_fingerprints(frame).collect()) == expected


def test_plain_fingerprints(messy):
    prints = {r["doc_id"]: r["fingerprint"] for r in order_minhash.fingerprint(messy).collect()}
    assert prints[1] == prints[2] != prints[3] and prints[4] == prints[5]


# Personal data

def brute_luhn(digits):
    return sum((v * 2 - 9 * (v > 4) if i % 2 else v) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    text = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and brute_luhn(digits(m[0]))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_base_pii_matches_brute_force(spark, messy_rows):
    r = random.Random(3)
    texts = ["".join(r.choice("ab1 2.3-@+_()9.5%\n4é7") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["a@b.com_x@y.org", "abc@def@ghi.com", "4035 0659-4308 8454 x", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "a..b@c.d-e.f. x", f"a@b.c 1{pii.GAP}2{pii.DOT}@x"]
    texts += ["x" * 50_000 + "@", "1 " * 20_000, "a." * 20_000 + "@b." + "c." * 9_000, *[row[1] for row in messy_rows]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find_pii(frame.repartition(4)).collect():
        assert [tuple(s) for s in row["pii_spans"] if s["kind"] != "context"] == brute_pii(texts[row["doc_id"]])


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"{prose(i, 4)} Kontakt: user{i}@mail{i}.example.org {prose(i + 50, 4)}") for i in range(12)]
    rows += [(50, f"{prose(90, 3)} Kontakt: 77123-456-X {prose(91, 3)}"), (51, f"{prose(92, 3)} other 77123-999-X {prose(93, 3)}")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii_spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[-2][1]
    at = text.index("77123")
    assert got[50] == [("context", at, at + len("77123-456-X"))] and got[51] == []


@pytest.mark.parametrize("seeds,unseen", [(100, 40), (12, 40)])
def test_contexts_with_many_unseen_identifiers_are_trusted(spark, seeds, unseen):
    rows = [(i, f"{prose(i, 4)} Kontakt: user{i}@mail{i}.example.org {prose(i + 500, 4)}") for i in range(seeds)]
    rows += [(1000 + i, f"{prose(i + 700, 4)} Kontakt: 77{i:03}-456-X {prose(i + 900, 4)}") for i in range(unseen)]
    rows += [(2000 + i, f"{prose(i + 1200, 4)} the 88{i:03}-456-X {prose(i + 1300, 4)}") for i in range(300)]
    rows += [(3000 + i, f"{prose(i + 1600, 4)} the name{i}@mail{i}.example.org {prose(i + 1700, 4)}") for i in range(6)]
    rows += [(4000 + i, f"{prose(i + 1800, 4)} am {f'a{i}@mail{i}.example.org' if i < 9 else f'2024-01-{i}'} {prose(i + 1900, 4)}") for i in range(20)]
    got = {r["doc_id"]: [s["kind"] for s in r["pii_spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[1000 + i] == ["context"] for i in range(unseen))
    assert not any(got[2000 + i] for i in range(300)) and not any(got[4000 + i] for i in range(9, 20))


def test_identifiers_in_groups_and_behind_labels_are_found_whole(spark):
    rows = [(i, f"{prose(i, 4)} Kontakt: user{i}@mail{i}.example.org {prose(i + 50, 4)}") for i in range(12)]
    rows += [(100 + i, f"{prose(i + 200, 4)} id=user{i}@mail{i}.example.org {prose(i + 250, 4)}") for i in range(12)]
    values = ["(030) 123 4567", "123 45 6789", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "AB1234X", "7" * 70, "x1"]
    rows += [(200 + i, f"{prose(i + 300, 3)} Kontakt: {v} {prose(i + 350, 3)}") for i, v in enumerate(values)]
    rows += [(300, f"{prose(400, 3)} id=77123456 {prose(401, 3)}"), (301, f"{prose(402, 3)} Kontakt:77123456, {prose(403, 3)}"), (302, f"Kontakt: 123 45 a@b.org {prose(405, 3)}")]
    found = {r["doc_id"]: r["pii_spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    cut = {i: [text[i][s["start"]:s["end"]] for s in spans] for i, spans in found.items()}
    assert [cut[200 + i] for i in range(len(values))] == [[v] for v in values]
    assert cut[300] == cut[301] == ["77123456"] and cut[302] == ["a@b.org", "123 45"]


def test_pieces_part_long_texts_where_nothing_reaches_across(spark):
    """Long texts of many identifiers: base spans as brute force, contexts and masks as in pieces of one."""
    r = random.Random(13)
    parts = [lambda: f"u{r.randint(1, 99)}@mail.example.org", lambda: f"10.{r.randint(0, 300)}.0.7", lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}",
             lambda: "4035 0659 4308 8454", lambda: prose(r.randint(0, 999), r.randint(1, 9)), lambda: "12 34", lambda: "\n", lambda: "Ab1 (030) 123 4567", lambda: "é漢😀"]
    texts = [" ".join(r.choice(parts)() for _ in range(n)) for n in (400, 1500, 3000) for _ in range(3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x["pii_spans"] for x in pii.find_pii(frame.repartition(3)).collect()}
    whole = lambda t: [p["t"] for p in frame.sparkSession.createDataFrame([(t,)], "t string").select(F.explode(pii.pieces(F.col("t"))).alias("p")).select("p.*").collect()]
    assert len(whole(texts[-1])) > 10 and "".join(whole(texts[-1])) == texts[-1]
    for i, text in enumerate(texts):
        assert [tuple(s) for s in found[i] if s["kind"] != "context"] == brute_pii(text)
    spans = spark.createDataFrame([(i, texts[i], [tuple(s) for s in found[i]]) for i in found], f"i long, t string, s {pii.SPANS}")
    for x in spans.select("i", pii.redacted(F.col("t"), F.col("s")).alias("m")).collect():
        out, at = "", 0
        for s in sorted(found[x["i"]], key=lambda s: (s["start"], s["end"], s["kind"])):
            if s["start"] >= at:
                out += texts[x["i"]][at:s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert x["m"] == out + texts[x["i"]][at:]


def test_contexts_reach_across_pieces(spark):
    """Every identifier is the first or last word of a piece somewhere."""
    long = [" ".join([*["ab"] * k, *["word"] * 380, "Kontakt:", f"user{k}@mail{k}.example.org", *["word"] * 30]) for k in range(60)]
    rows = [*enumerate(long), (100, f"{prose(1, 300)} Kontakt: 77123-456-X {prose(2, 300)}"), (101, f"{prose(1, 300)} other 77123-999-X {prose(2, 300)}")]
    got = {r["doc_id"]: [s["kind"] for s in r["pii_spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == ["context"] and got[101] == [] and all(got[k] == ["email"] for k in range(60))


def test_long_dense_texts_take_linear_time(spark):
    import time

    text = " ".join(f"word u{i}@mail.example.org or +1 (553) 555-{1000 + i % 9000}" for i in range(20_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.find_pii(frame.select("doc_id", F.lit("a@b.org").alias("text"))).collect()
    began = time.perf_counter()
    row = pii.find_pii(frame).first()
    assert len(row["pii_spans"]) == 40_000 and time.perf_counter() - began < 20
    spans = spark.createDataFrame([(text, [tuple(s) for s in row["pii_spans"]])], f"t string, s {pii.SPANS}")
    began = time.perf_counter()
    assert spans.select(pii.redacted(F.col("t"), F.col("s"))).first()[0].startswith("word [EMAIL] or [PHONE] word [EMAIL]")
    assert time.perf_counter() - began < 20


def brute_discovered(rows, rounds=3, support=5.0, pattern_score=0.8, instance_score=0.8, rlogf=0.4):
    """The graph in plain Python: patterns and instances by turns."""
    edges = {}
    for value, seed, *words in rows:
        for side, word in zip("LR", words):
            if word is not None:
                edges[f"{side} {word}", value] = edges.get((f"{side} {word}", value), False) or seed
    other = {e: not seed and bool(re.match(pii.SOMETHING_ELSE.replace("++", "+"), e[1])) for e, seed in edges.items()}
    score = {e: float(seed) for e, seed in edges.items()}
    now = {}
    for _ in range(rounds):
        trusted = {}
        for pattern in {p for p, _ in edges}:
            own = [e for e in edges if e[0] == pattern]
            mass = sum(score[e] for e in own)
            trust = mass / (mass + sum(other[e] for e in own) + 1)
            if mass >= support and trust >= pattern_score and mass / len(own) * np.log2(mass) >= rlogf:
                trusted[pattern] = trust
        now = {}
        for e, seed in edges.items():
            if not seed and not other[e] and e[0] in trusted:
                now[e[1]] = now.get(e[1], 1.0) * (1 - min(trusted[e[0]], 0.999))
        now = {v: 1 - x for v, x in now.items()}
        if not now:
            break
        score = {e: 1.0 if seed else now.get(e[1], 0.0) for e, seed in edges.items()}
    return sorted(v for v, x in now.items() if x >= instance_score)


@pytest.mark.parametrize("seed", range(4))
def test_graph_scores_match_brute_force(spark, seed):
    r = random.Random(seed)
    words, values = ["kontakt", "tel", "am", "the", None], [f"v{i}" for i in range(40)] + ["2024-01-05", "12:30", "3.50"]
    known = set(r.sample(values[:40], 22))
    rows = [(v, v in known, r.choice(words), r.choice(words)) for v in r.choices(values, k=160)]
    got = pii.discovered(spark.createDataFrame(rows, "value string, seed boolean, left string, right string"))
    assert sorted(x["value"] for x in got.collect()) == brute_discovered(rows)


def test_pii_of_messy_rows(messy, nothing):
    found = pii.find_pii(messy, keep=tuple(c for c in messy.columns if c != "pii_spans"))
    assert found.count() == messy.count() and found.where("size(pii_spans) > 0").select("doc_id").distinct().count() == 1
    assert pii.find_pii(nothing).count() == 0


def test_redaction(spark):
    spans = [("phone", 5, 9), ("card", 7, 12), ("ip", 0, 2)]
    frame = spark.createDataFrame([("ab cd 12345678 é", spans), ("plain", []), ("x", [("ip", 0, 1)])], f"t string, s {pii.SPANS}")
    assert [r[0] for r in frame.select(pii.redacted(F.col("t"), F.col("s"))).collect()] == ["[IP] cd[PHONE]78 é", "plain", "[IP]"]


def test_base32_matches_the_standard(spark):
    from regrove.llm.warc import base32_of_hex

    for text in ("", "x", "é" * 9):
        digest = hashlib.sha1(text.encode())
        assert spark.sql(f"select {base32_of_hex(repr(digest.hexdigest()))}").first()[0] == base64.b32encode(digest.digest()).decode()
