"""Secrets in text: fixed shapes, and tokens that a battery of randomness tests takes for keys.

Base spans (leftmost, non-overlapping per kind; a match that fails its length is dropped without retry): `assign`, `access`,
`hex`. The battery looks at every other run of 20 or more characters of `[A-Za-z0-9+/_=-]` that isn't digits alone, infers its
encoding (the smallest alphabet that holds it) and asks whether it could be drawn evenly from that alphabet. Three p-values:

* alphabet: chi-squared of the character counts against even use of the inferred alphabet. It is taken apart as its degrees of freedom
  allow: first over coarse cells (vowels and other letters by case, digits, signs), then over the characters within the cells,
  as the number of equal pairs, whose exact moments are known where short tokens leave most characters unused,
* runs: fewer changes between character classes (lower, upper, digit, sign) than the token's own shares of them make by chance,
* serial correlation of its letters: vowels and other letters alternate in text more than the token's own share of vowels explains.

They are combined by Fisher's method. The combined p-value of an evenly drawn token is itself even between 0 and 1, whatever its
encoding and length; that of a word, path or name is tiny. How tiny is learned from the corpus: its running words, joined as
identifiers are (in camel case, with signs, as paths, with numbers), take the same battery and are counted per length. A
token's p-value against text is the chance that text of its length looks as random, by those counts and, beyond their reach, by a
log-normal law fitted to them, per encoding where words make such names. False discoveries are controlled at `fdr` by the weighted Benjamini-Hochberg procedure; weights grow with
length (short tokens have little power) and have a mean of one over the tokens tested. Only counts per length and score meet in one
place. Tokens at or below the step-up threshold become spans of kind `random`.

Defined cases: null text counts as empty; empty texts and tables give no spans; equal rows give equal results; a token of digits
alone is a number and never tested; where a corpus has no words to learn from, no token is taken for a key.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regrove.llm.common import blocks, pick, table, written

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"(?![0-9]+(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "random")
FDR = 0.01
#: -log10 of a combined p-value is kept in steps of a tenth, up to 60.
STEPS, BINS = 10, 600
#: Least lengths that are counted apart.
LENGTHS = (20, 24, 28, 32, 40, 48, 64)
#: Running words per identifier that is made of them.
EVERY = 100

_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_LETTERS = _LOWER + _LOWER.upper()
#: Encodings, smallest alphabet first, with their shapes and characters.
ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+\Z"), _DIGITS + "abcdef"), ("HEX", re.compile(r"[0-9A-F]+\Z"), _DIGITS + "ABCDEF"),
    ("lower26", re.compile(r"[a-z]+\Z"), _LOWER), ("upper26", re.compile(r"[A-Z]+\Z"), _LOWER.upper()),
    ("base32", re.compile(r"[A-Z2-7]+=*\Z"), _LOWER.upper() + "234567"), ("base36", re.compile(r"[0-9a-z]+\Z"), _LOWER + _DIGITS),
    ("BASE36", re.compile(r"[0-9A-Z]+\Z"), _LOWER.upper() + _DIGITS), ("letters52", re.compile(r"[A-Za-z]+\Z"), _LETTERS),
    ("base62", re.compile(r"[0-9A-Za-z]+\Z"), _LETTERS + _DIGITS), ("base64", re.compile(r"[0-9A-Za-z+/]+=*\Z"), _LETTERS + _DIGITS + "+/"),
    ("base64url", re.compile(r"[0-9A-Za-z_-]+=*\Z"), _LETTERS + _DIGITS + "_-"), ("mixed", re.compile(r""), _LETTERS + _DIGITS + "+/_-="),
)
SPAN_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("encoding", T.StringType()), T.StructField("length", T.LongType()), T.StructField("bin", T.IntegerType()),
]))
_ARROW_SPANS = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("length", pa.int64()), ("bin", pa.int32()),
]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if ("=" in text or ":" in text) else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def _cell(c: str) -> int:
    return 2 * _class(c) + (c in "aeiouAEIOU")


def _lower_tail(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _upper_gamma(a: float, x: float) -> float:
    """Upper tail of the gamma law of shape a: a series below its middle, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-12:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-10:
            break
    return front * h


def _pearson(mean: float, variance: float, third: float, x: float) -> float:
    """Upper tail of the shifted gamma law with these moments (the third about the mean)."""
    shape, scale = 4 * variance**3 / third**2, third / (2 * variance)
    return _upper_gamma(shape, (x - mean) / scale + shape)


@lru_cache(maxsize=None)
def _cells(encoding: str) -> dict[int, int]:
    """Characters per coarse cell of an encoding's alphabet."""
    return Counter(map(_cell, next(alphabet for name, _, alphabet in ENCODINGS if name == encoding)))


def _coarse_p(counts: dict[int, int], encoding: str, n: int, spread: float) -> float:
    """Chi-squared over the coarse cells, by a gamma law of its exact mean and variance."""
    sizes = _cells(encoding)
    every = sum(sizes.values())
    k = len(sizes)
    if k == 2:  # one count: a binomial one, spread over its step
        c, s = min(sizes.items())
        variance = n * s / every * (1 - s / every)
        return _two_sided((counts.get(c, 0) + spread - 0.5 - n * s / every) / math.sqrt(variance + 1 / 12))
    chi = sum(counts.get(c, 0) ** 2 * every / (s * n) for c, s in sizes.items()) - n
    mean, variance = k - 1.0, 2.0 * (k - 1) + (sum(every / s for s in sizes.values()) - k * k - 2 * k + 2) / n
    return _upper_gamma(mean * mean / variance, max(chi, 0.0) * mean / variance)


@lru_cache(maxsize=1 << 16)
def _pair_moments(counts: tuple[tuple[int, int], ...]) -> tuple[float, float, float]:
    """Mean, variance and third moment of the equal pairs in cells of (characters drawn, characters there are).

    Chi-squared over s characters, a line in the pairs of n draws, has the mean s - 1 and the variance 2 (s - 1) (n - 1) / n.
    """
    mean = variance = third = 0.0
    for n, s in counts:
        chi, unit = 2.0 * (s - 1) * (n - 1) / n, n / (2.0 * s)
        mean += n * (n - 1) / (2.0 * s)
        variance += chi * unit**2
        third += 2 * chi**2 / (s - 1) * unit**3
    return mean, variance, third


def _hashed(kind: bytes, body: str) -> float:
    """A number between 0 and 1 from a token: it spreads the p-value of a count evenly over that count's step."""
    return (zlib.crc32(kind + body.encode()) + 0.5) / 2**32


def _pairs_p(body: str, counts: dict[int, int], encoding: str) -> float:
    sizes = _cells(encoding)
    drawn = tuple(sorted((k, sizes[c]) for c, k in counts.items() if k > 1 and sizes.get(c, 0) > 1))
    spread = _hashed(b"pairs", body)
    if not drawn:
        return spread
    mean, variance, third = _pair_moments(drawn)
    pairs = sum(k * (k - 1) // 2 for c, k in Counter(body).items() if sizes.get(_cell(c), 0) > 1)
    above, with_them = (_pearson(mean, variance, third, pairs + x) for x in (0.5, -0.5))
    return above + (with_them - above) * spread


def _changes_z(classes: list[int], spread: float) -> float | None:
    """Changes between neighbours against any order of the same classes, in standard deviations; None where there is one class alone."""
    n, counts = len(classes), Counter(classes).values()
    if n < 3:
        return None
    two, three = sum(k * k for k in counts), sum(k**3 for k in counts)
    variance = (two * (two + n * (n + 1)) - 2 * n * three - n**3) / (n * n * (n - 1))
    if variance <= 1e-9:
        return None
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    return (changes + spread - 0.5 - (n - two / n)) / math.sqrt(variance + 1 / 12)


def _runs_p(body: str) -> float:
    spread = _hashed(b"runs", body)
    z = _changes_z([_class(c) for c in body], spread)
    return spread if z is None else _lower_tail(z)


def _serial_p(body: str) -> float:
    """Between two kinds, the serial correlation falls as the changes rise: one statistic, with known moments."""
    spread = _hashed(b"serial", body)
    z = _changes_z([int(c in "aeiouAEIOU") for c in body if c.isalpha()], spread)
    return spread if z is None else _lower_tail(-z)


def encoding_of(token: str) -> str:
    return next(name for name, shape, _ in ENCODINGS if shape.match(token))


def battery(token: str) -> tuple[str, float]:
    """Inferred encoding and the combined p-value of an even draw from it (small for text, any for keys)."""
    body = token.rstrip("=") or token
    encoding = encoding_of(token)
    if len(body) < 8 or len(set(body)) <= 2:
        return encoding, 0.0
    cells = Counter(map(_cell, body))
    p = (_coarse_p(cells, encoding, len(body), _hashed(b"cells", body)), _pairs_p(body, cells, encoding), _runs_p(body), _serial_p(body))
    # Fisher: -2 sum ln p has 8 degrees of freedom, whose upper tail is a short sum
    half = -sum(math.log(max(x, 1e-150)) for x in p)
    return encoding, min(1.0, math.exp(-half) * (1 + half + half**2 / 2 + half**3 / 6))


def score_bin(p: float) -> int:
    """-log10 of a combined p-value in steps: 0 for what looks quite random."""
    return min(BINS, int(-STEPS * math.log10(max(p, 1e-300))))


def length_group(n: int) -> int:
    return bisect_right(LENGTHS, n) - 1


_WORD = re.compile(r"[A-Za-z]{2,}")


def identifiers(text: str, every: int = EVERY) -> Iterator[str]:
    """Names as code and paths have them, made of the text's running words: one for each `every` words, at a hashed length and in a hashed way."""
    words = _WORD.findall(text)
    for start in range(0, len(words), every):
        own = words[start:start + every]
        h = zlib.crc32(" ".join(own[:4]).encode())
        length, way = 20 + h % 60, (h >> 8) % 8
        parts: list[str] = []
        size = 0
        for k, word in enumerate(own):
            if size >= length:
                break
            word = word.lower() if way in (0, 2, 3, 4) else word.upper() if way == 5 else word.capitalize()
            parts.append(f"{word}{(h >> k) % 100}" if way in (6, 7) and k % 2 else word)
            size += len(parts[-1]) + (way in (2, 3, 4, 5, 7))
        name = {2: "_", 3: "-", 4: "/", 5: "_", 7: "/"}.get(way, "").join(parts)
        if len(name) >= LENGTHS[0]:
            yield name


def group_code(encoding: str, length: int) -> int:
    """What tokens are compared with each other: encoding and length group."""
    return 10 * [name for name, *_ in ENCODINGS].index(encoding) + length_group(length)


def text_codes(text: str | None) -> list[int]:
    """Group and score bin, in one number, of the identifiers made of a text's words."""
    found = []
    for name in identifiers(text or ""):
        encoding, p = battery(name)
        found.append(group_code(encoding, len(name)) * 1000 + score_bin(p))
    return found


def text_spans(text: str | None) -> list[dict]:
    """Base spans, then the battery's candidates (kind `random`) that no base span touches."""
    if not text:
        return []
    base = base_spans(text)
    spans = [{"kind": k, "start": a, "end": b, "encoding": None, "length": b - a, "bin": None} for k, a, b in base]
    taken: list[list[int]] = []  # base spans, united where they overlap, by place
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    at = 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or taken[at][0] >= b:
            encoding, p = battery(m[0])
            spans.append({"kind": "random", "start": a, "end": b, "encoding": encoding, "length": b - a, "bin": group_code(encoding, b - a) * 1000 + score_bin(p)})
    return spans


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, `spans` (base spans and untested candidates with the group and bin of their combined p-value) and `names` (codes of identifiers made of the words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            texts = part.column(1).to_pylist()
            spans, names = pa.array([text_spans(t) for t in texts], _ARROW_SPANS), pa.array([text_codes(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), spans, names], [id, "spans", "names"])

    picked = pick(docs, id, text)
    return picked.mapInArrow(run, T.StructType([picked.schema[id], T.StructField("spans", SPAN_SCHEMA), T.StructField("names", T.ArrayType(T.IntegerType()))]))


#: Identifiers that a group needs for a law of its own, and those below a score for their share to be taken as it is.
OWN_LAW, COUNTED = 50, 10


def _chances(counts: list[int]) -> list[float]:
    """By bin the chance of that score or less: shares of the counts, and below them a log-normal law fitted to all."""
    n = sum(counts)
    logs = [math.log(b + 0.5) for b in range(len(counts))]
    mean = sum(c * x for c, x in zip(counts, logs)) / n
    spread = math.sqrt(sum(c * (x - mean) ** 2 for c, x in zip(counts, logs)) / n + 0.01)
    below, out = 0, []
    for c, x in zip(counts, logs):
        below += c
        out.append(below / n if below >= COUNTED else min(COUNTED / n, _lower_tail((x - mean) / spread)))
    return out


def text_p_values(names: dict[int, int]) -> dict[int, list[float]]:
    """Per group (encoding and length) the chance, by bin, that text looks as random or more, from the counts of identifiers. A group
    with few of them takes all encodings of its length, else the nearest shorter length's, else the nearest longer one's."""
    by_group: dict[int, list[int]] = {}
    for code, n in names.items():
        for group in (code // 1000, code // 1000 % 10 - 100):  # negative: all encodings of a length
            by_group.setdefault(group, [0] * (BINS + 1))[code % 1000] += n
    lengths = {g + 100: _chances(c) for g, c in by_group.items() if g < 0 and sum(c) > 1}
    found = {}
    for e in range(len(ENCODINGS)):
        for length in range(len(LENGTHS)):
            own = by_group.get(10 * e + length, [])
            if sum(own) >= OWN_LAW:
                found[10 * e + length] = _chances(own)
            elif near := [k for k in lengths if k <= length]:
                found[10 * e + length] = lengths[max(near)]
            elif lengths:
                found[10 * e + length] = lengths[min(lengths)]
    return found


def step_up(tests: list[tuple[float, float, int, object]], fdr: float = FDR) -> set:
    """Keys that the weighted step-up procedure rejects; tests are (p-value, weight, number of tests, key). Weights are divided by their mean."""
    total = sum(n for *_, n, _ in tests)
    mean = sum(w * n for _, w, n, _ in tests) / max(1, total)
    ordered = sorted(((p * mean / w, n, key) for p, w, n, key in tests), key=lambda t: t[0])
    above, last = 0, 0
    for i, (p, n, _) in enumerate(ordered):
        above += n
        if p <= fdr * above / total:
            last = i + 1
    return {key for _, _, key in ordered[:last]}


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """Per document: id, `spans` (kind, start, end, encoding, length, bin) of base kinds and of tokens that pass the battery."""
    found = written(scan(docs, id, text), "secret-spans")
    names = {r["name"]: r["count"] for r in found.select(F.explode("names").alias("name")).groupBy("name").count().collect()}
    tested = found.select(F.explode("spans").alias("s")).where("s.kind = 'random'").groupBy("s.bin").count()
    chances = text_p_values(names)  # counts by group and bin: a few thousand at most
    tests = [(chances[r["bin"] // 1000][r["bin"] % 1000], LENGTHS[r["bin"] // 1000 % 10], r["count"], r["bin"]) for r in tested.collect() if chances]
    passed = F.array(*[F.lit(c) for c in sorted(step_up(tests, fdr))]).cast("array<int>")
    return found.select(id, F.filter("spans", lambda s: (s["kind"] != "random") | F.array_contains(passed, s["bin"])).alias("spans"))


def digest_text(kinds: tuple[str, ...]) -> str:
    """SQL for spans of those kinds as kind:start:end by start, then kind as listed, comma-joined."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    return (
        f"array_join(transform(array_sort(transform(filter(spans, s -> array_contains(array({listed}), s.kind)), "
        f"s -> struct(s.start as start, array_position(array({listed}), s.kind) as k, s.kind as kind, s.end as end))), "
        "s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    )


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(F.expr(digest_text(KINDS[:3])), 256).alias("base_sha256"),
        F.expr(digest_text(KINDS)).alias("spans"), count("random"),
    )
