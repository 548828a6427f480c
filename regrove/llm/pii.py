"""Personal data by fixed shapes and by contexts learned from them, in DataFrame functions only.

Base spans (leftmost, non-overlapping per kind; a match that fails its test is dropped without retry): `email`, `ip` (parts at
most 255), `card` (16 to 19 digits passing Luhn), `phone` (8 to 15 digits). Spark gives no match positions, so a text is split by
a pattern and the lengths of pieces and matches are added up. The patterns are written without nested repetition: dots inside
host names and single separators inside digit groups are marked first, so that every pattern is a run of one character class
and takes linear time on texts of any length.

Bootstrapping: base spans are seeds. The word on either side of a seed is a lexical pattern. Identifier-like tokens (a digit or
@ in them, of any length; groups of digits and capitals parted by single spaces are one; a label before ':' or '=' is a context, not
part of it) that stand in such contexts are unseen instances. On the graph of
patterns and distinct instances two scores are passed to and fro: a pattern's is the summed score (mass) of its instances over mass,
instances known to be something else (dates, amounts, web addresses) and one, an instance's is one minus the product of (1 - score)
over its trusted patterns; seeds stay at 1. Unseen instances are neutral. Patterns are trusted from `pattern_score`, a support of
`support` and an RlogF of `rlogf` on (mass over all instances times its log to base 2: a word before anything at all is no
context). After `rounds` rounds instances of `instance_score` or more become
spans of kind `context`. Patterns and instances are grouped with partial sums; nothing is gathered.

Long texts are parted into pieces of some thousand characters, at line ends and before words, where no pattern or identifier can
reach across; positions are worked out inside a piece and moved by the lengths before it, so time is linear in a text's length (a
text without a line end or a word is one piece). A piece knows the characters on either side of it, so contexts reach across.

Defined cases: null text counts as empty; texts and tables without a seed give base spans alone; repeated rows count once in the
graph and each get their spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regrove.llm.common import pick, table, written

KINDS = ("email", "ip", "card", "phone", "context")

#: Marks inside the working copy of a text; either of them in the text itself is read as another sign outside every pattern.
DOT, GAP, OTHER = "", "", "·"
_LOCAL = f"A-Za-z0-9._%+{DOT}-"
EMAIL = f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = f"[0-9{GAP}]{{2,}}+"
PHONE = "\\+[0-9][ ().0-9-]+[0-9]"
IDENTIFIER = "(?<![^\\s])[^\\s0-9@]*+[0-9@][^\\s]*+"
#: Values (lower-case) that are no identifiers of a person: dates and times, amounts, web addresses.
SOMETHING_ELSE = "^(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?:t[0-9:.z+-]*)?|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?|[0-9]{1,3}(?:[.,][0-9]{3})+|[0-9]++[.,][0-9]{1,2}|(?:https?://|www\\.).*)$"
#: A single space between groups of one identifier: after a digit's group, before another's (digits, capitals, brackets), with at
#: most one group of up to four capitals between.
GROUPED = "(?<=[0-9][A-Za-z0-9)-]{0,20})[ ](?=[A-Z(]{0,8}[0-9]|[A-Z]{1,4} [A-Z]{0,4}[0-9])|(?<=[0-9][A-Z0-9)-]{0,20} [A-Z]{1,4})[ ](?=[A-Z]{0,4}[0-9])"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
SPANS = "array<struct<kind:string,start:int,end:int>>"
_PLACES = "array<struct<start:int,end:int,value:string>>"
_SEEN = "array<struct<start:int,end:int,value:string,seed:boolean,left:string,right:string>>"
#: Characters of context that are looked at on either side.
REACH = 48
#: Pieces of a text: at least so many characters, up to a line end or a space before a word (a letter and a small one).
PIECE = 2_000
PIECES = f"(?s).{{{PIECE},}}?(?:\\n| (?=\\p{{L}}\\p{{Ll}}))|.+"


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces(text: Column) -> Column:
    """Pieces of a text: their text t, offset `at`, and the characters `before` and `after` them."""

    def placed(parts: Column) -> Column:
        sizes = F.transform(parts, F.length)

        def piece(t: Column, i: Column) -> Column:
            before = F.when(i > 0, F.element_at(parts, i)).otherwise(F.lit(""))  # element_at counts from 1
            after = F.when(i + 1 < F.size(parts), F.element_at(parts, i + 2)).otherwise(F.lit(""))
            at = F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)
            return F.struct(t.alias("t"), at.alias("at"), F.substring(before, -REACH, REACH).alias("before"), F.substring(after, 1, REACH).alias("after"))

        return F.transform(parts, piece)

    return _let(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), placed)


def places(text: Column, pattern: str, test=None) -> Column:
    """Start, end (exclusive, code points) and value of every match, of those whose value passes `test` if one is given."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda piece, match: F.struct(F.length(piece).alias("skip"), match.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACES).alias("out"))

    def step(a: Column, x: Column) -> Column:
        first = a["at"] + x["skip"]
        after = first + F.length(x["value"])
        found = F.concat(a["out"], F.array(F.struct(first.alias("start"), after.alias("end"), x["value"].alias("value"))))
        out = F.when(test(x["value"]), found).otherwise(a["out"]) if test else found
        return F.when(x["value"].isNull(), a).otherwise(F.struct(after.alias("at"), out.alias("out")))

    return F.aggregate(both, start, step)["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    doubled = F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    turned = F.reverse(digits)

    def step(a: Column, i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, F.element_at(doubled, digit + 1)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda p: F.struct(F.lit(kind).alias("kind"), p["start"].alias("start"), p["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by kind and start. `text` is never null."""
    none = F.array().cast(SPANS)
    plain = F.translate(text, DOT + GAP, OTHER * 2)
    dotted = F.regexp_replace(plain, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", DOT)
    gapped = F.regexp_replace(plain, "(?<=[0-9])[ -](?=[0-9])", GAP)
    between = lambda low, high: lambda v: F.length(_digits(v)).between(low, high)
    email = F.when(F.contains(text, F.lit("@")), _let(dotted, lambda t: _spans("email", places(t, EMAIL)))).otherwise(none)
    ip = F.when(text.rlike("[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]"), _let(plain, lambda t: _spans("ip", places(t, IP, lambda v: v.rlike(f"^{_PART}\\.{_PART}\\.{_PART}\\.{_PART}$"))))).otherwise(none)
    card = F.when(
        text.rlike("(?:[0-9][ -]?){15}[0-9]"),
        _let(gapped, lambda t: _spans("card", places(t, CARD, lambda v: F.when(between(16, 19)(v), luhn(_digits(v))).otherwise(False)))),
    ).otherwise(none)
    phone = F.when(text.rlike("\\+[0-9]"), _let(plain, lambda t: _spans("phone", places(t, PHONE, between(8, 15))))).otherwise(none)
    return F.concat(email, ip, card, phone)


def _candidates(text: Column, spans: Column) -> Column:
    """Identifier-like tokens or runs of groups, without labels and signs at their edges, that touch no base span."""
    signs = "[^A-Za-z0-9@+]"
    plain = F.translate(text, DOT + GAP, OTHER * 2)
    # base spans are no part of a run
    plain = F.when(F.size(spans) > 0, F.aggregate(
        spans, plain, lambda a, s: F.concat(F.substring(a, F.lit(1), s["start"]), F.repeat(F.lit("\n"), s["end"] - s["start"]), F.substring(a, s["end"] + 1, F.length(a))),
    )).otherwise(plain)
    grouped = F.regexp_replace(plain, GROUPED, GAP)
    tokens = F.when(text.rlike("[0-9@]"), _let(grouped, lambda t: places(t, IDENTIFIER))).otherwise(F.array().cast(_PLACES))

    def trimmed(p: Column) -> Column:
        unlabelled = F.regexp_replace(p["value"], "^[^\\s\\p{L}0-9@]{0,4}[\\p{L}_-]{1,40}[:=](?!//)", "")
        headless = F.regexp_replace(unlabelled, f"^(?:(?!\\(\\+?[0-9]++\\)){signs})++", "")
        value = F.regexp_replace(headless, f"(?<!{signs}){signs}++$", "")
        start = p["end"] - F.length(headless)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    def fits(p: Column) -> Column:
        clear = ~F.exists(spans, lambda s: (s["start"] <= p["end"]) & (p["start"] <= s["end"]))
        return p["value"].rlike("[0-9@]") & clear

    return F.filter(F.transform(tokens, trimmed), fits)


def _occurrences(piece: Column, found: Column, seed: bool) -> Column:
    """Places with their value and the words left and right of them (lower-case, digits as 0; null at the text's ends)."""

    def word(part: Column, pattern: str) -> Column:
        got = F.regexp_replace(F.regexp_extract(part, pattern, 1), "[^\\p{L}0-9]", "")
        got = F.regexp_replace(F.lower(got), "[0-9]+", "0")
        return F.when(got != "", got)

    def row(p: Column) -> Column:
        first, last = p["start"] + F.length(piece["before"]), p["end"] + F.length(piece["before"])
        around = F.concat(piece["before"], piece["t"], piece["after"])
        left = F.substring(around, F.greatest(first + 1 - REACH, F.lit(1)), F.least(first, F.lit(REACH)))
        right = F.substring(around, last + 1, F.lit(REACH))
        return F.struct(
            (piece["at"] + p["start"]).alias("start"), (piece["at"] + p["end"]).alias("end"), F.lower(F.substring(piece["t"], p["start"] + 1, p["end"] - p["start"])).alias("value"), F.lit(seed).alias("seed"),
            word(left, "(?:^|\\s)([^\\s]{1,40})(?:\\s{1,4}|(?<=[:=]))[^\\s\\p{L}0-9]{0,4}$").alias("left"), word(right, "^[^\\s\\p{L}0-9]{0,4}\\s{1,4}([^\\s]{1,40})(?:\\s|$)").alias("right"))

    return F.transform(found, row)


def scanned(text: Column) -> Column:
    """Base spans of a text (by kind and start) and `seen`: seeds and other identifiers with their contexts."""
    none = F.struct(F.array().cast(SPANS).alias("base"), F.array().cast(_SEEN).alias("seen"))

    def scan(piece: Column) -> Column:
        def with_base(base: Column) -> Column:
            moved = F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), (piece["at"] + s["start"]).alias("start"), (piece["at"] + s["end"]).alias("end")))
            seen = F.concat(_occurrences(piece, base, True), _let(_candidates(piece["t"], base), lambda c: _occurrences(piece, c, False)))
            return F.struct(moved.alias("base"), seen.cast(_SEEN).alias("seen"))

        return F.when(piece["t"].rlike("[0-9@]"), _let(base_spans(piece["t"]), with_base)).otherwise(none)

    def joined(done: Column) -> Column:
        of = lambda kind: F.flatten(F.transform(done, lambda d: F.filter(d["base"], lambda s: s["kind"] == kind)))
        return F.struct(F.concat(*map(of, KINDS[:4])).alias("base"), F.flatten(F.transform(done, lambda d: d["seen"])).alias("seen"))

    return F.when(text.rlike("[0-9@]"), _let(F.transform(pieces(text), scan), joined)).otherwise(none)


def discovered(occurrences: DataFrame, rounds: int = 3, support: float = 5.0, pattern_score: float = 0.8, instance_score: float = 0.8, rlogf: float = 0.4) -> DataFrame:
    """(value): unseen instances that the trusted patterns vouch for. `occurrences` has value, seed, left, right."""
    side = F.explode(F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right")))
    edges = occurrences.select("value", "seed", side.alias("pattern")).where("pattern is not null").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    edges = edges.withColumn("other", ~F.col("seed") & F.col("value").rlike(SOMETHING_ELSE))
    # a pattern without seeds enough now can only gain by instances that seeded patterns vouch for
    edges = written(edges.withColumn("score", F.col("seed").cast("double")), "pattern-edges")
    found = None
    for _ in range(rounds):
        patterns = edges.groupBy("pattern").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("n"), F.sum(F.col("other").cast("int")).alias("against"))
        trust = F.col("mass") / (F.col("mass") + F.col("against") + 1)
        trusted = patterns.where((F.col("mass") >= support) & (trust >= pattern_score) & (F.col("mass") / F.col("n") * F.log2("mass") >= rlogf)).select("pattern", trust.alias("trust"))
        vouched = edges.where("not seed and not other").join(trusted, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.999)))))).alias("now"))
        found = written(vouched, "instances")
        if found.isEmpty():
            break
        edges = written(edges.drop("score").join(found, "value", "left").select("pattern", "value", "seed", "other", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("now", F.lit(0.0))).alias("score")), "pattern-edges")
    return found.where(F.col("now") >= instance_score).select("value")


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", **graph) -> DataFrame:
    """Columns `keep` of every row and `pii_spans` (kind, start, end; code points), base kinds first, each by start."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = pick(docs, *dict.fromkeys((*keep, text)))
    rows = rows.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(text, F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row"))
    found = written(rows.select(*names, "row", scanned(F.col("t")).alias("x")), "pii-rows").select(*names, "row", "x.base", "x.seen")
    seen = found.where("size(seen) > 0").select("row", F.explode("seen").alias("o")).select("row", "o.*")
    values = discovered(seen, **graph)
    more = seen.where("not seed").join(values, "value").groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct(F.lit(KINDS[-1]).alias("kind"), "start", "end"))).alias("more"))
    joined = found.join(more, "row", "left")
    spans = F.concat("base", F.coalesce("more", F.array().cast(SPANS)))
    return joined.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], spans.alias("pii_spans"))


def _first_from(spans: Column, place: Column) -> Column:
    """How many spans (sorted by start) start before a place, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        before = F.element_at(spans, middle + 1)["start"] < place
        halved = F.when(before, F.struct((middle + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), middle.alias("hi")))
        return F.when(a["lo"] >= a["hi"], a).otherwise(halved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, step)["lo"]


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named by the first.

    Spans are those of `find_pii`: none reaches from one of the text's pieces into the next.
    """

    def masked(t: Column, own: Column, at: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(a: Column, s: Column) -> Column:
            first, last = s["start"] - at, s["end"] - at
            gap = F.substring(t, a["at"] + 1, first - a["at"])
            put = F.concat(a["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.struct(F.greatest(a["at"], last).alias("at"), F.when(first < a["at"], a["out"]).otherwise(put).alias("out"))

        return F.aggregate(own, start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))

    def whole(ordered: Column) -> Column:
        def piece(p: Column) -> Column:
            return _let(_first_from(ordered, p["at"]), lambda lo: masked(p["t"], F.slice(ordered, lo + 1, _first_from(ordered, p["at"] + F.length(p["t"])) - lo), p["at"]))

        return F.array_join(F.transform(pieces(text), piece), "")

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, _let(by_start, whole)).otherwise(text)


def joined_text(kinds: tuple[str, ...]) -> Column:
    """pii_spans of those kinds as kind:start:end by kind as listed, then start, comma-joined."""
    order = F.array(*[F.lit(k) for k in kinds])
    mine = F.filter("pii_spans", lambda s: F.array_contains(order, s["kind"]))
    ranked = F.array_sort(F.transform(mine, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined_text(KINDS[:4]), 256).alias("base_sha256"), joined_text(KINDS).alias("spans"))
