"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Sizes are words. Every source has a weight (5, 2, 1 in turn over the sources by code point, null last); the mix takes `share` of
all words, dealt by weight, and no source gives more than `limit` times its words: what is above is dealt again by weight until
none is above. A document of a source is wanted target / source size times. Its whole copies are certain; the fraction is rounded
by the pivotal method: two units with fractions p and q duel, one takes the mass of both until it is 0 or 1 and is settled, the
other goes on. So every fraction is kept in expectation, and each source's sum is met up to one unit.

The duels form a reduction tree: units are dealt to chunks of about `CHUNK` of one source and of like size, a chunk folds to one
residual unit, residuals of neighbouring chunks fold again, and so on up to one unit per source, which a last draw settles. Units
of like size meet, large ones first, so the words taken stay near the target. Fractions are whole numbers of 2^-30, draws are hashes of
the two units: reruns, other partitionings and recomputed tasks give the same mix.

Rows with equal id, source and size are one unit with a count and are handed their copies evenly, so repeats can't fill a chunk.
Defined cases: null text has size 0; null ids and sources are values like any other; documents of size 0 take 0 words; an empty
table gives an empty mix. Any other column of the input is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regrove.llm.common import pick, table, written

WEIGHTS = (5, 2, 1)
CHUNK = 64
#: Equal rows that are handed their copies at a time.
STRETCH = 1 << 16
ONE = 1 << 30
WORD = "[^\\x20\\x09-\\x0D]+"

_UNIT = "struct<size:bigint,h:bigint,id:{id},m:bigint,k:bigint,p:bigint>"

#: One duel: a.carry against x; `first` says whether the carried unit gets the mass of both (sum below one) or the whole copy.
_DUEL = """
aggregate(units, named_struct('carry', cast(null as {unit}), 'out', cast(array() as array<{unit}>)), (a, x) ->
  case when a.carry is null then named_struct('carry', x, 'out', a.out)
  when a.carry.p + x.p < {one} then
    case when pmod(xxhash64(a.carry.h, x.h, {seed}), {one}) * (a.carry.p + x.p) < a.carry.p * {one}
    then named_struct('carry', {carried_sum}, 'out', concat(a.out, array({x_0})))
    else named_struct('carry', {x_sum}, 'out', concat(a.out, array({carried_0}))) end
  when a.carry.p + x.p = {one} then
    case when pmod(xxhash64(a.carry.h, x.h, {seed}), {one}) < a.carry.p
    then named_struct('carry', cast(null as {unit}), 'out', concat(a.out, array({carried_1}, {x_0})))
    else named_struct('carry', cast(null as {unit}), 'out', concat(a.out, array({x_1}, {carried_0}))) end
  when pmod(xxhash64(a.carry.h, x.h, {seed}), {one}) * (2 * {one} - a.carry.p - x.p) < ({one} - x.p) * {one}
    then named_struct('carry', {x_rest}, 'out', concat(a.out, array({carried_1})))
    else named_struct('carry', {carried_rest}, 'out', concat(a.out, array({x_1}))) end)
"""


def _with(unit: str, p: str) -> str:
    """The unit with another fraction."""
    return f"named_struct('size', {unit}.size, 'h', {unit}.h, 'id', {unit}.id, 'm', {unit}.m, 'k', {unit}.k, 'p', {p})"


def duels(id_type: str, seed: int) -> str:
    """SQL: folds the array `units` to a carried unit (or null) and the settled ones (p = 0 or ONE)."""
    both = "a.carry.p + x.p"
    return _DUEL.format(
        unit=_UNIT.format(id=id_type), one=f"{ONE}L", seed=f"{seed}L", carried_sum=_with("a.carry", both), x_sum=_with("x", both),
        x_0=_with("x", "0L"), carried_0=_with("a.carry", "0L"), x_1=_with("x", f"{ONE}L"), carried_1=_with("a.carry", f"{ONE}L"),
        x_rest=_with("x", f"{both} - {ONE}L"), carried_rest=_with("a.carry", f"{both} - {ONE}L"),
    )


def ranked(df: DataFrame, column: str) -> DataFrame:
    """`df` with `rank`, its place (from 0) by `column`, null last: sorted by ranges, ranges' counts summed up. No row meets all others."""
    placed = written(
        df.repartitionByRange(F.asc_nulls_last(column)).sortWithinPartitions(F.asc_nulls_last(column)).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.col("at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + local).drop("part", "at", "before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), limit: int = 2) -> DataFrame:
    """Per source: source, source_size, weight, target. `sizes` has source and size."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(ranked(sources, "source").select("source", "source_size", turn.cast("long").alias("weight")), "sources")
    # Whole numbers: share = up / down; a source is full when limit * size * W * down < left * weight, left = up * S - down * full sizes
    up, down = share
    size, weight = (F.col(c).cast("decimal(38,0)") for c in ("source_size", "weight"))
    total = sources.agg(F.sum(size)).first()[0] or 0
    left, open_weight = up * int(total), int(sources.agg(F.sum(weight)).first()[0] or 0)
    while True:
        if not open_weight or not left:
            left, open_weight = 0, 1
            break
        full = size * F.lit(limit * down) * F.lit(open_weight) < F.lit(left) * weight
        row = sources.where(full).agg(F.sum(size), F.sum(weight)).first()
        now = (up * int(total) - down * limit * int(row[0] or 0), int(sources.agg(F.sum(weight)).first()[0]) - int(row[1] or 0))
        if now == (left, open_weight):
            break
        left, open_weight = now
    full = size * F.lit(limit * down) * F.lit(open_weight) < F.lit(left) * weight
    target = F.when(full, F.col("source_size") * float(limit)).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(down * open_weight)))
    return sources.withColumn("target", target)


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), limit: int = 2) -> DataFrame:
    """Per row of `docs`: id, source, size, source_size, target (its source's), copies, taken (copies times size)."""
    sizes = pick(docs, id, source, text).select(F.col(id).alias("id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = written(sizes, "sizes")
    id_type = sizes.schema["id"].dataType.simpleString()
    targets = written(source_targets(sizes, weights, share, limit), "targets")
    # a key that is never null, so plain joins keep the null source
    keyed = targets.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(limit)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    units = sizes.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    units = units.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    units = units.join(keyed.select("key", F.round(rate * ONE).cast("long").alias("f")), "key")
    fraction = F.col("f") % ONE
    units = units.select(
        "key", "size", F.xxhash64(F.col("id").cast("string"), "source", "size", F.lit(seed)).alias("h"), "id", "m", "f",
        F.floor(F.col("m") * fraction / ONE).cast("long").alias("k"), ((F.col("m") * fraction) % ONE).alias("p"),
        F.floor(F.log2(F.greatest("size", F.lit(1))) * 4).cast("int").alias("band"))
    units = written(units, "units")
    whole = (F.col("p") == 0) | (F.col("size") == 0)
    settled = [units.where(whole).select("key", F.struct("size", "h", "id", "m", "k", F.lit(0).cast("long").alias("p")).alias("unit"))]
    open_ = units.where(~whole)
    chunks = open_.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks"))
    chunks = written(chunks, "chunks")
    most = chunks.agg(F.max("chunks")).first()[0] or 0
    level = open_.join(chunks, ["key", "band"]).select("key", "band", F.pmod("h", F.col("chunks")).alias("slot"), F.struct("size", "h", "id", "m", "k", "p").alias("unit"))
    depth = 0
    while True:
        folded = level.groupBy("key", "band", "slot").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        folded = written(folded.select("key", "band", "slot", F.expr(duels(id_type, seed + depth)).alias("r")).select("key", "band", "slot", "r.carry", "r.out"), "duels")
        settled.append(folded.select("key", F.explode("out").alias("unit")))
        rest = folded.where("carry is not null").select("key", "band", "slot", F.col("carry").alias("unit"))
        if most > 1:  # neighbouring chunks of a size band
            most = -(-most // CHUNK)
            level = rest.withColumn("slot", F.expr(f"slot div {CHUNK}"))
        elif most >= 0:  # all bands of a source: as many as sizes have quarter powers of two
            most = -1
            level = rest.select("key", F.lit(0).alias("band"), F.lit(0).cast("long").alias("slot"), "unit")
        else:  # one unit per source is left
            drawn = F.when(F.pmod(F.xxhash64("unit.h", F.lit(seed - 1)), F.lit(ONE)) < F.col("unit.p"), ONE).otherwise(0).cast("long")
            settled.append(rest.select("key", F.col("unit").withField("p", drawn).alias("unit")))
            break
        depth += 1
    every = settled[0]
    for part in settled[1:]:
        every = every.union(part)
    rows = every.select("key", "unit.*").join(keyed.select("key", "source", "source_size", "target", F.round(rate * ONE).cast("long").alias("f")), "key")
    extra = F.col("k") + F.expr(f"p div {ONE}L")
    counted = rows.select("id", "source", "size", "source_size", "target", F.expr(f"f div {ONE}L").alias("base"), extra.alias("extra"), "m", F.hash("h").alias("h"))
    # units of very many equal rows are told off in stretches, dealt over the tasks; no array holds more than a stretch
    long = counted.where(F.col("m") > STRETCH).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(STRETCH).cast("long")))).repartition("h", "first")
    counted = counted.where(F.col("m") <= STRETCH).withColumn("first", F.lit(0).cast("long")).union(long)
    each = counted.withColumn("i", F.explode(F.sequence(F.col("first") + 1, F.least(F.col("first") + STRETCH, "m"))))
    copies = F.col("base") + (F.col("i") <= F.col("extra")).cast("long")
    return each.select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
