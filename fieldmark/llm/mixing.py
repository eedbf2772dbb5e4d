"""Mixing sources to target weights (operator 8): whole copies, then Pareto order sampling of the remainder."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import bounded, cut, drop, n_words

#: Cells into which a source's ranks are counted at each of two levels before the last cell is ranked row by row.
CELLS = 4096
#: Copies of a row go as its size to this power: twice the words, a fifth more copies, and half of a text's length counts.
TILT = 0.25
#: Copies this close to a whole number are that number.
NEAR = 1e-9


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size) -> the same and target.

    Sources in code point order, null last, weigh `weights`, repeating, and share `share` times all sizes. No target
    is above `most` times its source's size; what is above goes to the others by weight until none is. In closed form:
    a target is the smaller of its cap and weight * level, and the level is the largest of those that leave out the
    sources with the smallest caps by weight, one more at a time.
    """
    everywhere, before = Window.partitionBy(), Window.orderBy("full", "n").rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])[n % len(weights)]
    room = share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (
        sources.withColumns({"n": n, "weight": weight, "cap": most * F.col("source_size")})
        .withColumn("full", F.col("cap") / F.col("weight"))
        .withColumn("level", room / left)
        .withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(everywhere)))
        .select("source", "source_size", "target")
    )


def band(size: Column) -> Column:
    """The power of two that a size reaches; sizes of 0 and 1 share one. At most 63 however long the texts."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double") + 0.5)).cast("int")


def expected(bands: DataFrame, most: float = 2.0, tilt: float = TILT) -> DataFrame:
    """bands (source, band, words, target) -> the same and copies: how many copies of a row of the band are expected.

    copies = min(most, c * 2^(tilt * band)), c such that the source's expected words are its target. In closed form, as
    targets(): c is the largest of those that leave out the bands that fill first, one more at a time.
    """
    w = Window.partitionBy("source")
    before = w.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    lean = F.pow(F.lit(2.0), tilt * F.col("band"))
    room = F.col("target") - F.coalesce(F.sum(most * F.col("words")).over(before), F.lit(0.0))
    left = F.sum(F.col("words") * lean).over(w.orderBy(F.desc("band")).rowsBetween(0, Window.unboundedFollowing))
    level = F.when(F.col("words") > 0, room / left)
    return bands.withColumn("level", level).withColumn("copies", F.least(F.lit(most), F.coalesce(F.max("level").over(w), F.lit(0.0)) * lean)).drop("level")


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, ...) with _key: what tells rows apart, id, source and text; equal rows have one key."""
    part = lambda c: F.coalesce(c, F.lit(""))
    text = part(F.md5(F.col("text").cast("binary")))
    source = part(F.concat(F.lit("s"), F.col("source").cast("string")))
    return docs.withColumn("_key", F.md5(F.concat_ws(":", part(F.col("doc_id").cast("string")), source, text).cast("binary")))


def numbered(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """rows with _nth: 0, 1, ... among rows of one _key. repeated: the keys of several rows, None if there are none.

    Rows of one key are equal, so any of them may have any number. They are numbered where they are, and what other
    tasks hold of the key is added, so that no task gets all rows of a key.
    """
    if repeated is None:
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    marked = rows.join(bounded(repeated.withColumn("_more", F.lit(True))), "_key", "left")
    once = marked.where("_more is null").drop("_more").withColumn("_nth", F.lit(0).cast("long"))
    several = marked.where("_more").drop("_more").withColumn("_task", F.floor(F.rand(8) * 1024).cast("int"))
    several = cut(several)
    own = several.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_task").orderBy(F.lit(0))).cast("long") - 1)
    sums = several.groupBy("_key", "_task").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_key", "_task", before.alias("_before"))
    placed = own.join(offsets, ["_key", "_task"]).withColumn("_nth", F.col("_nth") + F.col("_before")).drop("_before", "_task")
    return once.unionByName(placed)


def uniform(seed: int) -> Column:
    """A number in (0, 1) that depends on a row's _key, its _nth and the seed alone: reruns and other machines draw the same."""
    digits = F.substring(F.md5(F.concat(F.col("_key"), F.lit(":"), F.col("_nth").cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def ratio(part: Column, seed: int) -> Column:
    """Pareto's ratio q, odds of the draw over odds of the inclusion, as q / (1 + q) in 0 to 1; null where nothing is left to draw."""
    u = uniform(seed)
    q = (u / (1 - u)) / (part / (1 - part))
    return F.when(part > 0, q / (1 + q))


def _with(rows: DataFrame, table: DataFrame, *names: str) -> DataFrame:
    """rows (source, band, ...) with the named columns of their source's and band's row."""
    named = table.select(F.col("source").alias("_s"), F.col("band").alias("_b"), *names)
    return rows.join(bounded(named), F.col("source").eqNullSafe(F.col("_s")) & (F.col("band") == F.col("_b"))).drop("_s", "_b")


def plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 8, tilt: float = TILT) -> DataFrame:
    """rows (_key, _nth, source, size, band) -> a row a source and band: source_size, target, whole, part, last_v, last_key.

    A row is taken `whole` times, and once more if (v, _key) is up to its source's (last_v, last_key): ranked by random
    odds over inclusion odds, rows are taken while the middle of the next is within what the whole copies leave of the
    target. Where that point lies is found from sums over cells of v, then over cells of the one cell, then row by
    row in the one that is left (a source's rows / 2^24), so no source is ever sorted in one task.
    """
    bands = cut(rows.groupBy("source", "band").agg(F.sum("size").alias("words")))
    aimed = targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    aimed = aimed.select(F.col("source").alias("_s"), "source_size", "target")
    each = expected(bands.join(bounded(aimed), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), most, tilt)
    whole = F.floor(F.col("copies") + NEAR)
    left = F.col("copies") - whole
    each = each.withColumns({"whole": whole, "part": F.when(left > NEAR, left).otherwise(0.0)})
    each = cut(each.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))))
    open_ = _with(rows, each, "part", "rest").withColumn("v", ratio(F.col("part"), seed)).where("v is not null")
    cell = lambda k: F.floor(F.col("v") * F.lit(float(CELLS**k)))
    crossing = None
    for k in (1, 2):
        if crossing is not None:
            named = crossing.select(F.col("source").alias("at"), F.col("cell").alias("upper"), "done")
            open_ = open_.drop("done").join(bounded(named), F.col("source").eqNullSafe(F.col("at")) & (cell(k - 1) == F.col("upper"))).drop("at", "upper")
        else:
            open_ = open_.withColumn("done", F.lit(0).cast("long"))
        sums = open_.groupBy("source", "rest", "done", cell(k).alias("cell")).agg(F.sum("size").alias("size"))
        before = F.col("done") + F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        crossing = cut(sums.withColumn("before", before).where("before <= rest and rest < before + size").select("source", "cell", F.col("before").alias("done"), "size", "rest"))
    named = crossing.select(F.col("source").alias("at"), F.col("cell").alias("upper"), "done")
    last = open_.drop("done").join(bounded(named), F.col("source").eqNullSafe(F.col("at")) & (cell(2) == F.col("upper"))).drop("at", "upper")
    before = F.col("done") + F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("v", "_key", "_nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = last.withColumn("before", before).where("before + size / 2 <= rest").groupBy(F.col("source").alias("at")).agg(F.max(F.struct("v", "_key", "_nth")).alias("last"))
    cells = crossing.select(F.col("source").alias("in"), (F.col("cell") / F.lit(float(CELLS**2))).alias("floor"))
    # a source whose rest is at or past all its open rows takes all of them, one with nothing left to draw takes none
    found = cut(
        each.join(bounded(cells), F.col("source").eqNullSafe(F.col("in")), "left")
        .join(bounded(taken), F.col("source").eqNullSafe(F.col("at")), "left")
        .withColumn("last_v", F.coalesce("last.v", "floor", F.lit(2.0)))
        .select("source", "band", "source_size", "target", "whole", "part", "last_v", F.coalesce("last._key", F.lit("")).alias("last_key"), F.coalesce("last._nth", F.lit(-1)).alias("last_nth"))
    )
    drop(bands, each)
    return found


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 8, tilt: float = TILT) -> DataFrame:
    """docs (doc_id, text, source, ...) -> every row of docs, with size, source_size, target, copies and taken.

    size: the text's words (null: 0). A row is taken `copies` times, `taken` words in all. How many copies are expected
    grows with the text's size (TILT); whole ones are certain, what is left is drawn by Pareto order sampling. A source's
    taken words are within half a row of its target, if that row is one of those drawn from. Rows that repeat a doc_id,
    or have none, are drawn each for itself. A null source is a source, the last. Sources without words have target 0 and take nothing. Columns of docs
    with one of these names are replaced; others stay, but none may be called _key, _nth or _mix_*. An empty table gives an
    empty one.
    """
    own = ["size", "source_size", "target", "copies", "taken"]
    sized = keyed(docs.drop(*own).withColumn("size", n_words(F.col("text"))).withColumn("_mix_band", band(F.col("size"))))
    rows = cut(sized.select("_key", "source", "size", F.col("_mix_band").alias("band")))
    several = cut(rows.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"))
    repeated = None if several.isEmpty() else several
    found = plan(numbered(rows, repeated), weights, share, most, seed, tilt)
    found = found.select(*[F.col(c).alias(f"_mix_{c}") for c in found.columns]).withColumnRenamed("_mix_band", "_mix_of")
    v = ratio(F.col("_mix_part"), seed)
    place, last = F.struct(v.alias("v"), F.col("_key").alias("k"), F.col("_nth").alias("n")), F.struct(F.col("_mix_last_v").alias("v"), F.col("_mix_last_key").alias("k"), F.col("_mix_last_nth").alias("n"))
    copies = (F.col("_mix_whole") + F.when(F.col("_mix_part") > 0, (place <= last).cast("long")).otherwise(0)).cast("long")
    return (
        numbered(sized, repeated)
        .join(bounded(found), F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_band") == F.col("_mix_of")))
        .withColumns({"copies": copies, "source_size": F.col("_mix_source_size"), "target": F.col("_mix_target")})
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*[c for c in docs.columns if c not in own], "size", "source_size", "target", "copies", "taken")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce('s' || source, ''), coalesce(md5(text), ''))) AS key,
      CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY key) - 1 AS nth, CAST(floor(log2(greatest(size, 1) + 0.5::DOUBLE)) AS INT) AS band FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][n % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
b AS (SELECT source, band, CAST(sum(size) AS BIGINT) AS words, power(2.0::DOUBLE, 0.25::DOUBLE * band) AS lean FROM e GROUP BY source, band),
c AS (SELECT b.*, t.source_size, t.target, CASE WHEN words > 0 THEN (target - coalesce(sum(2.0::DOUBLE * words) OVER p, 0)) / sum(words * lean) OVER q END AS level
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
      WINDOW p AS (PARTITION BY b.source ORDER BY band DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY b.source ORDER BY band DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, least(2.0::DOUBLE, coalesce(max(level) OVER (PARTITION BY source), 0) * lean) AS copies FROM c),
g AS (SELECT *, floor(copies + 1e-9::DOUBLE) AS whole, CASE WHEN copies - floor(copies + 1e-9::DOUBLE) > 1e-9::DOUBLE THEN copies - floor(copies + 1e-9::DOUBLE) ELSE 0 END AS part FROM f),
h AS (SELECT *, target - sum(whole * words) OVER (PARTITION BY source) AS rest FROM g),
u AS (SELECT e.doc_id, e.size, e.key, e.nth, h.source, h.source_size, h.target, h.whole, h.part, h.rest,
      (CAST('0x' || substr(md5(e.key || ':' || e.nth || ':8'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM e JOIN h ON e.source IS NOT DISTINCT FROM h.source AND e.band = h.band),
o AS (SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS odds FROM u),
k AS (SELECT *, CASE WHEN part > 0 THEN coalesce(sum(CASE WHEN part > 0 THEN size END) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, key, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS before FROM o)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN part > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM k
"""
