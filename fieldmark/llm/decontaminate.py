"""Benchmark decontamination (operator 2): size-partitioned MinHash containment search, verified exactly."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import bounded, cut, let, words

#: Sketch rows that may be broadcast (16 bytes each, about 10 MB in all); a larger benchmark's sketches are joined by shuffling.
SKETCH_ROWS = 200_000


def _spans(w: Column, k: int) -> Column:
    """Where shingles start; fewer than k words make one shingle, none make none."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingles(text: Column, k: int) -> Column:
    """The distinct k-word shingles of a lower-cased text, words joined by a space."""
    return let(words(F.lower(text)), lambda w: F.array_distinct(F.transform(_spans(w, k), lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " "))))


def hashes(text: Column, k: int) -> Column:
    """A 64-bit hash of each shingle's words, repeats included."""
    return let(words(F.lower(text)), lambda w: F.transform(_spans(w, k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))


def sketches(items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """items (item_id, text) -> (item_id, h): each item's smallest shingle hashes, as many as its size class needs.

    A class holds the items of up to m shingles, m + 1 a power of two. A document that contains `threshold` of an item
    lacks fewer than m - ceil(threshold * m) + 1 of its shingles, so of that many smallest hashes it has one: the
    search misses nothing, whatever the document's length.
    """
    own = items.select("item_id", F.array_sort(F.array_distinct(hashes(F.col("text"), k))).alias("hs")).where("size(hs) > 0")
    most = F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2.0), F.floor(F.log2(F.size("hs").cast("double") + 0.5)) + 1) - 1
    enough = (most - F.ceil(most * threshold - 1e-9) + 1).cast("int")
    return own.select("item_id", F.explode(F.slice("hs", F.lit(1), enough)).alias("h")).distinct()


def _row_key(docs: DataFrame) -> DataFrame:
    """docs with _row: the id, or what tells the text of a row without one."""
    text = F.concat(F.lit("text "), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    return docs.withColumn("_row", F.coalesce(F.col("doc_id").cast("string"), text))


def contained(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> (doc_id, item_id, n_shared, n_shingles, containment).

    A row for each document that has `threshold` or more of an item's distinct k-word shingles, words lower-cased.
    Null, empty and blank texts have no shingle: such items are in no document, such documents contain nothing. A text
    of fewer than k words is one shingle. Rows that repeat an id count once, with the largest share; rows without an id
    are searched like all others, and count once, under a null doc_id. Items without an item_id are in no document.
    Extra columns are not read. Empty tables give an empty one.
    """
    docs = _row_key(docs.select("doc_id", "text"))
    found = sketches(items.select("item_id", "text"), k, threshold)
    hits = docs.select("_row", F.explode(hashes(F.col("text"), k)).alias("h")).join(bounded(found, SKETCH_ROWS), "h")
    pairs = cut(hits.select("_row", "item_id").distinct())
    sets = items.select("item_id", shingles(F.col("text"), k).alias("item"))
    share = (
        docs.join(pairs, "_row").join(bounded(sets), "item_id")
        .select("doc_id", "item_id", F.size(F.array_intersect("item", shingles(F.col("text"), k))).cast("long").alias("n_shared"), F.size("item").cast("long").alias("n_shingles"))
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    )
    best = F.max(F.struct("containment", "n_shared", "n_shingles")).alias("x")
    return share.where(F.col("containment") >= threshold - 1e-12).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.n_shared", "x.n_shingles", "x.containment")


def clean(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that contain no item.

    Rows that repeat an id go together, if one of them contains an item. Rows without a doc_id are judged by their text.
    All columns stay; none may be called _row.
    """
    keyed = _row_key(docs)
    found = contained(keyed.select(F.col("_row").alias("doc_id"), "text"), items, k, threshold).select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(found, "_row", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles::DOUBLE AS containment FROM c JOIN n USING (item_id) WHERE n_shared / n_shingles::DOUBLE >= 0.8 - 1e-12
"""
