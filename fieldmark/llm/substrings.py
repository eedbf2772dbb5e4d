"""Substring dedup (operator 3): difference-cover anchors find what documents share, windows around them decide."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import cut, drop

WINDOW = 50
#: Perfect difference sets, fixed values: every residue modulo the period is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Rows of a batch that a task hands back.
ROWS = 1 << 17


def cover(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, residues, anchor words): wherever two windows of equal words start, some shift below the period puts
    both on a residue, and the anchor there still lies within the window. Anchors keep two fifths of a window."""
    period = max(p for p in COVERS if window - p + 1 >= 0.4 * window)
    return period, COVERS[period], window - period + 1


def _split(text: bytes | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each starts and ends."""
    words = (text or b"").split()  # of bytes: at ASCII white space
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.concatenate(([0], ends[:-1] + 1)) if words else ends, ends


def _anchors(text: bytes | None, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of a text; none if it has no window."""
    period, residues, size = cover(window)
    line, starts, ends = _split(text)
    n = len(starts)
    if n < window:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    at = np.arange(n - size + 1)
    at = at[np.isin(at % period, residues)]
    digest = xxhash.xxh3_64_intdigest
    spans = zip(starts[at].tolist(), ends[at + size - 1].tolist(), strict=True)
    return at.astype(np.int32), np.fromiter((digest(line[s:e]) for s, e in spans), np.uint64, len(at)).view(np.int64)


def _candidates(n: int, places: np.ndarray, window: int) -> np.ndarray:
    """Where windows start that hold an anchor at one of the places."""
    period, _, _ = cover(window)
    mark = np.zeros(n + 1, np.int64)
    places = places[places < n]
    np.add.at(mark, np.maximum(places - period + 1, 0), 1)
    np.add.at(mark, places + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: max(0, n - window + 1)] > 0)


def _windows(text: bytes | None, places: np.ndarray, window: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, starts, ends, where candidate windows start, their 128-bit hashes as two columns)."""
    line, starts, ends = _split(text)
    at = _candidates(len(starts), places, window)
    digest = xxhash.xxh3_128_digest
    spans = zip(starts[at].tolist(), ends[at + window - 1].tolist(), strict=True)
    found = np.frombuffer(b"".join(digest(line[s:e]) for s, e in spans), "<i8").reshape(-1, 2)
    return line, starts, ends, at, found


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """rows: tuples of numpy columns, gathered until there are enough."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[0])
        if n >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> (h, doc_id, place) at the cover's places of each text; null ids have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    at, h = _anchors(text.as_py(), window)
                    if len(at):
                        yield h, np.full(len(at), doc_id, np.int64), at

        yield from _batches(rows(), [pa.int64(), pa.int64(), pa.int32()], ["h", "doc_id", "place"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "h long, doc_id long, place int")


def summaries(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, sha256, k1, k2) of each row: what it is if nothing is removed, and a 128-bit key of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, keys = [], [], []
            for text in b.column(1):
                words = (text.as_py() or b"").split()
                line = b" ".join(words)
                n.append(len(words))
                sha.append(hashlib.sha256(line).hexdigest())
                keys.append(xxhash.xxh3_128_digest(line))
            both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "n_words", "sha256", "k1", "k2"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_words long, sha256 string, k1 long, k2 long")


def repeats(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """texts (doc_id, text, places) -> (w1, w2, doc_id): hashes of the windows around anchors, once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, text, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    found = np.unique(_windows(text.as_py(), places.values.to_numpy(), window)[4], axis=0)
                    if len(found):
                        yield found[:, 0], found[:, 1], np.full(len(found), doc_id, np.int64)

        yield from _batches(rows(), [pa.int64()] * 3, ["w1", "w2", "doc_id"])

    return texts.select("doc_id", "text", "places").mapInArrow(run, "w1 long, w2 long, doc_id long")


def _both(hashes: np.ndarray) -> np.ndarray:
    """Rows of two numbers as values of 16 bytes."""
    return np.ascontiguousarray(hashes).view([("w1", "<i8"), ("w2", "<i8")]).ravel()


def strip(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """texts (doc_id, text, places, gone: hashes of windows to remove) -> (doc_id, k1, k2, n_removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, places, gone in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                line, starts, ends, at, found = _windows(text.as_py(), places.values.to_numpy(), window)
                hit = at[np.isin(_both(found), _both(np.column_stack([gone.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)])))]
                mark = np.zeros(len(starts) + 1, np.int64)
                np.add.at(mark, hit, 1)
                np.add.at(mark, hit + window, -1)
                stay = np.flatnonzero(np.cumsum(mark)[:-1] == 0)
                kept = b" ".join(line[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True))
                k1, k2 = np.frombuffer(xxhash.xxh3_128_digest(line), "<i8").tolist()
                out.append((doc_id, k1, k2, len(starts) - len(stay), kept.decode()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], ["doc_id", "k1", "k2", "n_removed", "kept"])

    return texts.select("doc_id", "text", "places", "gone").mapInArrow(run, "doc_id long, k1 long, k2 long, n_removed long, kept string")


def dedup(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (rows, changed).

    A word is removed if a window of `window` words covers it whose words also start somewhere in a document with a
    smaller doc_id; windows are those of the texts as they came. rows: doc_id, n_words, n_removed, sha256 of the kept
    words, and the key (k1, k2) of the words, a row for each row of docs. changed: (doc_id, k1, k2, n_removed, kept),
    the kept words of what lost some but not all.

    1. Whole texts of equal words: all but those with the smallest id lose everything, and take no further part.
    2. Anchors that occur under two ids or more are marked; any window that two documents share holds such an anchor,
       at the same place of the window in both.
    3. Only windows that hold a marked anchor are hashed (128 bits); the smallest id of each hash decides.
    Hashes are grouped with partial sums, and joins leave hot keys to Spark's splitting; no task holds a group.
    Null and blank texts have no word. A null doc_id loses nothing and takes nothing away. Rows that share a doc_id take
    nothing from each other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(summaries(docs))
    first = rows.where(F.col("n_words") >= window).groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("k1", "k2", "first")
    copies = rows.join(first, ["k1", "k2"], "left").select("doc_id", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy"))
    whole = cut(copies.groupBy("doc_id").agg(F.min("copy").alias("copy")).where("copy").select("doc_id"))
    marked = cut(anchors(docs, window).select("h", "doc_id").groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"))
    places = cut(anchors(docs, window).join(marked, "h").join(whole, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("place").alias("places")))
    texts = cut(docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(places, "doc_id"))
    drop(whole, marked, places)
    hashed = repeats(texts, window)
    owners = cut(hashed.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first"))
    gone = cut(hashed.join(owners, ["w1", "w2"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set(F.struct("w1", "w2")).alias("gone")))
    changed = cut(strip(texts.join(gone, "doc_id"), window))
    drop(texts, owners, gone)
    lost = changed.select("doc_id", "k1", "k2", F.col("n_removed").alias("lost"), F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["doc_id", "k1", "k2"])
    named = rows.join(first, ["k1", "k2"], "left").join(lost, ["doc_id", "k1", "k2"], "left")
    empty = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return (
        named.select(
            "doc_id", "n_words", F.when(empty, F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0))).cast("long").alias("n_removed"),
            F.when(empty, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"), "k1", "k2",
        ),
        changed,
    )
