"""Language ID (operator 5): prediction by partial matching with byte contexts, one frozen model a language."""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import shuffle_partitions

ORDER = 3
#: Labelled texts that a language is learnt from, whole, in the order of a hash of their ids and texts.
SAMPLE_TEXTS = 200
PAD = b"\n" * ORDER


def _count(texts: list[bytes], order: int) -> list[Counter]:
    """For k = 0 to order, how often each k + 1 bytes occur; contexts reach over a text's start into padding."""
    counts = [Counter() for _ in range(order + 1)]
    for text in texts:
        padded = PAD[:order] + text
        for k in range(order + 1):
            counts[k].update(padded[i - k : i + 1] for i in range(order, len(padded)))
    return counts


class Model:
    """Code lengths in bits of a byte after its context, for all languages, under frozen counts.

    A language's tree has at each context n bytes seen, of d kinds. A kind seen c times costs -log2(c / (n + d)), an
    escape to the context that is shorter by a byte -log2(d / (n + d)) (PPM with method C, without exclusion); a
    context never seen costs nothing to leave; below order 0 each of 256 bytes costs 8 bits. Costs of every string of
    order + 1 bytes that some language has seen are tabled; a string not in the table costs what leaving its context
    costs, and then what its shorter string costs.
    """

    def __init__(self, langs: list[str], counts: list[list[Counter]], order: int):
        self.langs, self.order = langs, order
        n = len(langs)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []  # of order k: keys (sorted), costs
        self.leave: list[tuple[np.ndarray, np.ndarray]] = []  # of contexts of k bytes: keys (sorted), escape costs
        below = lambda s, j: 8.0
        self._cost = [dict() for _ in range(order + 1)]
        for k in range(order + 1):
            kinds, totals = [Counter() for _ in langs], [Counter() for _ in langs]
            for j in range(n):
                for s, c in counts[j][k].items():
                    kinds[j][s[:-1]] += 1
                    totals[j][s[:-1]] += c
            keys = sorted(set().union(*[counts[j][k] for j in range(n)]))
            costs = np.empty((len(keys), n), np.float64)
            for i, s in enumerate(keys):
                ctx = s[:-1]
                for j in range(n):
                    if c := counts[j][k].get(s, 0):
                        costs[i, j] = -np.log2(c / (totals[j][ctx] + kinds[j][ctx]))
                    else:
                        d = kinds[j].get(ctx, 0)
                        esc = -np.log2(d / (totals[j][ctx] + d)) if d else 0.0
                        costs[i, j] = esc + (self._one(s[1:], k - 1, j) if k else below(s, j))
            contexts = sorted(set().union(*kinds))
            leave = np.zeros((len(contexts), n))
            for i, ctx in enumerate(contexts):
                for j in range(n):
                    if d := kinds[j].get(ctx, 0):
                        leave[i, j] = -np.log2(d / (totals[j][ctx] + d))
            self._cost[k] = {s: costs[i] for i, s in enumerate(keys)}
            self._leave = getattr(self, "_leave", []) + [{c: leave[i] for i, c in enumerate(contexts)}]
            number = lambda xs: np.array([int.from_bytes(x, "big") for x in xs], np.uint32)
            self.tables.append((number(keys), costs.astype(np.float32)))
            self.leave.append((number(contexts), leave.astype(np.float32)))
        self._index()
        del self._cost, self._leave

    def _one(self, s: bytes, k: int, j: int) -> float:
        if k < 0:
            return 8.0
        if (row := self._cost[k].get(s)) is not None:
            return float(row[j])
        row = self._leave[k].get(s[:-1])
        return (float(row[j]) if row is not None else 0.0) + self._one(s[1:], k - 1, j)

    def _index(self) -> None:
        """Open addressing for the longest strings: most bytes are found there, at one or two probes each."""
        keys = self.tables[self.order][0]
        self.bits = max(12, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys))
        at = self._slot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of those that want one slot the last gets it
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the longest strings; -1: not in the table."""
        own = self.tables[self.order][0]
        at = self._slot(keys)
        row = self.slots[at]
        out = np.where((row >= 0) & (own[row] == keys), row, -1) if len(own) else np.full(len(keys), -1)
        more = np.flatnonzero((row >= 0) & (out < 0))
        at = at[more]
        while len(more):
            at = (at + 1) & ((1 << self.bits) - 1)
            row = self.slots[at]
            hit = (row >= 0) & (own[row] == keys[more])
            out[more[hit]] = row[hit]
            go = (row >= 0) & ~hit
            more, at = more[go], at[go]
        return out

    def costs(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of each string of k + 1 bytes, for each language."""
        if k < 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        own, table = self.tables[k]
        if k == self.order:
            row = self.find(keys)
        elif len(own):
            row = np.searchsorted(own, keys).clip(0, len(own) - 1)
            row = np.where(own[row] == keys, row, -1)
        else:
            row = np.full(len(keys), -1)
        out = table[row] if len(own) else np.zeros((len(keys), len(self.langs)), np.float32)
        missing = np.flatnonzero(row < 0)
        if len(missing):
            rest = keys[missing]
            contexts, leave = self.leave[k]
            shorter = self.costs(rest & np.uint32((1 << 8 * k) - 1), k - 1)
            if len(contexts):
                ctx = rest >> np.uint32(8)
                r = np.searchsorted(contexts, ctx).clip(0, len(contexts) - 1)
                shorter = shorter + np.where((contexts[r] == ctx)[:, None], leave[r], 0)
            out[missing] = shorter
        return out

    def bits_of(self, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
        """Code length of each text under each language, whole texts, a block of bytes at a time."""
        total = np.zeros((len(texts), len(self.langs)))
        joined = np.frombuffer(b"".join(PAD[: self.order] + x for x in texts), np.uint8)
        ends = np.cumsum([len(x) + self.order for x in texts], dtype=np.int64)
        begins = np.concatenate(([0], ends[:-1])) + self.order
        for s in range(0, len(joined), block):
            lo = max(0, s - self.order)
            part = joined[lo : s + block].astype(np.uint32)
            keys = np.zeros(len(part), np.uint32)
            for k in range(self.order + 1):
                keys[k:] |= part[: len(part) - k] << np.uint32(8 * k)
            costs = self.costs(keys[s - lo :], self.order)
            e = s + len(costs)
            first, last = np.searchsorted(ends, s, "right"), np.searchsorted(begins, e, "left")
            at, to = np.clip(begins[first:last], s, e) - s, np.clip(ends[first:last], s, e) - s
            edges = np.column_stack((at, to)).ravel()
            if len(edges) and (some := to > at).any():
                padded = np.concatenate((costs, np.zeros((1, costs.shape[1]), np.float32)))
                total[np.arange(first, last)[some]] += np.add.reduceat(padded, np.column_stack((at[some], to[some])).ravel(), axis=0, dtype=np.float64)[::2]
        return total


def _letters(text: bytes) -> bool:
    return text.upper() != text.lower() or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def sample(labelled: DataFrame, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """labelled (doc_id, text, lang) -> (lang, text) of `texts` rows of each language at most, those that hash lowest.

    Tasks keep no more than `texts` rows of a language before any row is shuffled. Null languages and texts count for none.
    """
    known = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("r"))
    first = known.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("r", "text"))).where(F.col("k") <= texts)
    return first.select("lang", F.col("text").cast("binary").alias("text"))


def learn(labelled: DataFrame, order: int = ORDER, texts: int = SAMPLE_TEXTS) -> Model:
    """labelled (doc_id, text, lang) -> the frozen model.

    Of each language (null counts for none) `texts` whole texts are read. Tasks count their strings of up to order + 1
    bytes; the driver gets the counts, of which there are no more than distinct strings, not the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for k, found in enumerate(_count([text.as_py()], order)):
                    keys = list(found)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([k] * len(keys), pa.int32()), pa.array(keys, pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "k", "s", "n"])

    parts = sample(labelled, texts).repartition(shuffle_partitions(labelled.sparkSession)).mapInArrow(run, "lang string, k int, s binary, n long")
    counts: dict[str, list[Counter]] = {}
    for r in parts.groupBy("lang", "k", "s").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["lang"], [Counter() for _ in range(order + 1)])[r["k"]][bytes(r["s"])] = r["n"]
    langs = sorted(counts)
    return Model(langs, [counts[x] for x in langs], order)


def _told(model: Model, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, score, bits a byte) of each text."""
    names, n = np.array([*model.langs, "und"], object), len(texts)
    texts = [x or b"" for x in texts]
    able = np.fromiter(map(_letters, texts), bool, n) if model.langs else np.zeros(n, bool)
    pick, score, rate = np.full(n, len(model.langs)), np.zeros(n), np.zeros(n)
    if able.any():
        at = np.flatnonzero(able)
        bits = model.bits_of([texts[i] for i in at])
        sizes = np.array([len(texts[i]) for i in at])
        pick[at] = bits.argmin(1)
        rate[at] = bits.min(1) / sizes
        gap = (bits - bits.min(1, keepdims=True)) / sizes[:, None] * np.minimum(sizes, 64)[:, None]
        score[at] = 1 / (2.0**-gap).sum(1)
    return names[pick], score, rate


def _everywhere(docs: DataFrame, model: Model):
    """() -> the model, on executors: the arrays are broadcast; the class travels with the function."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def get() -> Model:
        model = Model.__new__(Model)
        vars(model).update(shared.value)
        return model

    return get


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, lang_pred, score, bits_per_byte), a row for each row.

    lang_pred is the language with the shortest code for the whole text (ties: the first by name), `und` if the text is
    null or has no letter, or nothing was learnt. score: the winner's share of 2^-(bits over the text's bytes, times up
    to 64 bytes), 0 for `und`. Other columns are not read.
    """
    get = _everywhere(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        for b in batches:
            name, score, rate = _told(model, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_told(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs (text, lang, ...) that are in a language by a score of `least` or more, lang now the one told.

    `und` never is. All columns stay; rows are judged one by one, nulls and repeated ids in doc_id regardless.
    """
    get = _everywhere(docs, model)
    at_text, at_lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        for b in batches:
            name, score, _ = _told(model, b.column(at_text).cast(pa.binary()).to_pylist())
            keep = (name != "und") & (score >= least)
            columns = list(b.columns)
            columns[at_lang] = pa.array(name, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array(keep.astype(bool)))

    return docs.mapInArrow(run, docs.schema)
