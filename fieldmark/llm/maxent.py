"""LM scoring (operator 1): a hashed maximum-entropy model, a softmax over classes of words and one over the words of a class."""

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import BLANKS, cut, drop, tidy

#: Words that are a leaf of their own and whose counts every task holds (about 25 MB); all others share leaves.
HEAD = 200_000
CLASSES = 8
#: Leaves of a class that its other words share.
SHARED = 512
#: Rows of weights that features of a class are hashed to, a power of two.
ROWS = 1 << 16
FEATURES = 3
#: Tokens that are looked at together; bytes of texts that are split together; tokens whose pairs, and whose words, a task counts before it hands them on.
BATCH, CHUNK, FLUSH, COUNTED = 16_384, 1 << 22, 1 << 21, 1 << 22
#: Training tokens for each shard of the words' weights.
SHARD = 3_000_000
#: Precisions of the weights' Gaussian priors; steps of their training.
PRIOR_CLASS, PRIOR_WORD, STEPS = 8.0, 0.1, 8
#: The share of its count that a class's weight starts from: its features overlap.
START = 0.4
END = b""
NONE = np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = 16


LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
IN_WORD = ~np.isin(np.arange(256), list(BLANKS.encode()))


def _bytes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value starts in them, and their end) of an array of binary values."""
    edges = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset) if len(x) else np.zeros(1, np.int32)
    data = x.buffers()[2] if edges[-1] > edges[0] else None
    return np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all texts, where each text starts in them): words, A-Z lowered, and after each text its end, the empty word."""
    raw, edges = _bytes(pc.fill_null(texts.cast(pa.binary()), b""))
    kept = IN_WORD[raw]
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    fresh = edges[:-1][edges[:-1] < len(raw)]
    first[fresh] = kept[fresh]
    at = np.flatnonzero(first)
    begin = np.append(np.cumsum(kept, dtype=np.int32)[at] - 1, np.count_nonzero(kept)).astype(np.int32)
    upto = np.searchsorted(at, edges)
    offsets = np.insert(begin, upto[1:], begin[upto[1:]])
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[raw[kept]])])
    return words, upto[:-1] + np.arange(len(texts))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Array, np.ndarray]]:
    """(rows, their tokens, where texts start) of whole texts, the last column, that have CHUNK bytes together or a text more."""
    held, size = [], 0
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        a = done = 0
        while a < b.num_rows:
            z = min(int(np.searchsorted(sizes, done + CHUNK - size)) + 1, b.num_rows)
            held.append(b.slice(a, z - a))
            size += int(sizes[z - 1]) - done
            a, done = z, int(sizes[z - 1])
            if size >= CHUNK:
                rows = pa.Table.from_batches(held)
                yield rows, *split(rows.column(rows.num_columns - 1).combine_chunks())
                held, size = [], 0
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, *split(rows.column(rows.num_columns - 1).combine_chunks())


def count(docs: DataFrame) -> DataFrame:
    """docs (text) -> (word, n) over all tokens; tasks sum before they shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def summed() -> pa.RecordBatch:
            x = pa.chunked_array(held).value_counts()
            held.clear()
            return pa.RecordBatch.from_arrays([x.field("values"), x.field("counts")], ["word", "n"])

        for _, words, _ in _texts(batches):
            held.append(words)
            if sum(map(len, held)) >= COUNTED:
                yield summed()
        if held:
            yield summed()

    parts = docs.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _least(counts: DataFrame, size: int) -> int:
    """The smallest count that no more than `size` words have or exceed. How many words have a count is tallied in bands
    of counts (all up to 64, then 64 to an octave), of which there are a few thousand however large the corpus."""
    octave = F.floor(F.log2(F.col("n").cast("double")))
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), octave - 6))
    bands = counts.groupBy((F.ceil(F.col("n") / step) * step).cast("long").alias("n")).agg(F.count("*").alias("words"), F.max("n").alias("most")).collect()
    total, least = 0, None
    for r in sorted(bands, key=lambda r: -r["n"]):
        total += r["words"]
        if total > size:
            break
        least = r["n"]
    above = [r["most"] for r in bands if least is None or r["n"] < least]
    return (max(above) + 1 if above else 1) if bands else 1


def _ending(word: bytes) -> int:
    return int.from_bytes(word[-2:], "big")


class Leaves:
    """Where a word is in the tree: its class, and its leaf there.

    A word's class is that of its last two bytes: the commonest endings are dealt to the classes, largest first, to that
    which has the fewest tokens; others go by hash. A class's leaves are numbered in a row: SHARED for words that are not
    of the head, by hash, then one for each of its words of the head.
    """

    def __init__(self, head: dict[bytes, int]):
        sums: Counter = Counter()
        for w, n in head.items():
            sums[_ending(w)] += n
        self.table = ((np.arange(1 << 16) * 40503 >> 7) % CLASSES).astype(np.int64)
        held = [0] * CLASSES
        for ending, n in sorted(sums.items(), key=lambda x: (-x[1], x[0])):
            k = held.index(min(held))
            self.table[ending] = k
            held[k] += n
        by_class: list[list[bytes]] = [[] for _ in range(CLASSES)]
        for w in sorted(head):
            by_class[self.table[_ending(w)]].append(w)
        self.first = np.cumsum([0, *[SHARED + len(x) for x in by_class]])
        self.own = {w: int(self.first[k]) + SHARED + j for k, x in enumerate(by_class) for j, w in enumerate(x)}
        self.size = int(self.first[-1])
        self.words = pa.array(list(self.own), pa.binary())
        self.codes = np.fromiter((zlib.crc32(w) | leaf << 32 for w, leaf in self.own.items()), np.uint64, len(self.own))

    def class_of(self, leaves: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, leaves, "right") - 1

    def is_shared(self, leaves: np.ndarray) -> np.ndarray:
        return leaves - self.first[self.class_of(leaves)] < SHARED


class Codes:
    """crc32 + leaf * 2^32 of words: those of the head are known, others are computed once in each array of words."""

    def __init__(self, leaves: Leaves):
        self.words, self.codes, self.table, self.first = leaves.words, leaves.codes, leaves.table, leaves.first

    def of_rest(self, words: pa.Array) -> np.ndarray:
        """Codes of words that are not of the head."""
        data, edges = _bytes(words)
        n = np.diff(edges)
        ending = np.zeros(len(n), np.int64)
        ending[n > 0] = data[edges[1:][n > 0] - 1]
        ending[n > 1] += data[edges[1:][n > 1] - 2].astype(np.int64) << 8
        whole, at = data.tobytes(), edges.tolist()
        crc = np.fromiter((zlib.crc32(whole[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)), np.uint64, len(n))
        leaf = self.first[self.table[ending]].astype(np.uint64) + (crc * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(SHARED)
        return crc | leaf << np.uint64(32)

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(crc32, leaf, number among the words not of the head: below 0 for one of it) of each word, and the words not of the head."""
        found, known = pa.concat_arrays([self.words, words]).dictionary_encode(), len(self.words)  # the head first: its words keep their numbers
        rest, place = found.dictionary.slice(known), found.indices.to_numpy()[known:]
        code = np.concatenate((self.codes, self.of_rest(rest)))[place]
        return code & np.uint64(0xFFFFFFFF), (code >> np.uint64(32)).astype(np.int64), place - known, rest

    def of(self, words: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(crc32, leaf) of each word."""
        return self.look(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()))[:2]


def _back(ids: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The k-th token before each; a mark that is no word's where the text does not go back so far."""
    n, x = len(ids), np.empty(len(ids), np.uint64)
    x[k:] = ids[: n - k] if n > k else ids[:0]
    x[:k] = NONE
    ends = np.append(starts[1:], n)
    for j in range(k):
        at = starts + j
        x[at[at < ends]] = NONE
    return x


def _features(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of weights for each token: the word before, the two before, and a skip to the second before. starts: where texts start."""
    one, two = (_back(ids, starts, k) for k in (1, 2))
    mixed = (one, one * np.uint64(0x9E3779B1) + two, two + np.uint64(0x5BD1E995))
    out = np.empty((FEATURES, len(ids)), np.intp)
    for k, x in enumerate(mixed):
        out[k] = (((x + np.uint64(k)) * MIX) >> np.uint64(40)) & np.uint64(ROWS - 1)
    return out


def _class_logs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logarithms of the classes' probabilities for each token; kept where exp holds in single precision."""
    z = weights.take(rows[0], axis=0)
    for k in range(1, FEATURES):
        z += weights.take(rows[k], axis=0)
    z += bias
    np.clip(z, -60, 60, out=z)
    z -= np.log(np.exp(z) @ np.ones(CLASSES, np.float32))[:, None]
    return z


def _keys(ids: np.ndarray, leaf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What a word's own weight is kept under: the word before, hashed to 32 bits, and the leaf."""
    return _back(ids, starts, 1) << np.uint64(32) | leaf.astype(np.uint64)


def _shard(keys: np.ndarray, classes: np.ndarray, shards: int) -> np.ndarray:
    """Contexts are dealt out by class: what one softmax needs is together, and a common context is not in one place."""
    mixed = ((keys >> np.uint64(32)) * np.uint64(CLASSES) + classes.astype(np.uint64) + np.uint64(1)) * MIX
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)


def _split(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    dealt = shard[order]
    edges = np.flatnonzero(np.concatenate(([True], dealt[1:] != dealt[:-1], [True]))) if len(dealt) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(dealt[a]), order[a:b]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers up to 32 bits, compressed, with their width and number before them."""
    x = x.astype("<u2" if len(x) and x.max() < 1 << 16 else "<u4")
    return bytes([x.itemsize]) + len(x).to_bytes(4, "little") + pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    size, n = blob[0], int.from_bytes(blob[1:5], "little")
    raw = pa.decompress(blob[5:], decompressed_size=size * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(f"<u{size}").ravel()


def _packed_keys(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as steps from context to context, and leaves."""
    context = (keys >> np.uint64(32)).astype(np.uint32)
    return _packed(np.diff(context, prepend=np.uint32(0))), _packed((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32))


def _unpacked_keys(steps: bytes, leaf: bytes) -> np.ndarray:
    context = np.cumsum(_unpacked(steps).astype(np.uint32), dtype=np.uint32)
    return context.astype(np.uint64) << np.uint64(32) | _unpacked(leaf).astype(np.uint64)


def _heads(keys: np.ndarray, leaves: Leaves) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys, which softmax each is in, as context and first leaf; and where in the keys each softmax starts."""
    kind = leaves.class_of((keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
    heads = (keys >> np.uint64(32) << np.uint64(32)) | leaves.first[kind].astype(np.uint64)
    return heads, np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1]))) if len(keys) else np.zeros(0, np.int64)


def fit_words(keys: np.ndarray, n: np.ndarray, share: np.ndarray, leaves: Leaves) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys sorted, counts) of whole softmaxes -> (weights of the keys, keys of the softmaxes: context and first leaf, log of their sums).

    A leaf's probability in its class after a context is share * exp(weight) / sum; leaves not seen there have weight 0. Each
    step moves all weights along the gradient of the log-likelihood less the prior's, scaled by its diagonal curvature.
    """
    leaf = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    heads, at = _heads(keys, leaves)
    if not len(keys):
        return np.zeros(0), heads, np.zeros(0)
    sizes = np.diff(np.append(at, len(keys)))
    q, n = share[leaf], n.astype(np.float64)
    total = np.repeat(np.add.reduceat(n, at), sizes)
    theta = np.log(np.maximum(0.5 * n / (total + 1) / q, 0.5))
    norm = None
    for step in range(STEPS + 1):
        e = q * np.exp(theta)
        norm = 1 + np.add.reduceat(e - q, at)
        if step == STEPS:
            break
        p = e / np.repeat(norm, sizes)
        theta += np.clip((n - total * p - PRIOR_WORD * theta) / (total * p * (1 - p) + PRIOR_WORD), -1, 1)
        np.clip(theta, -20, 40, out=theta)
    return theta, heads[at], np.log(np.maximum(norm, 1e-300))


def answer(keys: np.ndarray, theta: np.ndarray, heads: np.ndarray, logs: np.ndarray, asked: np.ndarray, leaves: Leaves) -> np.ndarray:
    """weight - log of the sum, for each key asked; what was never seen has weight 0 and sum 1."""
    out = np.zeros(len(asked))
    want = _heads(asked, leaves)[0]
    for own, values, wanted, sign in ((keys, theta, asked, 1.0), (heads, logs, want, -1.0)):
        if len(own):
            at = np.searchsorted(own, wanted).clip(0, len(own) - 1)
            out += np.where(own[at] == wanted, sign * values[at], 0.0)
    return out


def _blocks(kind: int, at: list[int], *blobs: list[bytes]) -> pa.RecordBatch:
    n = len(at)
    columns = [pa.array(x, pa.binary()) for x in blobs] + [pa.nulls(n, pa.binary())] * (6 - len(blobs))
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(at, pa.int32()), *columns], ["kind", "at", "a", "b", "c", "ids", "classes", "sizes"])


#: What tasks of the training send: 0 sums, 1 counts of pairs for a shard, 2 texts of a round as numbers (in columns of their own, so that others are read without them).
PARTS = "kind int, at int, a binary, b binary, c binary, ids binary, classes binary, sizes binary"


def _added(parts: DataFrame, rows: int) -> np.ndarray:
    """The sum of arrays (rows x CLASSES, single precision, in BLOCKS parts) that tasks sent: over groups of tasks, then over those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(x.as_py(), np.float32)
                if at in sums:
                    sums[at] += x
                else:
                    sums[at] = x.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["at", "a"])

    one = parts.select("at", "a", (F.spark_partition_id() % 64).alias("task")).repartition("at", "task").select("at", "a").mapInArrow(run, "at int, a binary")
    out = np.zeros((BLOCKS, rows // BLOCKS * CLASSES))
    with tidy(parts.sparkSession):
        for r in one.repartition("at").mapInArrow(run, "at int, a binary").collect():
            out[r["at"]] += np.frombuffer(r["a"], np.float32)
    return out.reshape(rows, CLASSES)


class Model:
    """What scoring needs but the words' weights, which are a table."""

    def __init__(self, leaves: Leaves, head: dict[bytes, int], n: np.ndarray, v: np.ndarray):
        """n, v: training tokens and distinct words of each leaf; words of the head are their leaf's only ones, and logs has their counts."""
        self.leaves, self.logs = leaves, np.full(leaves.size, np.nan)
        self.logs[[leaves.own[w] for w in head]] = np.log10(np.fromiter(head.values(), np.float64, len(head)) + 1)
        weight = n + 1
        total = np.add.reduceat(weight, leaves.first[:-1])
        self.kinds = leaves.class_of(np.arange(leaves.size))
        self.share = weight / total[self.kinds]
        shared = leaves.is_shared(np.arange(leaves.size))
        # log10 of what a word's count + 1 is divided by: a shared leaf also keeps a place for words never seen
        self.within = np.where(shared, np.log10(n + v + 1), np.log10(n + 1))
        self.of_class = np.add.reduceat(n, leaves.first[:-1])
        p = (self.of_class + 1) / (self.of_class + 1).sum()
        self.bias, self.weights = np.log(p).astype(np.float32), np.zeros((ROWS, CLASSES), np.float32)

    def start(self, counts: np.ndarray) -> None:
        """counts (ROWS x CLASSES) -> weights: how much more often the class follows the feature than it does at all."""
        self.seen = counts.sum(1, keepdims=True)
        p = np.exp(self.bias.astype(np.float64))
        self.weights = (START * np.log((counts + PRIOR_CLASS * p) / (self.seen + PRIOR_CLASS) / p)).astype(np.float32)

    def move(self, gradient: np.ndarray, part: float) -> None:
        """A step along the gradient over a part of all tokens, scaled by the diagonal curvature; features share the way."""
        p = np.exp(self.bias.astype(np.float64))
        p /= p.sum()
        self.weights -= ((gradient + part * PRIOR_CLASS * p * self.weights / FEATURES) / (part * (self.seen + PRIOR_CLASS) * p * FEATURES)).astype(np.float32)
        total = gradient.sum(0) / FEATURES  # every token has FEATURES rows
        self.bias -= (total / np.maximum(part * self.of_class, 1)).astype(np.float32)

    def gradient(self, ids: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
        rows, out = _features(ids, starts), np.zeros((CLASSES, ROWS))
        for s in range(0, len(ids), 8 * BATCH):
            r, t = rows[:, s : s + 8 * BATCH], kind[s : s + 8 * BATCH]
            p = np.exp(_class_logs(self.weights, self.bias, r))
            p[np.arange(len(t)), t] -= 1
            by_class, at = np.ascontiguousarray(p.T, np.float64), r.ravel()
            for k in range(CLASSES):
                out[k] += np.bincount(at, np.tile(by_class[k], FEATURES), ROWS)
        return out.T

    def class_scores(self, ids: np.ndarray, leaf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log of P(class) * share, for each token."""
        rows, out, kind = _features(ids, starts), np.log(self.share[leaf]), self.kinds[leaf]
        for s in range(0, len(ids), BATCH):
            z, t = _class_logs(self.weights, self.bias, rows[:, s : s + BATCH]), kind[s : s + BATCH]
            out[s : s + BATCH] += z[np.arange(len(t)), t]
        return out


def _sent(spark, leaves: Leaves, model: Model | None = None):
    """() -> (leaves, model) on executors: their contents are broadcast, the classes travel with the function."""
    rest = {k: x for k, x in vars(model).items() if k != "leaves"} if model else None
    shared = spark.sparkContext.broadcast(({k: x for k, x in vars(leaves).items() if k != "own"}, rest))

    def get() -> tuple[Leaves, Model | None]:
        own, rest = shared.value
        leaves, model = Leaves.__new__(Leaves), None
        vars(leaves).update(own)
        if rest is not None:
            model = Model.__new__(Model)
            vars(model).update(rest, leaves=leaves)
        return leaves, model

    return get


def train(docs: DataFrame, model: Model, shards: int, rounds: int = 2) -> DataFrame:
    """docs (doc_id, text) -> the words' weights as a table (shard, contexts, leaves, theta, logs of the softmaxes' sums); the model's other weights are set.

    One pass counts, for each task, how often classes follow features and leaves follow words. From the first the classes'
    weights start; in each round tasks sum their gradient over a part of the texts (by a hash of the id and text, each text in
    one round), the sums are added up in two levels, and all weights move one step: the result does not depend on how texts are
    dealt to tasks. The rounds read texts as the first pass has numbered them: five bytes a token.
    The second counts, shuffled by shard, are what the words' weights are trained from, shard by shard: there are as many
    of those as different pairs of words, however large the corpus.
    """
    spark = docs.sparkSession
    shared = _sent(spark, model.leaves, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, model = shared()
        codes, sums = Codes(leaves), np.zeros(ROWS * CLASSES)
        held: list[np.ndarray] = []

        def pairs() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            dealt = list(_split(_shard(keys, leaves.class_of((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), shards)))
            packed = [_packed_keys(keys[i]) for _, i in dealt]
            return _blocks(1, [s for s, _ in dealt], [x for x, _ in packed], [x for _, x in packed], [_packed(n[i]) for _, i in dealt])

        for texts, words, starts in _texts(batches):
            ids, leaf = codes.of(words)
            rows, kind = _features(ids, starts), model.kinds[leaf]
            for k in range(FEATURES):
                sums += np.bincount(rows[k] * CLASSES + kind, minlength=ROWS * CLASSES)
            dealt, sizes = texts.column(0).to_numpy(), np.diff(np.append(starts, len(ids)))
            for r in np.unique(dealt).tolist():
                mine = np.repeat(dealt == r, sizes)
                numbers = (ids[mine].astype("<u4"), kind[mine].astype(np.uint8), sizes[dealt == r].astype("<u4"))
                yield _blocks(2, [r], *[[None]] * 3, *[[x.tobytes()] for x in numbers])
            held.append(_keys(ids, leaf, starts))
            if sum(map(len, held)) >= FLUSH:
                yield pairs()
        if held:
            yield pairs()
        if sums.any():
            yield _blocks(0, list(range(BLOCKS)), [x.astype(np.float32).tobytes() for x in np.split(sums, BLOCKS)])

    dealt = F.pmod(F.xxhash64("doc_id", "text", F.lit("round")), F.lit(rounds)).cast("int")
    parts = cut(docs.select(dealt.alias("round"), F.col("text").cast("binary")).mapInArrow(run, PARTS))
    model.start(_added(parts.where("kind = 0"), ROWS))
    for r in range(rounds):
        given = _sent(spark, model.leaves, model)

        def learn(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            model, sums = given()[1], None
            for b in batches:
                for ids, kind, sizes in zip(*b.columns, strict=True):
                    ids, kind, sizes = (np.frombuffer(x.as_py(), t) for x, t in ((ids, "<u4"), (kind, np.uint8), (sizes, "<u4")))
                    g = model.gradient(ids.astype(np.uint64), kind, np.cumsum(sizes, dtype=np.int64) - sizes)
                    sums = g if sums is None else sums + g
            if sums is not None:
                yield _blocks(0, list(range(BLOCKS)), [np.ascontiguousarray(x, np.float32).tobytes() for x in np.split(sums, BLOCKS)])

        part = parts.where((F.col("kind") == 2) & (F.col("at") == r)).select("ids", "classes", "sizes")
        model.move(_added(part.mapInArrow(learn, PARTS), ROWS), 1 / rounds)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (leaves, model), by_shard = shared(), {}
        for b in batches:
            for at, x, y, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by_shard.setdefault(at, []).append((_unpacked_keys(x, y), _unpacked(n)))
        for at in sorted(by_shard):
            keys, n = (np.concatenate(x) for x in zip(*by_shard.pop(at), strict=True))
            order = np.argsort(keys)
            keys, n = keys[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, n = keys[first], np.add.reduceat(n, first)
            theta, _, logs = fit_words(keys, n, model.share, leaves)
            values = [*_packed_keys(keys), theta.astype(np.float32).tobytes(), logs.astype(np.float32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *[pa.array([x], pa.binary()) for x in values]], ["shard", "contexts", "leaves", "theta", "logs"])

    pairs = parts.where("kind = 1").select("at", "a", "b", "c").repartition(shards, "at")
    table = cut(pairs.mapInArrow(fit, "shard int, contexts binary, leaves binary, theta binary, logs binary"))
    drop(parts)
    return table


SCORED = {
    "chunk": pa.int64(), "kind": pa.int32(), "shard": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary(),
    "row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(), "common": pa.float64(), "context": pa.float64(), "rare": pa.list_(pa.binary()), "times": pa.list_(pa.int32()),
}
SCHEMA = "chunk long, kind int, shard int, a binary, b binary, c binary, d binary, row long, doc_id long, n_tokens long, known long, common double, context double, rare array<binary>, times array<int>"
#: Kinds of rows, in the order in which a task has to see them: weights, keys asked or sums of their answers, texts.
WEIGHTS, ASKED, TEXT = 0, 1, 2


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in SCORED.items()], list(SCORED))


def score(docs: DataFrame, training: DataFrame, head_size: int = HEAD, rounds: int = 2, shard: int = SHARD) -> DataFrame:
    """docs (doc_id, text, ...), training (doc_id, text) -> (doc_id, n_tokens, n_known, train_tokens, base_score, score).

    A token has the probability P(class | words before) * P(leaf | class, word before) * P(word | leaf): a softmax over
    classes of hashed n-gram and skip features, one over the class's leaves with a weight for each pair of words seen, and the word's
    share of its leaf, which is 1 for words of the head; words never seen take a share of their leaf. base_score: the sum of
    log10((c + 1) / (N + V + 1)). Null texts are empty and score their end; a text is read whole, however long. Rows of docs,
    repeated and null ids too, each give a row; rows of training count each, whatever their ids. Other columns are not read. Nothing to
    learn from: every word is unseen. An empty table gives an empty one.

    Texts ask for the weights of their pairs of words shard by shard: keys are shuffled to the shards, and each chunk of texts
    gets one sum a text back from each. Counts of words outside the head are joined by word.
    """
    spark = docs.sparkSession
    counts = cut(count(training))
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = whole["n"] or 0, whole["v"]
    head = {bytes(r["word"]): r["n"] for r in counts.where(F.col("n") >= _least(counts, head_size)).collect()}
    leaves = Leaves(head)
    shared = _sent(spark, leaves)

    def by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = shared()[0]
        n, v, codes = np.zeros(leaves.size), np.zeros(leaves.size), Codes(leaves)
        for b in batches:
            leaf = codes.of(b.column(0))[1]
            n += np.bincount(leaf, b.column(1).to_numpy(), len(n))
            v += np.bincount(leaf, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(v[at])], ["leaf", "n", "v"])

    rare_counts = counts.where(F.col("n") < (min(head.values()) if head else 1 << 62))
    n, v = np.zeros(leaves.size), np.zeros(leaves.size)
    for r in rare_counts.mapInArrow(by_leaf, "leaf int, n double, v double").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["leaf"]], v[r["leaf"]] = r["n"], r["v"]
    for w, c in head.items():
        n[leaves.own[w]], v[leaves.own[w]] = c, 1
    model = Model(leaves, head, n, v)
    shards = max(1, -(-n_all // shard))
    weights = train(training, model, shards, rounds)
    given = _sent(spark, leaves, model)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given()[1]
        codes, chunk = Codes(model.leaves), TaskContext.get().partitionId() << 32
        for texts, words, starts in _texts(batches):
            ids, leaf, place, rest = codes.look(words)
            found = model.class_scores(ids, leaf, starts) / math.log(10) - model.within[leaf]
            rare = place >= 0
            common = np.where(rare, 0.0, model.logs[leaf])
            sums = [np.add.reduceat(x, starts) for x in (common, found)]
            known = np.add.reduceat((~rare).astype(np.int64), starts)
            m, sizes = len(starts), np.diff(np.append(starts, len(words)))
            of_doc = np.repeat(np.arange(m), sizes)
            counted, times = np.unique(of_doc[rare] * max(len(rest), 1) + place[rare], return_counts=True)
            edges = pa.array(np.searchsorted(counted, np.arange(m + 1) * max(len(rest), 1)), pa.int32())
            yield _rows({
                "chunk": [chunk] * m, "kind": [TEXT] * m, "shard": [chunk % shards] * m, "row": np.arange(m), "doc_id": texts.column(0).combine_chunks(), "n_tokens": sizes, "known": known,
                "common": sums[0], "context": sums[1], "rare": pa.ListArray.from_arrays(edges, rest.take(pa.array(counted % max(len(rest), 1)))), "times": pa.ListArray.from_arrays(edges, pa.array(times, pa.int32())),
            })
            keys = _keys(ids, leaf, starts)
            order = np.argsort(keys)
            keys, of_doc = keys[order], of_doc[order]
            out: dict[str, list] = {c: [] for c in ("chunk", "kind", "shard", "a", "b", "c", "d")}
            for s, i in _split(_shard(keys, model.kinds[leaf[order]], shards)):
                own, new = keys[i], np.concatenate(([True], keys[i][1:] != keys[i][:-1]))
                for c, x in zip(out, (chunk, ASKED, s, *_packed_keys(own[new]), _packed(new.astype(np.uint32)), _packed(of_doc[i])), strict=True):
                    out[c].append(x)
            yield _rows(out)
            chunk += 1

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, at, own = shared()[0], None, None
        for b in batches:
            kind = b.column(1).to_numpy()
            out: dict[str, list] = {"chunk": [], "kind": [], "a": [], "b": []}
            for i in np.flatnonzero(kind != TEXT).tolist():
                s = b.column(2)[i].as_py()
                blobs = [b.column(k)[i].as_py() for k in (3, 4, 5, 6)]
                if kind[i] == WEIGHTS:
                    keys = _unpacked_keys(*blobs[:2])
                    heads, first = _heads(keys, leaves)
                    at, own = s, (keys, np.frombuffer(blobs[2], np.float32), heads[first], np.frombuffer(blobs[3], np.float32))
                elif s == at:
                    of_doc = _unpacked(blobs[3])
                    value = answer(*own, _unpacked_keys(*blobs[:2]), leaves)[np.cumsum(_unpacked(blobs[2]), dtype=np.int64) - 1]
                    sums = np.bincount(of_doc, value)
                    some = np.unique(of_doc)
                    for c, x in zip(out, (b.column(0)[i].as_py(), ASKED, _packed(some), sums[some].astype(np.float32).tobytes()), strict=True):
                        out[c].append(x)
            if out["chunk"]:
                yield _rows(out)
            if (kind == TEXT).any():
                yield b.filter(pa.array(kind == TEXT))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros(0)
        for b in batches:
            chunk, kind, row = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(7).to_numpy(zero_copy_only=False)
            more = np.zeros(b.num_rows)
            for i in range(b.num_rows):
                if chunk[i] != at:
                    at, sums = chunk[i], np.zeros(0)
                if kind[i] == ASKED:
                    docs, x = _unpacked(b.column(3)[i].as_py()), np.frombuffer(b.column(4)[i].as_py(), np.float32)
                    if len(docs) and docs[-1] >= len(sums):
                        sums = np.append(sums, np.zeros(int(docs[-1]) + 1 - len(sums)))
                    sums[docs] += x
                elif (r := int(row[i])) < len(sums):
                    more[i] = sums[r]
            stay = pa.array(kind == TEXT)
            out = pa.RecordBatch.from_arrays([b.column(0), *b.columns[7:12], pa.array(b.column(12).to_numpy(zero_copy_only=False) + more / math.log(10)), *b.columns[13:]], ["chunk", *list(SCORED)[7:]])
            yield out.filter(stay)

    known_weights = weights.select(
        F.lit(None).cast("long").alias("chunk"), F.lit(WEIGHTS).alias("kind"), "shard", F.col("contexts").alias("a"), F.col("leaves").alias("b"), F.col("theta").alias("c"), F.col("logs").alias("d"),
        *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in SCHEMA.split(", ")[7:])],
    )
    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(ask, SCHEMA)
    met = asked.unionByName(known_weights).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    replied = met.mapInArrow(reply, SCHEMA).repartition("chunk").sortWithinPartitions("chunk", "kind")
    scored = cut(replied.mapInArrow(add, "chunk long, " + SCHEMA[SCHEMA.index("row ") :]))
    drop(weights)
    rare = scored.select("chunk", "row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("chunk", "row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    sums = rare.join(counts, "word").groupBy("chunk", "row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"), F.sum("times").alias("found"))
    both = F.col("common") + F.coalesce("logs", F.lit(0.0))
    return scored.join(sums, ["chunk", "row"], "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (both - F.col("n_tokens") * math.log10(n_all + v_all + 1)).alias("base_score"),
        (both + F.col("context")).alias("score"),
    )
