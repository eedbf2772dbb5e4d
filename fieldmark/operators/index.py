"""Nearest neighbours by a tree of splits: for clustered points and many dimensions, exact or approximate."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.sources.shared import cut, forget

#: Rows that a tree is learnt from, at most; rows that a leaf should have, and at most leaves; rows of a block, which a task holds.
SAMPLE, PER_LEAF, LEAVES, BLOCK = 50_000, 2_000, 4_096, 8_192
#: Leaves that a query visits in the first round; each round after it up to so many times as many.
FIRST, MORE = 1, 4


@dataclass
class Tree:
    """Splits by hyperplanes: node n sends a row to 2n + 1 or 2n + 2 by direction[n] . v <= offset[n]; leaves have a negative number."""

    direction: np.ndarray
    offset: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, leaves: int) -> "Tree":
        """Each node splits its rows at the median along the direction in which they vary most."""
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        inner = 2**depth - 1
        direction, offset = np.zeros((max(inner, 1), sample.shape[1])), np.full(max(inner, 1), np.inf)
        held = {0: sample}
        for n in range(inner):
            x = held.pop(n)
            if len(x) > 1 and (spread := np.cov(x.T, bias=True).reshape(x.shape[1], -1)).any():
                direction[n] = np.linalg.eigh(spread)[1][:, -1]
                at = x @ direction[n]
                offset[n] = np.median(at)
                left = at <= offset[n]
            else:  # rows that are all alike are not split
                left = np.ones(len(x), bool)
            held[2 * n + 1], held[2 * n + 2] = x[left], x[~left]
        return Tree(direction, offset, np.arange(inner, inner + 2**depth))

    def leaves(self, v: np.ndarray) -> np.ndarray:
        n = np.zeros(len(v), np.int64)
        for _ in range(int(np.log2(len(self.leaf)))):
            n = np.where((v * self.direction[n]).sum(1) <= self.offset[n], 2 * n + 1, 2 * n + 2)
        return n - self.leaf[0]


@dataclass
class Index:
    """rows: (leaf, block, ids, points) in the shared folder; of each leaf that has rows its box, centre and radius, in tasks' hands."""

    tree: Tree
    blocks: DataFrame
    leaf: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    count: int
    dims: int
    parts: np.ndarray  # blocks of each leaf


def _vectors(df: DataFrame, coords: list[str] | str) -> DataFrame:
    """(id, v) of the rows whose coordinates are all finite."""
    v = F.col(coords).cast("array<double>") if isinstance(coords, str) else F.array(*[F.col(c).cast("double") for c in coords])
    named = df.select(F.col("id").cast("long"), v.alias("v"))
    return named.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def build(reference: DataFrame, coords: list[str] | str, k: int = 1, sample: int = SAMPLE, per_leaf: int = PER_LEAF, seed: int = 7) -> Index | None:
    """An index of all rows (id, coords) of the reference; None if it has none.

    The tree is learnt from a sample of bounded size (by a hash of the ids); every row is indexed. Rows at one place are at most k: of
    equal points those with the least ids, which are all that a search for k can return, so a hot point makes no hot leaf. Leaves
    are cut into blocks of BLOCK rows, each of which is one row of arrays.
    """
    rows = _vectors(reference, coords)
    place = Window.partitionBy("v", "_salt").orderBy("id")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k)
    rows = cut(salted.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k).select("id", "v"))
    n = rows.count()
    if not n:
        return None
    dims = len(rows.first()["v"])
    some = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_003)) < int(min(1.0, 1.5 * sample / n) * 1_000_003)).limit(sample).select("v").toPandas()["v"]
    points = np.array(some.tolist(), float).reshape(-1, dims)
    tree = Tree.fit(points, min(LEAVES, max(1, n // per_leaf), max(1, len(points) // 8)))
    shared = rows.sparkSession.sparkContext.broadcast(vars(tree))

    def place_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(**shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.leaves(_matrix(b.column(1), dims)))], ["id", "v", "leaf"])

    placed = cut(rows.mapInArrow(place_, "id long, v array<double>, leaf long"))
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row a leaf
    parts = placed.sparkSession.createDataFrame([(leaf, -(-m // BLOCK)) for leaf, m in sizes.items()], "leaf long, parts int")
    block = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = placed.join(F.broadcast(parts), "leaf").groupBy("leaf", block.alias("block")).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("points"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = b.column("points")[k].values.to_numpy().reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([b.column("leaf").slice(k, 1), pa.array([len(x)], pa.int64()), *[pa.array([y], pa.list_(pa.float64())) for y in (x.min(0), x.max(0), x.sum(0))]], ["leaf", "n", "lo", "hi", "total"])

    blocks = cut(dealt)
    found = blocks.select("leaf", "points").mapInArrow(ends, "leaf long, n long, lo array<double>, hi array<double>, total array<double>").toPandas()  # a row a block
    leaf = np.array(sorted(sizes))
    own = [found[found["leaf"] == x] for x in leaf]
    lo, hi = np.array([np.stack(f["lo"]).min(0) for f in own]), np.array([np.stack(f["hi"]).max(0) for f in own])
    centre = np.array([np.stack(f["total"]).sum(0) / f["n"].sum() for f in own])
    where = rows.sparkSession.sparkContext.broadcast({int(x): c for x, c in zip(leaf, centre, strict=True)})

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, p in zip(b.column("leaf").to_pylist(), b.column("points"), strict=True):
                far = np.sqrt(((p.values.to_numpy().reshape(-1, dims) - where.value[x]) ** 2).sum(1).max())
                yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([far])], ["leaf", "far"])

    far = {r["leaf"]: r["far"] for r in blocks.select("leaf", "points").mapInArrow(reach, "leaf long, far double").groupBy("leaf").agg(F.max("far").alias("far")).collect()}
    for done in (rows, placed):
        forget(done.cut_path)
    return Index(tree, blocks, leaf, lo, hi, centre, np.array([far[x] for x in leaf]), n, dims, np.array([-(-sizes[x] // BLOCK) for x in leaf]))


def _bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least squared distance that a leaf's rows can have, squared distance to its centre) of each query and leaf."""
    box, mid = np.zeros((len(q), len(lo))), np.zeros((len(q), len(lo)))
    for j in range(q.shape[1]):
        x = q[:, j, None]
        box += np.maximum(0.0, np.maximum(lo[:, j] - x, x - hi[:, j])) ** 2
        mid += (x - centre[:, j]) ** 2
    ball = np.maximum(0.0, np.sqrt(mid) - radius)
    # a bound is lowered by what rounding may have added
    return np.maximum(box, ball * ball) * (1 - 1e-9), mid


def search(query: DataFrame, index: Index | None, coords: list[str] | str, k: int = 1, probes: int | None = None) -> DataFrame:
    """query (id, coords) -> (id, neighbor, rank from 1, distance): the k nearest rows of the index, ties by the smaller id.

    Exact, unless `probes` says how many leaves to visit. A query visits leaves best first, by the least distance that their rows
    can have, FIRST of them and in each round MORE times as many, until no leaf left can hold a row nearer than its k-th (or as
    near). Queries and blocks of leaves meet by a shuffle; a task holds one block and some queries.
    """
    empty = "id long, neighbor long, rank int, distance double"
    queries = _vectors(query, coords)
    if index is None:
        return queries.sparkSession.createDataFrame([], empty)
    if k > 1 and index.count < k:
        k = index.count
    sc, dims = queries.sparkSession.sparkContext, index.dims
    told = sc.broadcast((index.leaf, index.lo, index.hi, index.centre, index.radius, index.parts))
    open_ = queries.select("id", "v", F.lit(0).alias("seen"), F.lit(float("inf")).alias("worst"))
    best, width = None, probes or FIRST

    def visits(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
        leaf, lo, hi, centre, radius, parts = told.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                q, seen, worst = _matrix(b.column("v"), dims), b.column("seen").to_numpy(), b.column("worst").to_numpy()
                bound, mid = _bounds(q, lo, hi, centre, radius)
                rows, leaves, blocks = [], [], []
                order = np.lexsort((mid, bound), axis=1) if probes is None else np.argsort(mid, axis=1, kind="stable")
                for i in range(len(q)):
                    for j in order[i, seen[i] : seen[i] + width]:
                        if probes is None and bound[i, j] > worst[i]:
                            break
                        rows += [i] * int(parts[j])
                        leaves += [int(leaf[j])] * int(parts[j])
                        blocks += range(int(parts[j]))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(blocks, pa.int32()), b.column("id").take(take), b.column("v").take(take)], ["leaf", "block", "id", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fieldmark.operators.nearest import _brute

        now, ids, points = None, None, None
        for b in batches:
            keys = list(zip(b.column("leaf").to_pylist(), b.column("block").to_pylist(), b.column("first").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                if keys[at][2]:
                    now, ids, points = keys[at][:2], b.column("ids")[at].values.to_numpy(), b.column("points")[at].values.to_numpy().reshape(-1, dims)
                    at += 1
                    continue
                stop = at
                while stop < len(keys) and keys[stop] == keys[at]:
                    stop += 1
                assert now == keys[at][:2]
                some = b.slice(at, stop - at)
                near, d2 = _brute(_matrix(some.column("v"), dims), points, ids, k)
                own = np.repeat(some.column("id").to_numpy(), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(near.ravel()), pa.array(d2.ravel())], ["id", "neighbor", "d2"])
                at = stop

    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        state = open_ if best is None else cut(open_)
        asked = state.mapInArrow(lambda x, w=width: visits(x, w), "leaf long, block int, id long, v array<double>")
        both = index.blocks.select("leaf", "block", F.lit(True).alias("first"), "ids", "points").unionByName(asked.withColumn("first", F.lit(False)), allowMissingColumns=True)
        dealt = both.repartition(parts, "leaf", "block").sortWithinPartitions("leaf", "block", F.desc("first"))
        found = dealt.mapInArrow(meet, "id long, neighbor long, d2 double")
        every = found if best is None else best.union(found)
        top = Window.partitionBy("id").orderBy("d2", "neighbor")
        best = cut(every.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k).drop("_n"))
        if probes is not None:
            break
        worst = best.groupBy("id").agg(F.count("*").alias("_m"), F.max("d2").alias("_w")).select("id", F.when(F.col("_m") >= k, F.col("_w")).otherwise(float("inf")).alias("_w"))
        more = state.join(worst, "id", "left").select("id", "v", (F.col("seen") + width).alias("seen"), F.coalesce("_w", F.lit(float("inf"))).alias("worst"))

        def unsure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, lo, hi, centre, radius, _ = told.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    b = batch.slice(at, 512)
                    bound, _ = _bounds(_matrix(b.column("v"), dims), lo, hi, centre, radius)
                    ahead = np.sort(bound, axis=1)
                    seen = b.column("seen").to_numpy()
                    left = np.where(seen < bound.shape[1], ahead[np.arange(len(seen)), np.minimum(seen, bound.shape[1] - 1)], np.inf)
                    yield b.filter(pa.array((seen < bound.shape[1]) & (left <= b.column("worst").to_numpy())))

        open_ = cut(more.mapInArrow(unsure, "id long, v array<double>, seen int, worst double"))
        width *= MORE
        if open_.isEmpty():
            break
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "neighbor"))
    return best.select("id", "neighbor", rank.alias("rank"), F.sqrt("d2").alias("distance"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of truth's pairs (id, neighbor) that are found."""
    pairs = truth.select("id", "neighbor").join(found.select("id", "neighbor", F.lit(1).alias("_hit")), ["id", "neighbor"], "left")
    return pairs.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"), F.count("*").alias("pairs"))
