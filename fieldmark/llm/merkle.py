"""Merkle dataset manifest (operator 12): event-driven combining of child digests, and proofs by the links back."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import bounded, cut, drop, shuffle_partitions

#: Children of a node, and levels between two reshuffles: a task gathers what is left of up to ARITY^TIER nodes.
ARITY, TIER = 3, 6
#: Partial parents that a task holds before a shuffle; more are sent on as they are.
HELD = 100_000

NODE = "g string, n long, level int, idx long, h string"
SCHEMA = pa.schema([("g", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("h", pa.string())])


def leaf(*values: Column) -> Column:
    """sha256 (lowercase hex) of the values, each written as its UTF-8 length, a colon and itself, `-` if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a digest and its proof give."""
    return F.aggregate(proof, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def joined(proof: Column) -> Column:
    """sha256 of a proof's digests, in order."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["left"], s["right"]))), 256)


def indexed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows, written, with n and idx: how many rows their group has, and how many come before in `order`.

    Rows are dealt out in ranges of (group, order) and sorted within; a group of any size takes many tasks. The rows of a group in the
    ranges before are added from a table of a row a range and group.
    """
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    spans = placed.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.count("*").alias("_m"), F.min("_at").alias("_first"))
    w = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_m").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = cut(spans.select("_g", "_p", "_first", before.alias("_before"), F.sum("_m").over(w).alias("n")))
    met = placed.join(bounded(spans), (F.col(group) == F.col("_g")) & (part == F.col("_p")))
    out = cut(met.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_g", "_p", "_m", "_first", "_before", "_at"))
    drop(placed, spans)
    return out


def size_at(n: int, level: int) -> int:
    """Nodes of a level over n nodes."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


class Parents:
    """Partial parents of some trees: each holds the digests of children seen so far, by their place.

    A child is an event. The one that completes its parent, whose number of children follows from the tree's size, makes the
    parent's digest, which is the next event. `out` gets nodes that go no further: of level TIER, and roots.
    """

    def __init__(self):
        self.open: dict[tuple, dict[int, str]] = {}
        self.out: list[tuple] = []

    def event(self, g: str, n: int, level: int, idx: int, h: str) -> None:
        while level < TIER and (size := size_at(n, level)) > 1:
            parent, place = divmod(idx, ARITY)
            key = g, n, level, parent
            children = self.open.setdefault(key, {})
            children[place] = h
            if len(children) < min(ARITY, size - ARITY * parent):
                return
            del self.open[key]
            h = hashlib.sha256("".join(children[k] for k in range(len(children))).encode()).hexdigest()
            level, idx = level + 1, parent
        self.out.append((g, n, level, idx, h))

    def frontier(self) -> Iterator[tuple]:
        """The children of parents that are not complete."""
        for (g, n, level, parent), children in self.open.items():
            for place, h in children.items():
                yield g, n, level, ARITY * parent + place, h
        self.open.clear()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: what a task's nodes give together, and those whose parents need nodes of other tasks."""
    parents = Parents()
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            parents.event(*row)
        if len(parents.open) > HELD:
            parents.out.extend(parents.frontier())
        if parents.out:
            yield _batch(parents.out, SCHEMA)
            parents.out = []
    if rows := [*parents.frontier()]:
        yield _batch(rows, SCHEMA)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches, a table for each value of the keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(k)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] |= bool(held) and held[-1].column(k)[-1].as_py() != c[0].as_py()
        at = 0
        for stop in [*np.flatnonzero(new).tolist(), b.num_rows]:
            if stop > at:
                held.append(b.slice(at, stop - at))
            if stop < b.num_rows and held:
                yield pa.Table.from_batches(held)
                held = []
            at = stop
    if held:
        yield pa.Table.from_batches(held)


def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """After the shuffle: all nodes below one of level TIER are in one run; it comes out, as a node of the next tier."""
    schema = pa.schema([("g", pa.string()), ("n", pa.int64()), ("idx", pa.int64()), ("h", pa.string())])
    out: list[tuple] = []
    for run in runs(batches, ["g", "block"]):
        parents = Parents()
        for row in zip(*(run.column(c).to_pylist() for c in SCHEMA.names), strict=True):
            parents.event(*row)
        if parents.open or len(parents.out) != 1:
            raise ValueError(f"the nodes under {run.column('g')[0]}, {run.column('block')[0]} are not complete")
        g, n, _, idx, h = parents.out[0]
        out.append((g, -(-n // ARITY**TIER), idx, h))
        if len(out) >= 4096:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """nodes (g, n, idx, h, ...) -> tiers, the nodes first, each of a node for ARITY^TIER of the one before, up to a root a group."""
    tiers = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        t = tiers[-1].select("g", "n", F.lit(0).alias("level"), "idx", "h")
        if most <= 1:
            return tiers
        parts = shuffle_partitions(nodes.sparkSession)
        under = F.array(*[F.lit(ARITY ** (TIER - k)).cast("long") for k in range(TIER + 1)])
        # a root below level TIER is node 0 of its tier
        dealt = t.mapInArrow(combined, NODE).withColumn("block", F.floor(F.col("idx") / F.element_at(under, F.col("level") + 1)))
        dealt = dealt.repartition(parts, "g", "block").sortWithinPartitions("g", "block")
        tiers.append(cut(dealt.mapInArrow(resolved, "g string, n long, idx long, h string")))
        most = -(-most // ARITY**TIER)


STEP = "array<struct<left:string,right:string>>"


def proven(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """nodes (g, n, idx, h, ...) of a tier, tops (g, idx, proof, subroot, root) of the one above -> nodes with proof, subroot, root.

    A run of a top and its nodes is one task's; the links from each parent to its children hand its proof down to them.
    """
    own = [c for c in nodes.columns if c not in ("proof", "subroot", "root")]
    wide = nodes.select(*own, F.floor(F.col("idx") / ARITY**TIER).alias("block"), F.lit(False).alias("top"))
    above = tops.select("g", F.col("idx").alias("block"), "proof", "subroot", "root", F.lit(True).alias("top"))
    both = wide.unionByName(above, allowMissingColumns=True).repartition(shuffle_partitions(nodes.sparkSession), "g", "block").sortWithinPartitions("g", "block", F.desc("top"), "idx")
    out = nodes.select(*own).withColumns({"proof": F.lit(None).cast(STEP), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["g", "block"]):
            t = t.combine_chunks()
            head, rows = t.slice(0, 1).to_pylist()[0], t.slice(1)
            if not rows.num_rows:
                continue
            level, n, links = rows.column("h").to_pylist(), rows.column("n")[0].as_py(), []
            for k in range(TIER):
                if size_at(n, k) <= 1:
                    break
                links.append([("".join(level[i - i % ARITY : i]), "".join(level[i + 1 : i - i % ARITY + ARITY])) for i in range(len(level))])
                level = [hashlib.sha256("".join(level[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(level), ARITY)]
            proofs = [[(s["left"], s["right"]) for s in head["proof"]]]
            for steps in reversed(links):
                proofs = [[step, *proofs[i // ARITY]] for i, step in enumerate(steps)]
            flat = [s for p in proofs for s in p]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in proofs])]).astype(np.int32))
            steps = pa.StructArray.from_arrays([pa.array([s[j] for s in flat], pa.string()) for j in (0, 1)], ["left", "right"])
            told = [pa.ListArray.from_arrays(offsets, steps), *[pa.array([head[c]] * rows.num_rows, pa.string()) for c in ("subroot", "root")]]
            yield pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks() for c in own], *told], [*own, "proof", "subroot", "root"])

    return both.mapInArrow(run, out.schema)


def descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first tier's nodes with what is told of the roots; nodes that are roots themselves have it at once."""
    if len(tiers) == 1:
        return tiers[0].join(tops.drop("idx"), "g")
    for nodes in reversed(tiers[:-1]):
        tops = proven(nodes, tops)
    return tops


def manifest(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """leaves (group, order..., leaf: hex digest, ...) -> the same with subroot, root and proof (array of left and right siblings' digests).

    Each group's leaves, ascending by `order` (nulls first; ties by the digest, and what still ties is alike), are hashed up, ARITY
    at a time, to its subroot; the subroots, ordered by group (null first, bytewise), likewise to the root. A lone node of its level
    is hashed too, a lone leaf is its group's subroot. A proof leads from the leaf to the root: see folded(). Repeated rows are
    leaves of their own; an empty table gives none. Columns named subroot, root or proof are replaced; other names do not matter.
    """
    kept = [c for c in leaves.columns if c not in (group, "leaf", "subroot", "root", "proof")]
    inner = {c: f"c{k}" for k, c in enumerate(kept)}
    g = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))
    named = cut(leaves.select(g.alias("g"), F.col("leaf").alias("h"), *[F.col(c).alias(x) for c, x in inner.items()]))
    nodes = indexed(named, "g", [*[inner[c] for c in order], "h"])
    drop(named)
    tiers = climb(nodes)
    sources = climb(indexed(tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("source"), "h"), "g", ["source"]))
    root = sources[-1].select("g", F.lit(0).cast("long").alias("idx"), F.array().cast(STEP).alias("proof"), F.col("h").alias("subroot"), F.col("h").alias("root"))
    tops = descend(sources, root).select(F.col("source").alias("g"), F.lit(0).cast("long").alias("idx"), "proof", F.col("h").alias("subroot"), "root")
    back = F.when(F.col("g") != "", F.substring(F.col("g"), 2, (1 << 31) - 1)).cast(leaves.schema[group].dataType).alias(group)
    return descend(tiers, tops).select(back, *[F.col(x).alias(c) for c, x in inner.items()], F.col("h").alias("leaf"), "subroot", "root", "proof")


#: crc32 of a number's digits in SQL, a byte at a time.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
_leaf = lambda text: "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
_climb = lambda name, first: f"{name} AS (SELECT t, 0 AS level, n, idx, h FROM {first} UNION ALL SELECT t, level + 1, (n + 2) // 3, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY t, level, n, idx // 3), {name}_runs AS MATERIALIZED (SELECT t, level, idx // 3 AS parent, list(h ORDER BY idx) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"
_walk = lambda name, up, first: f"{name} AS (SELECT rid, t, 0 AS level, n, idx, proof, h FROM {first} UNION ALL SELECT rid, w.t, w.level + 1, (n + 2) // 3, idx // 3, proof || array_to_string(hs[1:idx % 3], '') || array_to_string(hs[idx % 3 + 2:], ''), sha256(array_to_string(hs[1:idx % 3], '') || h || array_to_string(hs[idx % 3 + 2:], '')) FROM {name} w JOIN {up}_runs r ON r.t = w.t AND r.level = w.level AND r.parent = w.idx // 3 WHERE n > 1)"
ORACLE = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS t, {_leaf('text')} AS h, {_leaf("(CASE WHEN doc_id IS NOT NULL AND " + CRC + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS own FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, own, h) - 1 AS idx, count(*) OVER (PARTITION BY t) AS n FROM d),
{_climb('up', 'l')},
sub AS MATERIALIZED (SELECT 'top' AS t, t AS source, h, row_number() OVER (ORDER BY t) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
{_climb('top', 'sub')},
{_walk('w', 'up', "(SELECT rid, t, n, idx, '' AS proof, own AS h FROM l)")},
{_walk('v', 'top', "(SELECT rid, sub.t, sub.n, sub.idx, proof, w.h FROM w JOIN sub ON sub.source = w.t WHERE w.n = 1)")},
r AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, l.h AS leaf, sub.h AS subroot, root, sha256(v.proof) AS proof_sha256, v.h AS folded_root, v.h = root AS verified FROM l JOIN sub ON sub.source = l.t JOIN v ON v.rid = l.rid AND v.n = 1 CROSS JOIN r"""
