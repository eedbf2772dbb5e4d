"""SimHash near-duplicates (operator 7): fingerprints linked by meet-in-the-middle ball hashing; groups of near copies."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import cut, drop, shuffle_partitions
from fieldmark.llm.graph import components

SEED = 42
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """A bit is 1 if set in over half of the shingles' hashes; no words: 0."""
    words = (text or b"").lower().split()  # of bytes: splits at ASCII white space, lowers A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle + 1
    starts, ends = starts[:n], ends[shingle - 1 :]
    for k in range(0, n, BLOCK):
        spans = zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(line[s:e], seed) for s, e in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp: bigint, the fingerprint's 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), shingle, seed) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def punctured_balls(radius: int, bands: int) -> list[tuple[int, int, int]]:
    """(bits kept, bits flipped, tag) of each variant that a fingerprint emits.

    Half of an even radius on either side meets in the middle. Of an odd radius one bit is left over: the fingerprint
    is punctured, one band of bits after the other, so that a band with a differing bit takes it away and half of the
    remaining, even radius does for the others. The tag fills the band with its number, so that bands don't mix.
    """
    half, edges = radius // 2, [64 * k // bands for k in range(bands + 1)]
    holes = list(zip(edges, edges[1:], strict=False)) if radius % 2 else [(0, 0)]
    out = []
    for k, (lo, hi) in enumerate(holes):
        hole = (1 << hi) - (1 << lo)
        free = [1 << i for i in range(64) if not hole >> i & 1]
        balls = [0]
        for _ in range(half):
            balls = sorted({x ^ y for x in balls for y in [0, *free]})
        out += [(~hole & (2**64 - 1), x, k << lo) for x in balls]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Rows of a variant up to which all its pairs are compared.
WIDE = 8


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, a row of words each."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def spanning(members: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """members (a row of words each, distinct) -> verified links that join all members that chains of links join, one fewer than members at most."""
    out, rest = [], members
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = apart(rest, x) <= radius
            if near.any():
                out.append((np.broadcast_to(x, (int(near.sum()), len(x))), rest[near]))
                reached.extend(rest[near])
                rest = rest[~near]
    return out


def links(fps: DataFrame, radius: int = 3, bands: int = 3) -> DataFrame:
    """fps (fp, distinct) -> (a, b): verified links within the radius; what chains of links join, these join too.

    Every fingerprint emits its variants (3 bands: 43 or 44 each); variants are shuffled, sorted in their partitions
    (Spark spills), and a run of equal variants is read as a stream. A run holds 44 * 2^22 different fingerprints at
    most; its links are a spanning forest, never all its pairs. Choose 4 bands (196 variants) from about 10^10
    fingerprints on, when 42 bits get crowded.
    """
    spark = fps.sparkSession
    balls = F.array(*[F.struct(F.lit(_signed(k)).cast("long").alias("k"), F.lit(_signed(x ^ t)).cast("long").alias("x")) for k, x, t in punctured_balls(radius, bands)])
    variants = (
        fps.repartition(4 * shuffle_partitions(spark), "fp")  # a task's variants stay few enough not to spill
        .select("fp", F.inline(balls))
        .select((F.col("fp").bitwiseAND(F.col("k"))).bitwiseXOR(F.col("x")).alias("variant"), "fp")
        .repartition(4 * shuffle_partitions(spark), "variant")
        .sortWithinPartitions("variant")
    )

    return matched(variants, radius)


def matched(variants: DataFrame, most: int) -> DataFrame:
    """variants (variant, words of a fingerprint, sorted in each partition) -> (a, b): links of fingerprints that share a variant.

    A fingerprint is one or more bigints; a and b are arrays of them if there are several. Runs of up to WIDE rows
    are compared pair by pair, all runs at once; what a longer run links is a spanning forest of its pairs.
    """
    words = variants.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Links, each once, the end that sorts first as a."""
            if not len(a):
                return
            a, b = a.view(np.int64), b.view(np.int64)
            swap = np.zeros(len(a), bool)
            for k in reversed(range(len(words))):
                swap = np.where(a[:, k] == b[:, k], swap, a[:, k] > b[:, k])
            a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
            both = np.unique(np.hstack((a, b)), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, k].copy()) for k in range(2 * len(words))], [f"{x}{k}" for x in "ab" for k in range(len(words))])

        def edges(v: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            sizes = np.diff(np.append(starts, len(v)))
            left = np.repeat(starts + sizes, sizes) - np.arange(len(v))  # rows of the run from this one on
            small = np.repeat(sizes <= WIDE, sizes)
            found = []
            more = np.flatnonzero(small & (left > 1))
            for step in range(1, WIDE):
                i = more[left[more] > step]
                if not len(i):
                    break
                near = apart(f[i], f[i + step]) <= most
                found.append((f[i[near]], f[i[near] + step]))
            for s, n in zip(starts[sizes > WIDE], sizes[sizes > WIDE], strict=True):
                found += spanning(np.unique(f[s : s + n], axis=0), most)
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield from out(a, b)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                v, *f = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
                held.append((v, np.column_stack(f)))
                if v[0] == held[0][0][0] == v[-1]:
                    continue  # all one run so far
                v, f = (np.concatenate(x) for x in zip(*held, strict=True))
                done = int(np.searchsorted(v.view(np.int64), v.view(np.int64)[-1]))
                yield from edges(v[:done], f[:done])
                held = [(v[done:], f[done:])]
        if held:
            yield from edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    names = [f"{x}{k}" for x in "ab" for k in range(len(words))]
    found = variants.mapInArrow(run, ", ".join(f"{n} long" for n in names)).distinct()
    if len(words) == 1:
        return found.select(F.col("a0").alias("a"), F.col("b0").alias("b"))
    return found.select(*[F.array(*[F.col(f"{x}{k}") for k in range(len(words))]).alias(x) for x in "ab"])


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, bands: int = 3, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fingerprint, component_id), a row for each row of docs.

    Exact copies share a fingerprint and are collapsed before any variant is emitted. component_id is the smallest
    doc_id that chains of links reach. Null, empty and blank texts have the fingerprint zero and link like any other.
    A null doc_id keeps its row; it is no component's id unless the whole component has none. Other columns are
    not read. An empty table gives an empty one.
    """
    fps = cut(fingerprints(docs, shingle, seed))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = components(links(reps.select("fp"), radius, bands))
    rooted = cut(reps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: How near copies are told: six fingerprints of 32 bits of a text's distinct words, which an edit moves least, bring
#: candidates together; one of 128 bits of its five-word shingles verifies them. Texts whose five-word shingles have a
#: Jaccard similarity of 0.8 differ in 17 of the 128 bits on average, by 4 more or less; unrelated ones in 64, by 6.
PIECES, PIECE_BITS, SHINGLE, MOST = 6, 32, 5, 36


def _majority(hashes: bytes, n: int, size: int) -> np.ndarray:
    """Bytes whose bits are set in over half of the n hashes of `size` bytes."""
    ones = np.zeros(8 * size, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, size)
    for k in range(0, n, BLOCK):
        ones += np.unpackbits(rows[k : k + BLOCK], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n)


def sketch(text: bytes | None, shingle: int = SHINGLE, seen: dict[bytes, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(six fingerprints of 32 bits of the distinct words, two words of 64 bits of the shingles); no words: zeros.

    seen: hashes of words met before, up to 300,000 of them.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(PIECES, np.int64), np.zeros(2, np.int64)
    seen = {} if seen is None else seen
    distinct, hashes = set(words), []
    for w in distinct:
        h = seen.get(w)
        if h is None:
            h = xxhash.xxh3_128_digest(w, SEED) + xxhash.xxh3_64_digest(w, SEED + 1)
            if len(seen) < 300_000:
                seen[w] = h
        hashes.append(h)
    pieces = _majority(b"".join(hashes), len(hashes), 4 * PIECES).view(">u4").astype(np.int64)
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh3_128_digest
    spans = zip(starts, ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return pieces, _majority(b"".join([digest(line[s:e], SEED) for s, e in spans]), n, 16).view(">i8").astype(np.int64)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, k1, k2, text) -> (doc_id, k1, k2, c0, c1: the shingles' fingerprint, pieces: array of the words')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        for b in batches:
            found = [sketch(x.as_py(), shingle, seen) for x in b.column(3)]
            c = np.array([x for _, x in found], np.int64).reshape(-1, 2)
            pieces = pa.array([x for x, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), pieces], ["doc_id", "k1", "k2", "c0", "c1", "pieces"])

    named = docs.select(F.col("doc_id").cast("long"), "k1", "k2", F.col("text").cast("binary"))
    return named.mapInArrow(run, "doc_id long, k1 long, k2 long, c0 long, c1 long, pieces array<long>")


def near_links(table: DataFrame, most: int = MOST) -> DataFrame:
    """table (c0, c1, pieces; each (c0, c1) once) -> (a, b: arrays of c0 and c1) that differ in `most` bits or fewer and
    of which two pieces differ in two bits or fewer.

    Every piece emits itself and its 32 neighbours at one bit, half the radius, with its number: 198 variants in all.
    """
    spark = table.sparkSession
    balls = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).cast("long").alias("x")) for k in range(PIECES) for x in (0, *[1 << i for i in range(PIECE_BITS)])])
    variants = (
        table.repartition(4 * shuffle_partitions(spark), "c0", "c1")
        .select("c0", "c1", "pieces", F.inline(balls))
        .select(F.shiftleft(F.col("k").cast("long"), PIECE_BITS).bitwiseOR(F.get("pieces", F.col("k")).bitwiseXOR(F.col("x"))).alias("variant"), "c0", "c1")
        .repartition(4 * shuffle_partitions(spark), "variant")
        .sortWithinPartitions("variant")
    )
    return matched(variants, most)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """One row of docs for each group of near copies: of the smallest doc_id (none comes last), of several such rows
    the one whose columns hash lowest, of equal rows any.

    Two texts are near copies if their fingerprints of `shingle`-word shingles, 128 bits, differ in `most` bits or fewer;
    groups are what chains of them reach. They are found if one of their six fingerprints of distinct words differs in
    two bits or fewer (the README has the share that is). Null, empty and blank texts are one group. Columns of map type do not tell
    rows apart; all columns stay, but none may be called _k1 or _k2. An empty table gives an empty one.
    """
    cols = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]
    keyed = docs.withColumns({f"_k{k}": F.xxhash64(F.lit(k), *cols, *[c.isNull() for c in cols]) for k in (1, 2)})
    found = cut(sketches(keyed.select("doc_id", F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "text"), shingle))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("best")
    reps = cut(found.groupBy("c0", "c1").agg(best, F.min("pieces").alias("pieces")))
    node = lambda a, b: F.concat_ws(" ", F.hex(a), F.hex(b))
    links = near_links(reps.select("c0", "c1", "pieces"), most).select(*[node(F.col(x)[0], F.col(x)[1]).alias(x) for x in "ab"])
    joined = components(links)
    named = reps.select(node("c0", "c1").alias("node"), "best").join(joined, "node", "left")
    first = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    stay = cut(first.select(F.col("best.k1").alias("_k1"), F.col("best.k2").alias("_k2")))
    drop(found, reps)
    return keyed.join(stay, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*docs.columns)
