"""The manifest against a plain tree, level by level."""

import hashlib
import random
import zlib

import pytest

from fieldmark.llm import merkle, queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(level):
    """The root of some digests, and the siblings of each on its way up."""
    proofs, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            proofs[k] += [x for j, x in enumerate(level[run : run + 3]) if j != i % 3]
            at[k] = i // 3
        level = [sha("".join(level[j : j + 3])) for j in range(0, len(level), 3)]
    return level[0], proofs


def plain(rows):
    """(leaf, subroot, root, proof_sha256) of rows (doc_id, source, lang, n_chars, text), with the row."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, sha("".join(map(field, r)))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subs[s] = tree([h for _, h in by[s]])
    root, above = tree([subs[s][0] for s in names])
    return [(r, h, subs[s][0], root, sha("".join([*p, *above[k]]))) for k, s in enumerate(names) for (r, h), p in zip(by[s], subs[s][1], strict=True)]


def make(n=3000, seed=2):
    r = random.Random(seed)
    out = []
    for i in r.sample(range(10 * n), n):
        source = "hot" if i % 3 else r.choice(["a", "b", None, "é", "Z", "", "b2"])
        text = r.choice([None, "", "plain", "two\nlines", "\n", "ünï\ncode " * 20])
        out.append((i, source, r.choice(["en", None]), r.choice([None, i]), text))
    return [*out, (-5, "lone", "en", 3, "only\none"), (None, "a", None, None, None), (-7, "twice", None, 1, "same"), (-7, "twice", None, 1, "same"), (-7, "twice", None, 1, "other")]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("merkle"))
    spark.createDataFrame(make(), SCHEMA).repartition(5).write.parquet(f"{where}/documents.parquet")
    return where


def test_query(spark, sf):
    got = [tuple(r) for r in queries.op12_merkle(spark, sf).collect()]
    key = lambda r: tuple(map(str, r))
    want = [(r[0], h, sub, root, proof) for r, h, sub, root, proof in plain(make())]
    assert sorted((r[:5] for r in got), key=key) == sorted(want, key=key)
    texts = {(r[0], h): r[4] for r, h, *_ in plain(make())}
    for doc_id, leaf, _, root, _, folded, verified in got:
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and "\n" in (texts[doc_id, leaf] or "")
        assert verified == (not changed) == (folded == root)


def test_manifest_is_general(spark):
    """Any columns may be carried; the partitioning does not matter; a proof folds to the root."""
    from pyspark.sql import functions as F

    rows = spark.range(1000).select(F.col("id").alias("n"), (F.col("id") % 2).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit("x").alias("idx"), F.lit("y").alias("proof"))
    for table in (rows, rows.repartition(9, "n")):
        got = merkle.manifest(table, "g", ["n"]).withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
        assert len(got) == 1000 and all(r.again == r.root and r.idx == "x" for r in got)
        for g in (0, 1):
            assert {r.subroot for r in got if r.g == g} == {tree([sha(str(i)) for i in range(g, 1000, 2)])[0]}
    assert merkle.manifest(rows.limit(0), "g", ["n"]).count() == 0
    one = merkle.manifest(rows.where("n = 3"), "g", ["n"]).first()
    assert one.leaf == one.subroot == one.root == sha("3") and one.proof == []


def test_parents_in_any_order():
    leaves = [sha(str(k)) for k in range(500)]
    for order in (range(500), random.Random(1).sample(range(500), 500)):
        p = merkle.Parents()
        for i in order:
            p.event("g", 500, 0, i, leaves[i])
        assert not p.open and p.out == [("g", 500, 6, 0, tree(leaves)[0])]
