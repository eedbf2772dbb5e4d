"""Token counts against the libraries' own, text by text."""

import random

import pytest

from fieldmark.llm import tokens

P = pytest.importorskip("public_tokenizers")

ODD = [None, "", " ", "\n\n", "a  b", "x\x1c y\x85 z\xa0 w", "<|endoftext|> a<|endoftext|>b <|endo", "don't 's  'S", "ﬁ ①  é é ́", "a▁ b ▁c", "日本 語   ", "Σ ς ΑΣ ΑΣ."]


def texts():
    r = random.Random(5)
    out = ODD + ["".join(r.choice("ab1 .'\n\t\xa0\x1f​é日▁́<|>") for _ in range(r.randrange(60))) for _ in range(300)]
    return [*out, " ".join(r.choice(["the", "of", "tokenization", "42", "naïve"]) for _ in range(60_000)), "x" * 5000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"])
def test_parts_add_up(name):
    """A text's number of tokens is the sum of its parts', however small the parts."""
    with open(P.path(name), "rb") as f:
        lengths, boundary = tokens.loaded(name, f.read(), P.PATTERN)
    counts = tokens.Counts(lengths, boundary)
    own = [t or "" for t in texts()]
    whole = lengths(own)
    assert counts.of(own) == whole
    assert [sum(lengths([*tokens.slabs(t, boundary, 7)])) for t in own[:100]] == whole[:100]


def test_balanced():
    assert [*tokens.balanced(["aa", "b", "ccc", "d" * 9, "e"], 4)] == [["aa", "b"], ["ccc"], ["d" * 9], ["e"]]
    assert [*tokens.slabs("ab cd ef", tokens.BOUNDARY, 3)] == ["ab cd", " ef"]
    assert [*tokens.slabs("abcdefgh", tokens.BOUNDARY, 3)] == ["abcdefgh"]


def test_counted(spark):
    from tokenizers import Tokenizer

    from pyspark.sql import functions as F

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(k, x) for k, x in enumerate(texts())] + [(None, "no id"), (None, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(c) for c in ("key", "n_bytes", "n_tokens", "over_limit")})
    want = sorted((str(i), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in rows)
    got = tokens.counted(docs, P.path("byte_bpe_50k.json"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert tokens.counted(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        tokens.loaded("vocabulary.txt", b"")
