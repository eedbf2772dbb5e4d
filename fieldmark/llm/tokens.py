"""Token counts (operator 11): batch encoding in Arrow functions that return lengths only."""

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of the texts whose pieces are counted at once, and of the new pieces given to a library at once.
GROUP_BYTES, BATCH_BYTES = 1 << 22, 1 << 18
#: Pieces whose lengths a task remembers, and the characters up to which it does.
REMEMBERED, SHORT = 1 << 20, 64
#: A safe boundary: after a character that no library takes for white space, before one that all do.
#: No piece of a pre-tokenizer goes on over it: white space either starts a piece or is one.
BOUNDARY = re.compile(r"(?<=\S)(?=[\t-\r\x20])")
#: For libraries that put a space before each text: one space between two such characters, which is left out.
SINGLE = re.compile(r"(?<=[^\s▁])\x20(?=[^\s▁])")

#: White space that not all libraries take for such, and the parts between boundaries of texts that have none of it.
ODD = re.compile(r"[^\S\t-\r\x20]")
PARTS = re.compile(r"[\t-\r\x20]*[^\t-\r\x20]+|[\t-\r\x20]+$")

Lengths = Callable[[list[str]], list[int]]


def loaded(name: str, content: bytes, pattern: str | None = None) -> tuple[Lengths, re.Pattern]:
    """(the numbers of tokens of some texts, boundaries at which a text's number is the sum of its parts') of a vocabulary file.

    By the file's ending: .json for tokenizers, .model for sentencepiece, .tiktoken (ranks; pattern needed) for tiktoken. No begin, end or
    other added tokens, no truncation, no padding; special strings inside texts are what the library makes of them by default.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(content)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)], BOUNDARY
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        s = SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(x) for x in s.encode(texts, num_threads=1)], SINGLE
    if name.endswith(".tiktoken"):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(e.encode_ordinary(x)) for x in texts], BOUNDARY
    raise ValueError(f"{name}: the ending has to be .json, .model or .tiktoken")


def slabs(text: str, boundary: re.Pattern, size: int) -> Iterator[str]:
    """Parts of a text of about `size` characters, split at safe boundaries; a stretch without any stays whole."""
    at = 0
    while len(text) - at > size and (m := boundary.search(text, at + size)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def balanced(texts: Iterable[str], size: int) -> Iterator[list[str]]:
    """Lists of texts of up to `size` characters together; a longer text is a list of its own."""
    some, held = [], 0
    for t in texts:
        if some and held + len(t) > size:
            yield some
            some, held = [], 0
        some.append(t)
        held += len(t)
    if some:
        yield some


class Counts:
    """Numbers of tokens of texts: those of pieces between safe boundaries, added. Pieces seen before are not encoded again."""

    def __init__(self, lengths: Lengths, boundary: re.Pattern):
        self.lengths, self.boundary, self.known = lengths, boundary, {}

    def pieces(self, text: str) -> list[str]:
        return PARTS.findall(text) if self.boundary is BOUNDARY and not ODD.search(text) else self.boundary.split(text)

    def of(self, texts: list[str]) -> list[int]:
        pieces = [self.pieces(t) for t in texts]
        known = self.known
        new = [p for p in set(chain.from_iterable(pieces)) if p not in known]
        for some in balanced(sorted(new, key=len), BATCH_BYTES):
            known.update(zip(some, self.lengths(some), strict=True))
        out = [sum(map(known.__getitem__, p)) for p in pieces]
        if len(known) > REMEMBERED:
            known.clear()
        for p in new:
            if len(p) > SHORT:
                known.pop(p, None)
        return out

    def column(self, texts: pa.Array) -> np.ndarray:
        """The same for a column, in groups of about GROUP_BYTES; nulls have none."""
        out = np.zeros(len(texts), np.int64)
        rows, group, held = [], [], 0

        def count() -> None:
            np.add.at(out, rows, self.of(group))
            rows.clear()
            group.clear()

        for k in range(len(texts)):
            for part in slabs(texts[k].as_py() or "", self.boundary, GROUP_BYTES):
                rows.append(k)
                group.append(part)
                held += len(part)
                if held >= GROUP_BYTES:
                    count()
                    held = 0
        if rows:
            count()
        return out


@lru_cache(maxsize=1)
def counts(name: str, content: bytes, pattern: str | None) -> Counts:
    """What a worker has of a vocabulary: its tasks share it."""
    return Counts(*loaded(name, content, pattern))


def counted(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """docs (key, text) -> (key, n_bytes, n_tokens, over_limit: more tokens than `limit`), a row for each row, in one pass without a shuffle.

    path: a vocabulary file that the driver reads and sends to the tasks (a few MB). Null texts are empty and have no token;
    repeated rows and null keys stay; other columns are not read. A task holds the pieces of GROUP_BYTES of text, whatever the
    texts' lengths; a stretch without a safe boundary is encoded as a whole.
    """
    with open(path, "rb") as f:
        content = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((os.path.basename(path), content, pattern))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counts(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.column(b.column(2)))], ["key", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    found = docs.select(F.col(key).alias("key"), size.alias("n_bytes"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
