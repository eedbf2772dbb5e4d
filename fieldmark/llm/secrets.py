"""Secret scans (operator 10): named patterns, and sliding-window Shannon entropy over candidate strings."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import let

#: Fixed patterns: kind, pattern, group whose length counts, least length.
PATTERNS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the same as [0-9a-f]+ of 24 or more: a run is one match, all or nothing
)
#: Character classes: name, candidate pattern, what a candidate has to contain, alphabet, bits that a window needs.
CLASSES = (
    ("hex", r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_=-])", r"[0-9](?s:.*)[A-Fa-f]|[A-Fa-f](?s:.*)[0-9]", "0123456789abcdef", 2.9),
    ("token", r"[A-Za-z0-9+/_=-]{20,}", r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])(?=.*[^0-9A-Fa-f])", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
)
WINDOW = 20
#: Candidates that match one of these are no secrets: UUIDs, samples, counting sequences, paths, dates, words joined by hyphens.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]",
    r"(?i)0123456789|abcdefghij|1234567890",
    r"^/?(?:[A-Za-z]+[0-9]{0,4}[/_-]){2,}[A-Za-z]*[0-9]{0,4}$",
    r"^[0-9/_=+-]+$",
)


def _starts(text: Column, pattern: str, found: Column) -> Column:
    """Where each match starts: what lies between the matches, and the matches, are as long as they are."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    sizes = F.transform(found, lambda x: F.length(x))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, x: let(s["at"] + x["g"], lambda at: F.struct((at + x["n"]).alias("at"), F.array_append(s["out"], at).alias("out")))
    return F.aggregate(F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda g, n: F.struct(g.alias("g"), n.alias("n"))), zero, step)["out"]


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,text:string>>")


def _matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, text>> of the matches whose group is long enough, in code points; end is exclusive."""
    spans = lambda found, sized: F.zip_with(
        F.arrays_zip(_starts(text, pattern, found).alias("s"), found.alias("m")),
        sized,
        lambda x, g: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("text"), F.length(g).alias("n")),
    )
    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: spans(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found))
    kept = F.transform(F.filter(every, lambda x: x["n"] >= least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    return F.when(text.rlike(pattern), kept).otherwise(_none())


def dense(candidate: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """array<struct<start, end>>: the stretches of a candidate that windows of `bits` Shannon entropy or more cover.

    The window slides by a character; of the counts one goes down and one goes up, and the sum of c * log2(c), from
    which the entropy follows, changes by those two terms alone.
    """
    log = [0.0, *[c * math.log2(c) for c in range(1, window + 1)]]
    plogp = F.array(*[F.lit(x) for x in log])
    place = lambda ch: F.instr(F.lit(alphabet), ch) - 1
    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("n"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"),
    )

    def step(s: Column, x: Column) -> Column:
        full = s["n"] >= window
        gone = F.when(full, x["out"]).otherwise(F.lit(-1))
        less = F.when(full, F.get(s["counts"], gone)).otherwise(F.lit(1))
        had = F.get(s["counts"], x["in"]) - F.when(gone == x["in"], 1).otherwise(0)
        total = s["sum"] - F.get(plogp, less) + F.get(plogp, less - 1) - F.get(plogp, had) + F.get(plogp, had + 1)
        counts = F.transform(s["counts"], lambda c, k: c + F.when(k == x["in"], 1).otherwise(0) - F.when(k == gone, 1).otherwise(0))

        def after(total: Column) -> Column:
            n = s["n"] + 1
            rich = (n >= window) & (F.lit(math.log2(window)) - total / window >= bits - 1e-9)
            last = F.try_element_at(s["out"], F.lit(-1))
            joins = last.isNotNull() & (last["end"] >= n - window)
            longer = F.concat(F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), n.alias("end"))))
            more = F.array_append(s["out"], F.struct((n - window).alias("start"), n.alias("end")))
            return F.struct(counts.alias("counts"), total.alias("sum"), n.alias("n"), F.when(~rich, s["out"]).when(joins, longer).otherwise(more).alias("out"))

        return let(total, after)

    places = F.transform(F.split(candidate, ""), lambda ch: place(ch))
    pairs = let(places, lambda p: F.transform(p, lambda x, k: F.struct(x.alias("in"), F.when(k >= window, F.get(p, k - window)).otherwise(-1).alias("out"))))
    return F.aggregate(pairs, start, step)["out"]


def _entropic(text: Column, window: int, allowed: tuple[str, ...]) -> Column:
    """array<struct<start, end>> of the entropy method, over the candidates of all classes."""
    out = []
    for name, pattern, needs, alphabet, bits in CLASSES:
        able = lambda x: x["text"].rlike(needs) & ~F.coalesce(F.greatest(*[x["text"].rlike(a) for a in allowed], F.lit(False)), F.lit(False))  # noqa: B023, E731
        lowered = (lambda c: F.lower(c)) if name == "hex" else (lambda c: c)
        spans = F.transform(
            F.filter(_matches(text, pattern), able),
            lambda x: F.transform(dense(lowered(x["text"]), alphabet, bits, window), lambda d: F.struct((x["start"] + d["start"]).alias("start"), (x["start"] + d["end"]).alias("end"))),  # noqa: B023
        )
        out.append(F.flatten(spans))
    return F.concat(*out)


def scan(docs: DataFrame, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED, name: str = "spans") -> DataFrame:
    """docs (doc_id, text, ...) -> docs with spans (or `name`): array<struct<start, rank, end, kind>>, sorted.

    Kinds are assign, access, hex (the fixed patterns: leftmost matches that don't overlap within their kind) and
    entropy (windows of high entropy in candidates of a character class, merged, unless the candidate is on the
    allow-list, which never takes a fixed pattern's span). Null text is empty and has none. Spans count code points,
    end exclusive. A column of docs named spans is replaced. Every row stays, repeated ones too.
    """
    text = F.coalesce("text", F.lit(""))
    kinds = [(kind, _matches(text, pattern, group, least)) for kind, pattern, group, least in PATTERNS] + [("entropy", _entropic(text, window, allowed))]
    named = [F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))) for k, (kind, found) in enumerate(kinds)]  # noqa: B023
    return docs.withColumn(name, F.array_sort(F.concat(*named)))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in PATTERNS],
        F.sha2(_line(F.filter("spans", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        _line(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs (doc_id, text, n_chars, ...) -> the same rows; each stretch that spans cover is one mask, n_chars follows."""
    scanned = scan(docs, name="_secret_spans")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    step = lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(
        F.struct(
            x["end"].alias("at"),
            F.concat(s["text"], F.when((x["start"] < s["at"]) | (x["start"] == s["at"]) & (s["at"] > 0), F.lit("")).otherwise(F.concat(F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mask)))).alias("text"),
        )
    )
    masked = let(F.aggregate("_secret_spans", zero, step), lambda s: F.concat(s["text"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    clean = scanned.withColumn("text", F.when(F.size("_secret_spans") > 0, masked).otherwise(F.col("text")))
    counted = clean.withColumn("n_chars", F.when(F.size("_secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else clean
    return counted.select(docs.columns)
