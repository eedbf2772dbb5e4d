"""Quality rules (operator 4): rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import BLANKS, cut, let, words

ROUNDS = 40
#: Belief in the rules before any vote is seen: the odds that a bad, and a good, document gets no vote, a bad one, a good one;
#: it counts as much as this share of all documents.
BELIEF, SHARE = ((0.2, 0.4, 0.4), (0.2, 0.03, 0.77)), 0.02


def _repeats(w: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, first ones included.

    Windows' hashes are packed with their places (low bits) and sorted; equal neighbours are repeats.
    """
    n = F.size(w)
    hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(bits: Column, h: Column) -> Column:
        packed = F.array_sort(F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))
        top = lambda x: F.call_function("shiftrightunsigned", x, bits)
        same = lambda p: F.filter(p, lambda x, k: F.coalesce(top(x) == top(F.get(p, k - 1)), F.lit(False)) | F.coalesce(top(x) == top(F.get(p, k + 1)), F.lit(False)))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        places = F.array_sort(F.transform(let(packed, same), lambda x: x.bitwiseAND(low)))
        widths = lambda at: F.transform(at, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, k + 1), x + 3) - x))
        return F.aggregate(let(places, widths), F.lit(0).cast("long"), lambda s, x: s + x)

    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(F.ceil(F.log2(n.cast("double") + 1)).cast("int"), h)).otherwise(F.lit(0).cast("long"))
    return F.when(n >= 4, let(hashed, some)).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id and counts of each whole text, a row for each row; null text has no word."""
    text = F.coalesce("text", F.lit(""))
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _repeats(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.substring(x, -1, 1).isin(".", ",", ";", ":", "!", "?"))).cast("long").alias("n_stops"),
        ),
    )
    of_lines = let(
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return docs.select(
        "doc_id", of_words.alias("w"), of_lines.alias("l"), count("[#*$%&|<>]").alias("n_symbols"), count("[A-Z]").alias("n_capitals"), count("!").alias("n_shouts")
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_capitals", "n_shouts")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 1).when(good, 2).otherwise(0)


def rules() -> dict[str, Column]:
    """A column each: 2 votes for good, 1 for bad, 0 abstains. Texts without a word get no vote but that for length."""
    n, some = F.col("n_words"), F.col("n_words") > 0
    per = lambda c: F.coalesce(F.try_divide(F.col(c), n), F.lit(0.0))
    mean = F.coalesce(F.try_divide(F.col("word_chars"), n), F.lit(0.0))
    shout = F.coalesce(F.try_divide(F.col("n_capitals"), F.col("word_chars")), F.lit(0.0))
    doubled = F.coalesce(F.try_divide(F.col("n_dup_lines"), F.col("n_lines")), F.lit(0.0))
    return {
        "length": _vote(n >= 100, n < 50),
        "repeats": _vote(some & (per("n_repeat_words") <= 0.1), per("n_repeat_words") > 0.3),
        "variety": _vote(per("n_distinct") >= 0.62, some & (n <= 2000) & (per("n_distinct") < 0.56)),
        "symbols": _vote(some & (per("n_symbols") <= 0.02), per("n_symbols") > 0.2),
        "lines": _vote(some & (doubled <= 0.05), doubled > 0.3),
        "shouting": _vote(some & (per("n_shouts") <= 0.05), per("n_shouts") > 0.3),
        "capitals": _vote(some & (shout <= 0.15), shout > 0.4),
        "lengths": _vote(mean.between(4.5, 6.5), some & ~mean.between(4.3, 7.0)),
        "stops": _vote(per("n_stops").between(0.08, 0.4), some & ~per("n_stops").between(0.05, 0.6)),
    }


def fit(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> list[float]:
    """votes (names: 0, 1, 2) -> the prior of good, then for each rule and side (bad, good) the odds of 0, 1 and 2.

    Expectation-maximisation over the patterns of votes, of which there are 3^rules at most however many documents
    there are: they are counted by all executors, and one expression runs all rounds over the counts.
    """
    r = len(names)
    patterns = votes.groupBy(F.array(*[F.col(c) for c in names]).alias("v")).agg(F.count("*").cast("double").alias("n"))
    first = [x for _ in range(r) for side in BELIEF for x in side]
    at = lambda j, side, v: j * 6 + side * 3 + v

    def posterior(s: Column, v: Column) -> Column:
        side = lambda k: sum((F.log(F.get(s["odds"], F.lit(at(j, k, 0)) + F.get(v, F.lit(j)))) for j in range(r)), F.log(s["good"] if k else 1 - s["good"]))
        return 1 / (1 + F.exp(F.greatest(F.least(side(0) - side(1), F.lit(700.0)), F.lit(-700.0))))

    total = F.aggregate("patterns", F.lit(0.0), lambda t, x: t + x["n"])

    def round_(s: Column, _: Column) -> Column:
        def counted(p: Column) -> Column:
            zero = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("n"))
            sums = F.aggregate(p, zero, lambda t, x: F.struct((t["g"] + x["n"] * x["p"]).alias("g"), (t["n"] + x["n"]).alias("n")))
            votes_of = F.transform(
                F.sequence(F.lit(0), F.lit(6 * r - 1)),
                lambda k: F.aggregate(
                    p,
                    F.get(F.array(*[F.lit(x) for x in first]), k) * (1 + SHARE * total),
                    lambda t, x: t + F.when(F.get(x["v"], F.floor(k / 6).cast("int")) == k % 3, x["n"] * F.when(F.floor(k / 3) % 2 == 1, x["p"]).otherwise(1 - x["p"])).otherwise(0.0),
                ),
            )
            odds = lambda c: F.transform(c, lambda x, k: x / (F.get(c, k - k % 3) + F.get(c, k - k % 3 + 1) + F.get(c, k - k % 3 + 2)))
            return let(sums, lambda t: F.struct(((t["g"] + 1) / (t["n"] + 2)).alias("good"), let(votes_of, odds).alias("odds")))

        return let(F.transform("patterns", lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), posterior(s, x["v"]).alias("p"))), counted)

    start = F.struct(F.lit(0.9).alias("good"), F.array(*[F.lit(x) for x in first]).alias("odds"))
    model = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("patterns")).select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, round_).alias("m"))
    row = model.select("m.*").first()
    if row["odds"] is None or not patterns.head(1):
        return [0.9, *first]
    return [row["good"], *row["odds"]]


def judge(docs: DataFrame, least: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text) -> features of each row, base_failed, quality (posterior probability of good) and kept.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows; such rows are not kept,
    whatever the posterior. Other rows are kept from quality `least` on. Repeated rows vote each; null and empty texts
    fail. The model is fit to the votes of all rows that the base
    leaves open; an empty table gives an empty one.
    """
    named = rules()
    found = cut(features(docs.select("doc_id", "text")).withColumns({f"vote_{k}": v for k, v in named.items()}))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    model = fit(found.where(~failed), [f"vote_{k}" for k in named], rounds)
    good, odds = model[0], model[1:]
    weigh = lambda j, name: F.get(F.array(*[F.log(F.lit(odds[6 * j + v])) - F.log(F.lit(odds[6 * j + 3 + v])) for v in range(3)]), F.col(f"vote_{name}"))
    against = sum((weigh(j, k) for j, k in enumerate(named)), F.log(F.lit(1 - good)) - F.log(F.lit(good)))
    return (
        found.withColumn("quality", 1 / (1 + F.exp(F.greatest(F.least(against, F.lit(700.0)), F.lit(-700.0)))))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= least))
        .drop(*[f"vote_{k}" for k in named])
    )
