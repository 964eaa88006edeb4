"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Space, tab, line feed, vertical tab, form feed and carriage return.
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words in the windows of which repeats are counted.
WINDOW = 8
#: Rules are timed and their rejections counted on about so many documents. The verdict doesn't depend on it.
SAMPLE_DOCS = 1_000
#: A rule's cost counts once it is so many times that of an empty rule, or after so many readings of the sample.
COST_TIMES, COST_REPEATS = 2, 64


def word_array(text: Column) -> Column:
    """Runs of characters other than BLANK."""
    return let(F.btrim(text, F.lit(BLANK)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t-\\r]+")))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many of the words lie in a run of ``window`` words that is found twice or more among them.

    Windows are compared by 64-bit hashes of the words' hashes. Where all differ, which one hash set
    tells, nothing is sorted; else (hash, position) pairs are, and overlaps of the runs counted once.
    """

    def covered(hashes):
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s):
            def same(j):
                here = F.get(s, j)["h"]
                return F.coalesce(here == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(here == F.get(s, j + 1)["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), same), lambda j: F.get(s, j)["i"]))

        def total(starts):
            step = lambda k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - F.get(starts, k), F.lit(window)))
            return F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.lit(0), lambda a, k: a + step(k))

        return let(let(pairs, twice), total)

    def of(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    def windows(h):
        return F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))

    def long_enough(w):
        return let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), of)

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(long_enough(words))


def base_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_lines (lines with a word)."""

    def of(t):
        lines = F.filter(F.split(t, "\\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")

        def counts(w):
            return let(
                lines,
                lambda ls: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.translate(t, BLANK, "")).cast("long").alias("word_chars"),
                    (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                    repeated_words(w).cast("long").alias("n_repeat_words"),
                    F.size(ls).cast("long").alias("n_lines"),
                ),
            )

        return let(word_array(t), counts)

    return let(F.coalesce(text, F.lit("")), of)


def base_failed(b: Column) -> Column:
    return (b["n_words"] < 20) | (100 * b["n_repeat_words"] > 30 * b["n_words"])


def rules(text: Column, b: Column) -> dict[str, Column]:
    """What rejects a document that passed the base, by name. Each is never null."""
    t = F.coalesce(text, F.lit(""))
    return {
        "symbols": 10 * b["n_symbols"] > 2 * b["n_words"],
        # one or two repeats, as of a head and foot line, say little about a document of few lines
        "repeated_lines": (b["n_dup_lines"] >= 3) & (100 * b["n_dup_lines"] > 30 * b["n_lines"]),
        "word_length": (b["word_chars"] < 2 * b["n_words"]) | (b["word_chars"] > 15 * b["n_words"]),
        "upper_case": 2 * F.length(F.regexp_replace(t, "[^\\p{Lu}]", "")) > b["word_chars"],
        "few_letters": 2 * F.length(F.regexp_replace(t, "[^\\p{L}]", "")) < b["word_chars"],
    }


def rule_costs(sample: DataFrame, every: dict[str, Column]) -> dict[str, float]:
    """Seconds that each rule takes on the sample, above those of a rule that says nothing.

    The sample is read again and again until a rule's time is COST_TIMES that of the empty rule, or COST_REPEATS times.
    """

    def seconds(rejects: Column, repeats: int) -> float:
        again = sample.withColumn("__v_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        began = time.perf_counter()
        # the repeat's number is part of the condition, so that it is evaluated for each of them
        again.agg(F.count_if(rejects & (F.col("__v_again") > 0)).alias("n")).first()
        return time.perf_counter() - began

    nothing = F.lit(False)
    seconds(nothing, 1)  # the first job also compiles
    costs = {}
    for name, rejects in every.items():
        seconds(rejects, 1)
        repeats = 4
        while True:
            empty, own = seconds(nothing, repeats), seconds(rejects, repeats)
            if own >= COST_TIMES * empty or repeats >= COST_REPEATS:
                break
            repeats *= 4
        costs[name] = max(own - empty, 1e-6) / repeats
    return costs


def cascade_order(sample: DataFrame, text: str, base: str) -> list[str]:
    """The rules' names in the order they run in: each next one rejects most per second of work among the sample's documents that the base and those before it let live; names break ties."""
    every = rules(F.col(text), F.col(base))
    costs = rule_costs(sample, every)
    alive = sample.where(~base_failed(F.col(base)))
    seen = alive.select(*[r.alias(name) for name, r in every.items()]).collect()  # a row of five flags for each sampled document
    order: list[str] = []
    while len(order) < len(every):
        left = [r for r in seen if not any(r[name] for name in order)]
        order.append(min((n for n in every if n not in order), key=lambda n: (-sum(r[n] for r in left) / costs[n], n)))
    return order


def judged(spark: SparkSession, docs: DataFrame, text: str = "text", *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs with a struct ``__v_base`` of base_counts(), and ``__v_failed`` and ``__v_kept``.

    A document is kept if the base passes and no rule rejects it: null, empty and short texts fail
    the base. The rules run one after another, up to the first that rejects, in the order of
    cascade_order(); the order changes the cost alone. An empty table stays empty. Documents are
    judged one by one and whole, whatever their length, so repeated rows get equal verdicts; all
    columns stay.
    """
    base = docs.withColumn("__v_base", base_counts(F.col(text)))
    rows = docs.count()
    fraction = min(1.0, sample_docs / rows) if rows else 1.0
    sample = docs.select(text).sample(fraction, seed=11).withColumn("__v_base", base_counts(F.col(text))).cache()
    sample.count()
    order = cascade_order(sample, text, "__v_base")
    sample.unpersist()
    b = F.col("__v_base")
    every = rules(F.col(text), b)
    kept = F.when(base_failed(b), F.lit(False))
    for name in order:
        kept = kept.when(every[name], F.lit(False))
    return base.withColumn("__v_failed", base_failed(b)).withColumn("__v_kept", kept.otherwise(F.lit(True)))


def keep_good(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the cascade keeps, with all their columns."""
    return judged(spark, docs, text).where("__v_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(spark, docs).select(
        "doc_id",
        *[F.col(f"__v_base.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("__v_failed").alias("base_failed"),
        F.col("__v_kept").alias("kept"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 8], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 7, 0))) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
p AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM r) GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
             len(ls) AS n_lines, length(regexp_replace(x, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(x, '[^\p{L}]', '', 'g')) AS n_letters
      FROM w LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 2 * n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_upper > word_chars OR 2 * n_letters < word_chars) AS kept
FROM f
"""
