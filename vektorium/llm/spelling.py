"""Spelling variants grouped by one-edit pairs, which the merging of errata tries finds."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

#: Words have so many code points and occurrences at least.
LENGTH, OCCURRENCES = 6, 5
#: A form has so many times the occurrences of its variants at least.
RATIO = 5
#: A run whose checksum this divides loses a code point in op11.
DROP_EVERY = 199
#: Different words that a task counts before it hands them on.
HELD = 300_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, length: int = LENGTH, drop_every: int | None = None) -> DataFrame:
    """(word, n): maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of the whole texts with A-Z lower-cased, of ``length`` code points at least, and how often each occurs.

    With ``drop_every``, let h be the crc32 of ``<id>:<run>``; where drop_every divides h, the run
    loses the code point at h % its length first. A null id is written as nothing; null and empty
    texts have no runs; repeated rows count as often as they are there. Tasks count before anything
    is shuffled, and hold HELD different words at most, however long a text is.
    """
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for b in batches:
            for i, t in zip(b["i"].to_pylist(), b["t"].to_pylist(), strict=True):
                if not t:
                    continue
                own: dict[str, int] = {}
                for w, n in Counter(run.findall(t)).items():
                    w = w.lower() if w.isascii() else w.translate(_LOWER)
                    own[w] = own.get(w, 0) + n
                start = zlib.crc32(b":" if i is None else f"{i}:".encode())
                for w, n in own.items():
                    if drop_every:
                        h = zlib.crc32(w.encode(), start)
                        if h % drop_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < length:
                                continue
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    parts = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text).alias("t")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, i, c, h): where a word's path in the trie of all words (word, n; each once) leaves the heavy path.

    i: the length of the prefix there; c: the word's next character, empty where the word ends; h: the
    heavy child, under which most words lie (ties: the largest character). Every light edge at least
    halves the words below, so a word has no more than the logarithm of their number, and an end. A
    node is known by its prefix' hash: nodes that shared one would share an h, which has no effect on
    what is found, as any choice of one h for each prefix finds every pair.
    """
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    edges = at.select("word", "n", "i", F.xxhash64(F.left("word", F.col("i"))).alias("node"), F.substr("word", F.col("i") + 1, F.lit(1)).alias("c"))
    children = edges.groupBy("node", "c").agg(F.count(F.lit(1)).alias("size"))
    largest = F.max(F.when(F.col("c") != "", F.struct("size", "c")))
    heavy = children.groupBy("node").agg(F.count(F.lit(1)).alias("children"), largest["c"].alias("h")).where("children > 1 AND h IS NOT NULL").select("node", "h")
    heavy = stored(heavy)  # else the join below keeps the aggregate's partitions, and all words under the root stay in one
    return edges.join(heavy, "node").where("c != h").select("word", "n", "i", "c", "h")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of words (word, n; each once) that differ from another by exactly one inserted, deleted or replaced character; best: the other of largest n, ties to the smallest.

    The trie of all words is merged small-to-large: at each node the words of its light subtrees
    alone leave it, with the light character replaced by the heavy one, with it skipped, and with the
    heavy one put before it. Where such a string is a word, the terminals coincide and the two words
    are near. Light subtrees that lose the same character place coincide with each other; such a
    group has a word for each character at most, and is summed up rather than paired. An insertion
    is told at the end of a run of its character, so that every pair is found once. Prefixes
    are told apart by hash, terminals by the whole string, so no group or task grows with one word.
    """
    light = stored(light_edges(words))
    p, rest = F.left("word", F.col("i")), F.substr("word", F.col("i") + 1)
    s = F.substr("word", F.col("i") + 2)
    skipped = F.when(~s.startswith(F.col("c")), F.concat(p, s))
    keys = F.when(F.col("c") == "", F.array(F.concat(p, "h"))).otherwise(F.array(F.concat(p, "h", s), F.concat(p, "h", rest), skipped))
    probes = light.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(keys).alias("word")).where("word IS NOT NULL")
    met = probes.join(words.select("word", "n"), "word")
    one = F.lit(1).cast("long").alias("near")
    best = lambda n, w: F.struct((-F.col(n)).alias("minus"), F.col(w).alias("other")).alias("best")
    pairs = met.select(F.explode(F.array(F.struct(F.col("a").alias("word"), one, best("n", "word")), F.struct("word", one, best("a_n", "a")))).alias("x")).select("x.*")

    group = light.where("c != ''").groupBy("i", F.concat(p, s).alias("key")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col("word").alias("other")))).alias("all"))
    group = group.where(F.size("all") > 1).select("all", F.explode("all").alias("own"))
    alike = group.select(
        F.col("own.other").alias("word"), (F.size("all") - 1).cast("long").alias("near"), F.when(F.col("all")[0]["other"] == F.col("own.other"), F.col("all")[1]).otherwise(F.col("all")[0]).alias("best")
    )
    found = pairs.unionByName(alike).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", F.col("best.other").alias("best"), (-F.col("best.minus")).alias("best_n"))


def _roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of forms (word, form): where following the forms ends, by doubling the steps taken; no chain has more than ``longest`` steps."""
    now = forms.select("word", F.col("form").alias("root"))
    steps = 1
    while steps < longest:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        last, now = now, stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        if steps > 1:
            discard(last)
        steps *= 2
    return now


def spelling_forms(words: DataFrame, *, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n; each once) of ``occurrences`` at least.

    form: the near word of largest n (ties: smallest), if its n is ``ratio`` times the word's at least,
    else null; root: where following the forms ends, the word itself if it has none. Each form has
    ratio times the occurrences of the word before, which bounds the chains. No words give no rows.
    """
    kept = stored(words.where((F.col("n") >= occurrences) & F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")))
    near = kept.join(neighbours(kept), "word", "left")
    is_form = F.col("best_n") >= F.col("n") * ratio
    formed = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    discard(kept)
    most = formed.agg(F.max("form_n").alias("n")).first()["n"]
    longest = 0 if most is None else 1 + int(math.log(max(most / occurrences, 1), ratio))
    roots = _roots(formed.where("form IS NOT NULL"), longest)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(word_counts(table(spark, sf_dir, "documents"), drop_every=DROP_EVERY))
