"""Token counts by a two-tier map-side lookup of pre-token lengths."""

from __future__ import annotations

import os
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, worker_cache

MODEL = "word_bpe_49k.json"
#: The pre-tokenizer of the model, a fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of other characters go to the library whole: there the Unicode tables of the two sides may differ.
_ODD = "[^\\n\\r\\t -~ -ԯ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]"
#: The first tier is learnt from so many documents, and holds so many pre-tokens. Counts don't depend on it.
SAMPLE_DOCS, FREQUENT = 512, 16_384
#: The second tier, in each worker, starts anew beyond so many pre-tokens.
CACHE = 300_000
#: Pre-tokens of so many characters of text are held at once.
CHUNK = 2_000_000


class Counter5:
    """The library's tokenizer behind a table of pre-token lengths."""

    def __init__(self, path: str, frequent: dict[str, int]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = regex.compile("|".join([_ODD, *map(regex.escape, specials)]))
        self.split = regex.compile(_SPLIT)
        self.frequent = frequent
        self.cache: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.split.findall(text.replace("Σ", "σ").lower())

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        at = 0
        while at < len(texts):
            held, size = {}, 0
            while at < len(texts) and size < CHUNK:
                if text := texts[at]:
                    size += len(text)
                    if self.odd.search(text):
                        out[at] = self.whole([text])[0]
                    else:
                        held[at] = self.pretokens(text)
                at += 1
            first, second = self.frequent, self.cache
            missing = {p for ps in held.values() for p in set(ps) if p not in first and p not in second}
            if missing:
                if len(second) + len(missing) > CACHE:
                    second.clear()
                    missing = {p for ps in held.values() for p in set(ps) if p not in first}
                names = list(missing)
                second.update(zip(names, self.whole(names), strict=True))
            for k, ps in held.items():
                out[k] = sum([first[p] if p in first else second[p] for p in ps])
        return out


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_count(
    spark: SparkSession, docs: DataFrame, text: str = "text", *, model: str = MODEL, path: str | None = None, sample_docs: int = SAMPLE_DOCS, frequent: int = FREQUENT
) -> Column:
    """A long column: the tokens of the whole text as the model's library counts them, without added special tokens.

    Null and empty texts have none; repeated rows have each their count, and an empty table has no rows.
    A text is never cut or truncated, however long it is. Texts that hold a special token's string, or characters outside
    the scripts of _ODD, are encoded whole by the library; all others are cut into pre-tokens whose
    lengths add up. Lengths come from a broadcast table of at most ``frequent`` pre-tokens, learnt
    from about ``sample_docs`` documents (bounded, and without effect on any count), then from the
    worker's cache, then from the library. No pre-token is shuffled.
    """
    path = path or _path(model)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, seen = Counter5(path, {}), Counter()
        for b in batches:
            for t in b["t"]:
                if t and not counter.odd.search(t):
                    seen.update(counter.pretokens(t))
        best = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:frequent]]
        if best:
            yield pd.DataFrame({"p": best, "n": counter.whole(best)})

    rows = docs.count()
    few = docs.select(F.col(text).alias("t")).where("t IS NOT NULL")
    if rows > sample_docs:
        few = few.sample(min(1.0, 2 * sample_docs / rows), seed=7).limit(sample_docs)
    common = {r["p"]: r["n"] for r in few.coalesce(1).mapInPandas(learn, "p string, n long").collect()}
    held = spark.sparkContext.broadcast(common)
    key = uuid.uuid4().hex

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = worker_cache("tokens", key, lambda: Counter5(path, held.value))
        for texts in batches:
            yield pd.Series(counter.count([t if isinstance(t, str) else None for t in texts]), dtype="int64")

    return count(F.col(text))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_tokens", token_count(spark, docs))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
