"""Stupid-backoff language-model scores from n-gram counts of the whole corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality import word_array

#: Order of the model, factor of a step back, and the least count of a kept n-gram of two or more words.
ORDER, BACKOFF, LEAST = 3, 0.4, 2
#: Text that one chunk of documents holds on average, and n-grams that one bucket of the count table holds at most on average.
CHUNK_BYTES, BUCKET_GRAMS = 16 << 20, 2_000_000

#: Bits of an n-gram's hash. In chunks of CHUNK_BYTES, gaps between sorted hashes then take five bytes.
HASH_BITS = 58

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text, and for each n up to order the hash of the n-gram that ends at each word of all texts; 0 where the text is too young."""
    import xxhash

    ids: dict[bytes, int] = {}
    sizes, codes = np.zeros(len(texts), np.int64), []
    for k, t in enumerate(texts):
        ws = t.encode().split() if t else []
        sizes[k] = len(ws)
        codes += [ids.setdefault(w, len(ids)) for w in ws]
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in ids], np.uint64)
    word = names[np.array(codes, np.int64)] if codes else np.empty(0, np.uint64)
    at = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = [_scramble(word | np.uint64(1))]
    for n in range(2, order + 1):
        h = np.zeros(len(word), np.uint64)
        h[1:] = _scramble(found[-1][:-1] * _MIX + word[1:] + np.uint64(n))
        h[at < n - 1] = 0
        found.append(h)
    return sizes, [h >> np.uint64(64 - HASH_BITS) for h in found]


def distinct(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams, sorted, and their counts; 0 stands for none."""
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    return (keys[1:], counts[1:]) if len(keys) and keys[0] == 0 else (keys, counts)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in as few bytes each as the largest takes."""
    if not len(keys):
        return b"\1"
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gaps[1:].max()).bit_length() + 7) // 8) if len(keys) > 1 else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if len(raw) == 1:
        return np.empty(0, np.uint64)
    width, first = raw[0], np.frombuffer(raw[1:9], "<u8")
    gaps = np.zeros(((len(raw) - 9) // width, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(raw[9:], np.uint8).reshape(-1, width)
    return np.cumsum(np.concatenate([first, gaps.view("<u8").ravel()]), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in one byte each, the larger ones after them in eight."""
    big = counts > 254
    return np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype("<i8").tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[n:], "<i8")
    return counts


def located(found: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different n-grams, sorted, and where among them each one is, from 1; 0 for none."""
    keys, at = np.unique(np.concatenate([np.zeros(1, np.uint64), *found]), return_inverse=True)
    return keys[1:], np.split(at[1:], np.cumsum([len(h) for h in found])[:-1])


def chunk_scores(sizes: np.ndarray, places: list[np.ndarray], counts: np.ndarray, total: int, backoff: float, least: int) -> np.ndarray:
    """The sum of log10 scores of each text, given the corpus counts of all its n-grams."""
    counts = np.concatenate([[0], counts])

    def count(at: np.ndarray, n: int) -> np.ndarray:
        c = counts[at]
        return np.where(c < least, 0, c) if n > 1 else c

    by_order = [count(at, n) for n, at in enumerate(places, 1)]
    score = np.log10(np.maximum(by_order[0], 1) / max(total, 1))
    for n in range(2, len(places) + 1):
        c = by_order[n - 1]
        context = np.concatenate([[1], by_order[n - 2][:-1]])[: len(c)]
        # a word so early in its text has no n-gram of this order: its score stays, without a step back
        back = np.where(places[n - 1] == 0, score, score + np.log10(backoff))
        score = np.where(c > 0, np.log10(np.maximum(c, 1) / np.maximum(context, 1)), back)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=score, minlength=len(sizes))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """(doc_id, n_words, score, mean_score) for each document, by the counts of n-grams in all of them.

    Words are runs of characters other than ASCII blanks. The score of a word is count(n-gram) / count(context) for the
    longest n-gram that ends at it and is in the table, times ``backoff`` for each order skipped, and
    count(word) / words in the end; n-grams don't reach over a text's start. The table holds every
    word, and n-grams of more words found ``least`` times or more. score sums log10 over the text.
    Null, empty and blank texts score 0 with a null mean; rows with a null id are scored too, repeated
    rows each count and score; an empty table gives no rows. A text is never cut: a very long one is a
    row of its chunk, whose memory it shares.

    Documents are dealt by a hash of their text and id to chunks, whose number grows with the bytes.
    Each chunk counts its own n-grams first and gives each of them once to the count table, which is
    partitioned by hash into buckets, in packed rows: so a hot n-gram has one entry for a chunk at
    most. A bucket adds up its chunks' counts and answers each chunk with the totals of its n-grams.
    The chunk joins these to the n-grams of its documents and sums by document.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size(word_array(F.coalesce("text", F.lit(""))))).alias("words")).first()
    total_bytes, words = size["bytes"] or 0, size["words"] or 0
    chunks = max(1, -(-total_bytes // chunk_bytes))
    buckets = max(1, -(-words * order // bucket_grams))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def tally(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, found = grams(list(pdf["text"]), order)
        keys, counts = distinct(found)
        cut = _cut(keys, buckets)
        rows = [(b, key[0], pack(keys[lo:hi]), pack_counts(counts[lo:hi])) for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if hi > lo]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "counts"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(k) for k in pdf["keys"]]
        own = [unpack_counts(c, len(k)) for c, k in zip(pdf["counts"], parts, strict=True)]
        _, back = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.bincount(back, weights=np.concatenate(own)).astype(np.int64)[back]
        ends = np.cumsum([len(p) for p in parts])
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "totals": [pack_counts(s) for s in np.split(sums, ends[:-1])]})

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sizes, found = grams(list(left["text"]), order)
        keys, places = located(found)
        cut = _cut(keys, buckets)
        counts = np.zeros(len(keys), np.int64)
        for b, raw in zip(right["bucket"], right["totals"], strict=True):
            counts[cut[b] : cut[b + 1]] = unpack_counts(raw, cut[b + 1] - cut[b])
        s = chunk_scores(sizes, places, counts, words, backoff, least)
        return pd.DataFrame({"doc_id": left["doc_id"].astype("Int64"), "n_words": sizes, "score": s, "mean_score": np.where(sizes > 0, s / np.maximum(sizes, 1), np.nan)})

    counted = dealt.groupBy("chunk").applyInPandas(tally, "bucket int, chunk long, keys binary, counts binary")
    totals = counted.groupBy("bucket").applyInPandas(total, "chunk long, bucket int, totals binary")
    scored = dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInPandas(score, "doc_id long, n_words long, score double, mean_score double")
    return scored.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("mean_score")))


def _cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where in the sorted keys each bucket, an equal range of hashes, begins, and the end."""
    step = (1 << HASH_BITS) // buckets
    return np.append(np.searchsorted(keys, np.array([b * step for b in range(buckets)], np.uint64)), len(keys))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS a, CASE WHEN i > 1 THEN ws[i - 1] END AS b, CASE WHEN i > 2 THEN ws[i - 2] END AS c
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
n1 AS (SELECT a, count(*) AS n FROM t GROUP BY a),
n2 AS (SELECT b, a, count(*) AS n FROM t WHERE i > 1 GROUP BY b, a HAVING count(*) > 1),
n3 AS (SELECT c, b, a, count(*) AS n FROM t WHERE i > 2 GROUP BY c, b, a HAVING count(*) > 1),
s AS (SELECT t.doc_id, t.i, CAST(u.n AS DOUBLE)/(SELECT count(*) FROM t) AS s1, CAST(g2.n AS DOUBLE)/v.n AS s2, CAST(g3.n AS DOUBLE)/c2.n AS s3
      FROM t JOIN n1 u ON u.a = t.a LEFT JOIN n1 v ON v.a = t.b LEFT JOIN n2 g2 ON g2.b = t.b AND g2.a = t.a
      LEFT JOIN n2 c2 ON c2.b = t.c AND c2.a = t.b LEFT JOIN n3 g3 ON g3.c = t.c AND g3.b = t.b AND g3.a = t.a),
l AS (SELECT doc_id, log10(CASE WHEN s3 IS NOT NULL THEN s3 WHEN s2 IS NOT NULL THEN s2 ELSE s1 END)
             + CASE WHEN s3 IS NOT NULL THEN 0 ELSE (CASE WHEN i > 2 THEN 1 ELSE 0 END + CASE WHEN s2 IS NULL AND i > 1 THEN 1 ELSE 0 END)*log10(CAST(0.4 AS DOUBLE)) END AS x FROM s),
z AS (SELECT doc_id, sum(x) AS x FROM l GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(x, 0), 4) AS score, CASE WHEN len(ws) > 0 THEN round(x/len(ws), 6) END AS mean_score
FROM w LEFT JOIN z ON z.doc_id = w.doc_id
"""
