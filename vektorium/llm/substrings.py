"""Substring dedup over sliding spans of consecutive sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, is_small, keyed, stored, table

#: A span is the shortest run from a sentence on of so many sentences and so many words.
SENTENCES, WORDS = 3, 15
#: A sentence ends at a full stop, question or exclamation mark before white space, or at a line's end.
_SENTENCE = re.compile(r"\S+(?:(?<![.!?])[^\S\n]+\S+)*")
_WORD = re.compile(r"\S+")
#: A sentence of more words also ends after each word that its own letters mark, about one in EVERY, and
#: GAP words after the last end. Ends by content fall alike in every copy, wherever it begins.
LONGEST, EVERY, GAP = 15, 6, 24


def marked(word: str) -> bool:
    return (ord(word[0]) + 3 * ord(word[-1]) + 5 * len(word)) % EVERY == 0


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Offsets of the sentences, without the white space between them."""
    found = []
    for m in _SENTENCE.finditer(text or ""):
        a, b = m.span()
        if b - a <= 2 * LONGEST or len(m[0].split()) <= LONGEST:
            found.append((a, b))
            continue
        begin, n = a, 0
        for w in _WORD.finditer(text, a, b):
            begin, n = (begin if n else w.start()), n + 1
            if n == GAP or marked(w[0]):
                found.append((begin, w.end()))
                n = 0
        if n:
            found.append((begin, b))
    return found


def spans(text: str | None, n_sentences: int = SENTENCES, n_words: int = WORDS) -> list[tuple[int, int, int, int]]:
    """(first sentence, one past the last, two hashes of the words) of each span."""
    import xxhash

    parts = [text[a:b].split() for a, b in sentences(text)]
    words = [len(p) for p in parts]
    joined = [" ".join(p) for p in parts]
    out, end, held = [], 0, 0
    for k in range(len(parts)):
        while end < len(parts) and (end - k < n_sentences or held < n_words):
            held += words[end]
            end += 1
        if end - k < n_sentences or held < n_words:
            break
        raw = xxhash.xxh3_128_digest("\n".join(joined[k:end]).encode())
        out.append((k, end, int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:12], "little", signed=True)))
        held -= words[k]
    return out


_SPANS = "h long, g int, doc long, sub long, lo int, hi int, again boolean"


def _spans_of(n_sentences: int, n_words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, subs, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            rows = [[] for _ in range(7)]
            for doc, sub, text in zip(docs, subs, texts, strict=True):
                seen = set()
                for lo, hi, h, g in spans(text.as_py(), n_sentences, n_words):
                    for r, x in zip(rows, (h, g, doc, sub, lo, hi, (h, g) in seen), strict=True):
                        r.append(x)
                    seen.add((h, g))
                if len(rows[0]) >= 100_000:
                    yield _batch(rows)
                    rows = [[] for _ in range(7)]
            if rows[0]:
                yield _batch(rows)

    return make


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], _SPANS.replace(",", "").split()[::2])


def repeated_spans(found: DataFrame) -> DataFrame:
    """(doc, sub, lo, hi, first): sentences lo to hi - 1 repeat a span that document ``first``, or if that is null the same document, has earlier.

    found: a stored table of spans. A span's first place is in the smallest document id, there in the
    smallest text number, and in that text the first position. A document gives one row for each
    span to the counts, which are pre-aggregated, so no group of copies meets in one task; the join
    deals hot spans anew where they are many.
    """
    within = found.where("again").select("doc", "sub", "lo", "hi", F.lit(None).cast("long").alias("first"))
    one = found.where("NOT again")
    if found.where("sub != 0").isEmpty():  # ids alone tell documents apart: longs, which need no sort to be aggregated
        first = one.groupBy("h", "g").agg(F.min("doc").alias("fd"), F.max("doc").alias("ld")).where("fd != ld").select("h", "g", "fd")
        other = F.col("doc") != F.col("fd")
    else:
        place = F.struct("doc", "sub")
        first = one.groupBy("h", "g").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f != l").select("h", "g", F.col("f.doc").alias("fd"), F.col("f.sub").alias("fs"))
        other = (F.col("doc") != F.col("fd")) | (F.col("sub") != F.col("fs"))
    later = one.select("h", "g", "doc", "sub", "lo", "hi").join(first, ["h", "g"]).where(other)
    return later.select("doc", "sub", "lo", "hi", F.col("fd").alias("first")).union(within)


def cuts(found: DataFrame) -> DataFrame:
    """A row for each document with repeats: the ranges that cover its repeated sentences, sorted, and the other documents where they were first."""
    other = F.when(F.col("first") != F.col("doc"), F.col("first"))
    return found.groupBy("doc", "sub").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"), F.sort_array(F.collect_set(other)).alias("firsts"))


def _without(text: Column, ranges: Column) -> Column:
    @F.pandas_udf("text string, n_removed int")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = []
            for t, rs in zip(texts, found, strict=True):
                t = t if isinstance(t, str) else None
                rows.append(without(t, [] if rs is None else [(r["lo"], r["hi"]) for r in rs]))
            yield pd.DataFrame(rows, columns=["text", "n_removed"])

    return apply(text, ranges)


def without(text: str | None, ranges: list[tuple[int, int]]) -> tuple[str | None, int]:
    """The text without the sentences of the ranges and the white space after them; how many it lost."""
    if not ranges:
        return text, 0
    where = sentences(text)
    gone = np.zeros(len(where) + 1, dtype=bool)
    for lo, hi in ranges:
        gone[lo:hi] = True
    starts = [a for a, _ in where] + [len(text)]
    keep = [text[: starts[0]]] + [text[starts[k] : starts[k + 1]] for k in range(len(where)) if not gone[k]]
    return "".join(keep), int(gone.sum())


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_sentences: int = SENTENCES, n_words: int = WORDS) -> DataFrame:
    """(doc_id, text, n_removed, first_doc_ids) for each row of docs; other columns are left out.

    Sentences that a non-first repeated span covers are removed; a text without any stays as it is.
    first_doc_ids: the other documents where removed spans were first. Rows of one id with different
    texts are different documents, in the order of a hash of the text; rows of one id and equal text
    are the same document and get the same result. Rows with a null id, null, empty and short texts
    have no spans and stay as they are, null as null; an empty table gives no rows; texts of any
    length are read whole. Spans are made once, and stored. What is to be removed is broadcast if
    it is measured to be small, else joined by a shuffle.
    """
    own = keyed(docs, id_col, text)
    rows = own.select(F.col("__v_doc").alias("doc"), F.col("__v_sub").alias("sub"), F.col(text).alias("text"))
    found = stored(rows.where("doc IS NOT NULL AND text IS NOT NULL").mapInArrow(_spans_of(n_sentences, n_words), _SPANS))
    ranges = cut(cuts(repeated_spans(found)))
    discard(found)
    side = F.broadcast(ranges) if is_small(ranges, 72 + 32 * F.size("ranges") + 16 * F.size("firsts")) else ranges
    out = rows.join(side, ["doc", "sub"], "left").select(F.col("doc").alias("doc_id"), "firsts", _without(F.col("text"), F.col("ranges")).alias("w"))
    return out.select("doc_id", "w.text", "w.n_removed", F.coalesce("firsts", F.array().cast("array<long>")).alias("first_doc_ids"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.withColumn("first_doc_ids", F.array_join(F.col("first_doc_ids").cast("array<string>"), ","))


ORACLE = r"""
WITH d AS (SELECT doc_id, text, regexp_extract(text, '^\s*') AS head, regexp_extract_all(text, '\S+\s*') AS ws FROM documents),
w AS (SELECT doc_id, i, ws[i] AS piece, trim(ws[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x, i = len(ws) AS last
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
e AS (SELECT *, last OR regexp_matches(x, '[.!?]$') OR contains(piece, chr(10)) AS ends FROM w),
t AS (SELECT *, sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) - CAST(ends AS INTEGER) AS sent FROM e),
u AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sent) > 15 AS long FROM t),
v AS (SELECT *, ends OR (long AND (ord(x) + 3*ord(right(x, 1)) + 5*length(x)) % 6 = 0) AS cut FROM u),
y AS (SELECT *, sum(CAST(cut AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) - CAST(cut AS INTEGER) AS run FROM v),
z AS (SELECT *, cut OR (long AND row_number() OVER (PARTITION BY doc_id, run ORDER BY i) % 24 = 0) AS stop FROM y),
q AS (SELECT *, 1 + sum(CAST(stop AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) - CAST(stop AS INTEGER) AS k FROM z),
s AS (SELECT doc_id, CAST(k AS BIGINT) AS i, string_agg(piece, '' ORDER BY i) AS piece, string_agg(x, ' ' ORDER BY i) AS x, count(*) AS own FROM q GROUP BY doc_id, k),
n AS (SELECT *, CAST(sum(own) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM s),
r AS (SELECT a.doc_id, a.i AS lo, min(b.i) AS hi FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i + 2 AND a.i + 14 AND b.upto - a.upto + a.own >= 15 GROUP BY a.doc_id, a.i),
g AS (SELECT r.doc_id, lo, hi, string_agg(x, chr(10) ORDER BY i) AS t FROM r JOIN n ON n.doc_id = r.doc_id AND n.i BETWEEN lo AND hi GROUP BY r.doc_id, lo, hi),
f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY doc_id, lo) AS first_doc, row_number() OVER (PARTITION BY t ORDER BY doc_id, lo) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM f WHERE k > 1),
o AS (SELECT doc_id, list_sort(list(DISTINCT first_doc)) AS first_doc_ids FROM f WHERE k > 1 AND first_doc <> doc_id GROUP BY doc_id),
k AS (SELECT n.doc_id, string_agg(piece, '' ORDER BY n.i) FILTER (c.i IS NULL) AS kept, count(c.i) AS gone FROM n LEFT JOIN c ON c.doc_id = n.doc_id AND c.i = n.i GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(gone, 0) = 0 THEN text ELSE head || coalesce(kept, '') END AS text, CAST(coalesce(gone, 0) AS INTEGER) AS n_removed, coalesce(array_to_string(first_doc_ids, ','), '') AS first_doc_ids
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id
"""
