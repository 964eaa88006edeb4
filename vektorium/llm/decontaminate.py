"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark windows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, worker_cache

#: Upper-case ASCII becomes lower case; ASCII that is neither letter nor digit becomes a space.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Benchmark text behind one automaton, over words: it has three nodes for each word of each window,
#: some thirty for a word of the text. A larger benchmark is dealt over several automata, used one by one.
AUTOMATON_BYTES = 1 << 20
#: Words are numbered in this base; its third power is more than AUTOMATON_BYTES has words.
BASE = 100
#: A benchmark is a stated query set; beyond this size it is refused rather than collected.
BENCHMARK_BYTES = 64 << 20

RESULT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"


def words(text: str | None) -> list[str]:
    """The normalised words of a text; none for null."""
    return text.encode().translate(_FOLD).decode().split(" ") if text else []


def _split(text: str | None) -> list[str]:
    return [w for w in words(text) if w]


def _sorted(ids) -> list[str | None]:
    """Ids in order, a null one last."""
    return sorted(ids, key=lambda i: (i is None, i or ""))


def shards_of(items: list[tuple[str | None, str | None]], window: int, bound: int) -> list[list[tuple[tuple[str, ...], tuple[str | None, ...]]]]:
    """Patterns (words, ids of the items that hold them), dealt so that no shard covers more than bound bytes of items."""
    shards, size = [{}], 0
    for item, text in sorted(items, key=lambda x: (x[0] is None, x[0] or "")):
        ws = _split(text)
        if not ws:
            continue
        cost = sum(map(len, ws)) + len(ws)
        if size and size + cost > bound:
            shards.append({})
            size = 0
        size += cost
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1):
            shards[-1].setdefault(tuple(ws[i : i + n]), set()).add(item)
    return [[(p, tuple(_sorted(ids))) for p, ids in s.items()] for s in shards if s]


def _code(k: int) -> str:
    """A number below BASE ** 3 as three letters, each of a place of its own, so that no code is found askew."""
    return chr(1 + k // BASE**2) + chr(1 + BASE + k // BASE % BASE) + chr(1 + 2 * BASE + k % BASE)


def _automaton(shard):
    """A code for each of the shard's words, and the automaton over codes, whose nodes have BASE branches at most."""
    import ahocorasick

    codes: dict[str, str] = {}
    a = ahocorasick.Automaton()
    for pattern, ids in shard:
        a.add_word("".join([codes.setdefault(w, _code(len(codes))) for w in pattern]), (len(pattern), ids))
    a.make_automaton()
    return codes, a


def scan(text: str | None, automata) -> tuple[int, int, list[str | None], list[tuple[int, int]]]:
    """Words, words hit, items hit and the hit passages as offsets into the original text."""
    ws = _split(text)
    ranges, items = [], set()
    for codes, a in automata:
        for end, (n, ids) in a.iter("".join([codes.get(w, "\0\0\0") for w in ws])):
            end = (end + 1) // 3
            ranges.append((end - n, end))
            items.update(ids)
    if not ranges:
        return len(ws), 0, [], []
    joined: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if joined and lo <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], hi)
        else:
            joined.append([lo, hi])
    place = [m.span() for m in _WORD.finditer(text)]
    return (
        len(ws),
        sum(hi - lo for lo, hi in joined),
        _sorted(items),
        [(place[lo][0], place[hi - 1][1]) for lo, hi in joined],
    )


def hits(
    spark: SparkSession,
    benchmark: DataFrame,
    text: Column | str = "text",
    *,
    window: int = 10,
    item_col: str = "item_id",
    item_text: str = "text",
    automaton_bytes: int = AUTOMATON_BYTES,
) -> Column:
    """A struct column (RESULT) of what of the benchmark occurs in text.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. Null
    and empty texts have no words and no hits, null and empty items no windows; items of equal text
    all count; items with a null id count as one, which item_ids has as a null at its end; an empty
    benchmark hits nothing, an empty table of documents stays empty. Texts of any length are read
    whole; repeated rows get equal results. The benchmark is measured before it is collected.
    The text is scanned once for each automaton, and there is one up to AUTOMATON_BYTES of items.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    if size > BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes; split it into sets of {BENCHMARK_BYTES} at most")
    shards = shards_of([(r["i"], r["t"]) for r in items.collect()], window, automaton_bytes)
    held = spark.sparkContext.broadcast(shards)
    key = uuid.uuid4().hex

    @F.pandas_udf(RESULT)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def automata():
            if len(held.value) == 1:
                yield worker_cache("automaton", key, lambda: _automaton(held.value[0]))
            else:
                yield from map(_automaton, held.value)

        for texts in batches:
            texts = [t if isinstance(t, str) else None for t in texts]
            if len(held.value) <= 1:
                one = list(automata()) if held.value else []
                rows = [scan(t, one) for t in texts]
            else:
                rows = _merged(texts, automata())
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "item_ids", "spans"])

    return find(F.col(text) if isinstance(text, str) else text)


def _merged(texts, automata):
    """As scan() by all automata; only one of them is in memory at a time."""
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for a in automata:
        for k, t in enumerate(texts):
            _, _, ids, spans = scan(t, [a])
            items[k].update(ids)
            ranges[k] += spans
    rows = []
    for t, ids, spans in zip(texts, items, ranges, strict=True):
        place = [m.span() for m in _WORD.finditer(t or "")]
        hit = [any(lo <= a and b <= hi for lo, hi in spans) for a, b in place]
        out, open_ = [], False
        for (a, b), h in zip(place, hit, strict=True):
            if h and open_:
                out[-1] = (out[-1][0], b)
            elif h:
                out.append((a, b))
            open_ = h
        rows.append((len(place), sum(hit), _sorted(ids), out))
    return rows


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents in which a window of the benchmark occurs; all columns stay."""
    found = "__v_found"
    return docs.withColumn(found, hits(spark, benchmark, **options)).where(F.col(f"{found}.n_hit") == 0).drop(found)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", hits(spark, table(spark, sf_dir, "benchmark")).alias("f"))
    return found.select(
        "doc_id",
        "f.n_words",
        "f.n_hit",
        F.size("f.item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "f.item_ids"), 256).alias("items_sha256"),
        (F.col("f.n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i + 1:i + least(10, len(w))], ' ') AS g
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
