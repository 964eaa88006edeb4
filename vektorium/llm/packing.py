"""Packing of token sequences by length patterns that non-negative least squares fits to the histogram of lengths."""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, worker_cache

MODEL = "word_bpe_49k.json"
#: Tokens of a sequence, the id that ends each document, and documents of a fitted pattern at most.
CAPACITY, END, MOST = 4096, 1, 3
#: Rounds of the fit: each adds the steepest pattern of every longest length, then solves for all that are held.
ROUNDS, STEPS = 24, 120
#: Of the fitted counts, what is tried.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.0)
#: Pieces of one length that one task numbers.
NUMBERED = 4_000
#: Runs of characters without white space, and pre-tokens of them, that a worker keeps in each of two generations.
CACHE = 400_000
#: Pre-tokens that the library encodes at once.
SIDE_BY_SIDE = 20_000
#: Characters of text held at once.
CHUNK = 2_000_000

#: The pre-tokenizer of the model, a fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: How its vocabulary spells the end of a pre-token.
WORD_END = "</w>"
#: Texts of other characters go to the library whole: there the Unicode tables of the two sides may differ.
_ODD = "[^\\n\\r\\t -~ -ԯ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]"


class Encoder:
    """The library's tokenizer behind a table from runs without white space, which no token crosses, to their ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([_ODD, *map(re.escape, specials)]))
        self.split = regex.compile(_SPLIT)
        # which ids end a pre-token
        self.ending = np.array([(self.tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(self.tokenizer.get_vocab_size())])
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def of_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each part: encoded side by side, as the library takes far longer for a text than for a word."""
        out = []
        for lo in range(0, len(parts), SIDE_BY_SIDE):
            some = parts[lo : lo + SIDE_BY_SIDE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                out += [data[i:j] for i, j in zip(cuts, cuts[1:])]  # noqa: B905
            else:
                out += self.whole(some)
        return out

    def learn(self, runs: list[str]) -> None:
        split = self.split.findall
        cut = [[r] if r.isalpha() else split(r) for r in runs]
        parts, older = self.parts, self.older_parts
        missing = []
        for p in {p for ps in cut for p in ps}.difference(parts):
            if p in older:
                parts[p] = older[p]
            else:
                missing.append(p)
        parts.update(zip(missing, self.of_parts(missing), strict=True))
        self.runs.update((r, parts[ps[0]] if len(ps) == 1 else b"".join([parts[p] for p in ps])) for r, ps in zip(runs, cut, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian and of 32 bits."""
        out, held = [b""] * len(texts), {}
        for k, t in enumerate(texts):
            if not t:
                continue
            if self.odd.search(t):
                out[k] = self.whole([t])[0]
                continue
            if not t.isascii() and not unicodedata.is_normalized("NFC", t):
                t = unicodedata.normalize("NFC", t)
            held[k] = t.replace("Σ", "σ").lower().split()
        # a new generation begins when the present one is full, and the one before the last goes
        if len(self.runs) > CACHE:
            self.older, self.runs = self.runs, {}
        if len(self.parts) > CACHE:
            self.older_parts, self.parts = self.parts, {}
        runs, older, missing = self.runs, self.older, []
        for r in set().union(*held.values()).difference(runs):
            if r in older:
                runs[r] = older[r]
            else:
                missing.append(r)
        if missing:
            self.learn(missing)
        for k, rs in held.items():
            out[k] = b"".join([runs[r] for r in rs])
        return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def pieces(spark: SparkSession, text: Column | str = "text", *, capacity: int = CAPACITY, model: str = MODEL, path: str | None = None, with_ids: bool = False) -> Column:
    """A column of arrays: the pieces (piece, start, length, ids_crc32[, ids]) of each whole text's ids and the END after them.

    Null and empty texts are an END alone. Only what is longer than ``capacity`` is cut, into pieces
    of capacity ids; the last may be shorter. Texts that hold a special token's string, or
    characters outside the scripts of _ODD, are encoded whole by the library; all others run by run,
    each run once a worker.
    """
    import public_tokenizers

    path, key, end = path or public_tokenizers.path(model), uuid.uuid4().hex, np.array([END], "<u4").tobytes()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]
    ddl = "array<struct<piece:int,start:long,length:long,ids_crc32:long" + ",ids:array<int>" * with_ids + ">>"

    def cut(ids: bytes) -> list[tuple]:
        out = []
        for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
            own = ids[lo : lo + 4 * capacity]
            out.append((k, lo // 4, len(own) // 4, zlib.crc32(own)) + ((np.frombuffer(own, "<u4").astype(np.int32),) if with_ids else ()))
        return out

    @F.arrow_udf(ddl)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_cache("packing", key, lambda: Encoder(path))
        for b in batches:
            texts, found = b.to_pylist(), []
            for lo, hi in _chunks(texts):
                found += [cut(ids + end) for ids in encoder.encode(texts[lo:hi])]
            columns = list(zip(*[p for ps in found for p in ps], strict=True)) or [[] for _ in fields]
            made = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], fields=[pa.field(n, t) for n, t in fields])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), made)

    return encode(F.col(text) if isinstance(text, str) else text)


def patterns_of(present: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three lengths that are present and fill a sequence exactly: rows (a, b, c), a >= b >= c, in which 0 is no document."""
    ok, out = np.concatenate([[True], present[1:]]), []
    for a in np.flatnonzero(present):
        if a * 3 < capacity:
            continue
        b = np.arange(-(-(capacity - a) // 2), min(a, capacity - a) + 1)
        c = capacity - a - b
        b, c = b[ok[b] & ok[c]], c[ok[b] & ok[c]]
        out.append(np.stack([np.full(len(b), a), b, c], axis=1))
    return np.concatenate(out or [np.zeros((0, 3), np.int64)]).astype(np.int64)


def fit(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repeats): non-negative repeat counts, as real numbers, whose lengths come nearest to the histogram (by length, from 0) in the sense of least squares.

    All patterns of up to MOST documents are candidates. Their number goes with the square of the
    capacity, so the problem is solved over the patterns that matter: each round takes in the one of
    steepest descent for every longest length, then solves for all taken in by accelerated projected
    gradients, until no pattern would bring the fit nearer.
    """
    capacity, h = len(histogram) - 1, histogram.astype(np.float64)
    h[0] = 0
    every = patterns_of(histogram > 0, capacity)
    if not len(every):
        return every, np.zeros(0)
    firsts = np.flatnonzero(np.concatenate([[True], every[1:, 0] != every[:-1, 0]]))
    taken, x, before = np.zeros(0, np.int64), np.zeros(0), np.inf

    def covered(p: np.ndarray, x: np.ndarray) -> np.ndarray:
        got = np.bincount(p.ravel(), np.repeat(x, MOST), capacity + 1)
        got[0] = 0
        return got

    for _ in range(ROUNDS):
        rest = h - covered(every[taken], x)
        now = float(rest @ rest)
        if now > before * 0.999:
            break
        before = now
        steep = rest[every].sum(axis=1)
        top = np.maximum.reduceat(steep, firsts)
        size = np.diff(np.append(firsts, len(every)))
        at = np.flatnonzero(steep == np.repeat(top, size))
        at = at[np.unique(np.repeat(np.arange(len(firsts)), size)[at], return_index=True)[1]]
        new = np.setdiff1d(at[steep[at] > 1e-6], taken)
        if not len(new):
            break
        taken, x = np.append(taken, new), np.append(x, np.zeros(len(new)))
        p = every[taken]
        v = np.ones(len(p))
        for _ in range(12):  # the largest eigenvalue, which bounds the steps
            v = covered(p, v)[p].sum(axis=1)
            bound = np.linalg.norm(v)
            v /= bound
        y, t = x, 1.0
        for _ in range(STEPS):
            z = np.maximum(y + (h - covered(p, y))[p].sum(axis=1) / (1.02 * bound), 0)
            s = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, x, t = z + (t - 1) / s * (z - x), z, s
        taken, x = taken[x > 1e-3], x[x > 1e-3]
    return every[taken], x


def best_fit(left: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: documents}) that pack what is left of a histogram: lengths from the longest on, each document into the fullest sequence that takes it.

    Sequences of like content are one entry, and a length's documents fill as many of them at once
    as they can, so the work and the entries go with the number of lengths, not of documents.
    """
    capacity = len(left) - 1
    room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    spaces: list[int] = []  # sorted
    def put(space: int, times: int, content: dict[int, int]) -> None:
        if space not in room:
            room[space] = []
            insort(spaces, space)
        room[space].append((times, content))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            k = bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                times, content = room[space].pop()
                if not room[space]:
                    del room[space], spaces[k]
            else:
                space, times, content = capacity, n, {}
            each = min(space // length, n)
            full = min(times, n // each)
            if times > full and content:
                put(space, times - full, content)
            put(space - each * length, full, content | {length: each})
            n -= full * each
    return [x for xs in room.values() for x in xs]


def plan(histogram: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: documents}): patterns that use up a histogram of lengths (by length, from 0) in few sequences.

    The fitted repeat counts are rounded and used, the largest first, as far as there are documents
    for them; what is left is packed by best fit. Patterns may take short documents that long
    ones would need, so the counts are also tried at the SHARES of them; the fewest sequences win.
    """
    found, repeats = fit(histogram)
    contents = [{n: p.count(n) for n in p if n} for p in found.tolist()]
    best: list[tuple[int, dict[int, int]]] = []
    for share in SHARES:
        left, out = histogram.astype(np.int64).copy(), []
        for k in np.argsort(-repeats, kind="stable"):
            times = min(int(share * repeats[k] + 0.5), *(int(left[n]) // m for n, m in contents[k].items()))
            if times:
                out.append((times, contents[k]))
                for n, m in contents[k].items():
                    left[n] -= times * m
        out += best_fit(left)
        if not best or sum(t for t, _ in out) < sum(t for t, _ in best):
            best = out
    return best


def pack(rows: DataFrame, length: str = "length", *, capacity: int = CAPACITY) -> DataFrame:
    """rows with ``sequence_id``, numbers from 0, and ``offset``: packed into sequences of at most ``capacity``, each gapless from 0. Repeated rows are rows of their own; no rows give none.

    Only the histogram of lengths, capacity rows at most, reaches the driver, where plan() finds how
    often each pattern occurs. The rows of each length are then numbered, NUMBERED of them a task
    whatever their keys, and a row's number tells its place in the plan, whose size goes with
    the number of lengths. A length that isn't between 1 and capacity raises a ValueError.
    """
    held = stored(rows.withColumn("__v_row", F.monotonically_increasing_id()).withColumn("__v_len", F.col(length).cast("long")))
    counts = held.groupBy("__v_len").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / NUMBERED).alias("buckets")).limit(capacity + 2).collect()
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts:
        if r["__v_len"] is None or not 0 < r["__v_len"] <= capacity:
            raise ValueError(f"a length of {r['__v_len']} doesn't fit into sequences of {capacity}")
        histogram[r["__v_len"]] = r["n"]
    first = np.concatenate([[0], np.cumsum(histogram)])

    entries, sequence = [], 0  # (length, first sequence, offset of its first document, documents a sequence, documents)
    for times, content in plan(histogram):
        at = 0
        for n, m in content.items():
            entries.append((n, sequence, at, m, times * m))
            at += n * m
        sequence += times
    table_ = np.array(sorted(entries), np.int64).reshape(-1, 5)
    starts = np.concatenate([[0], np.cumsum(table_[:, 4])])[:-1]
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((starts, table_))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        starts, known = sent.value
        for b in batches:
            number = b.to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(number):
                yield pa.StructArray.from_arrays([pa.array([], pa.int64())] * 2, ["sequence_id", "offset"])
                continue
            k = np.searchsorted(starts, number, side="right") - 1
            n, sequence, at, m, _ = known[k].T
            x = number - starts[k]
            yield pa.StructArray.from_arrays([pa.array(sequence + x // m), pa.array(at + x % m * n)], ["sequence_id", "offset"])

    lengths = spark.createDataFrame([(r["__v_len"], int(first[r["__v_len"]]), r["buckets"]) for r in counts], "__v_len long, __v_first long, __v_buckets long")
    dealt = held.join(F.broadcast(lengths), "__v_len").withColumn("__v_bucket", F.pmod(F.xxhash64("__v_row"), F.col("__v_buckets")))
    ahead = Window.partitionBy("__v_len").orderBy("__v_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__v_len", "__v_bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("__v_ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("__v_len", "__v_bucket").orderBy("__v_row")) - 1
    numbered = dealt.withColumn("__v_own", own).join(sizes, ["__v_len", "__v_bucket"])
    placed = numbered.withColumn("__v_at", place(F.col("__v_first") + F.col("__v_ahead") + F.col("__v_own")))
    return placed.select(*rows.columns, F.col("__v_at.sequence_id").alias("sequence_id"), F.col("__v_at.offset").alias("offset"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs.select("doc_id", F.explode(pieces(spark, "text")).alias("p")).select("doc_id", "p.*"))
