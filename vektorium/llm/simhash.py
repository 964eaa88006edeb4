"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, is_small, table
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Buckets of up to so many fingerprints are compared pairwise; larger ones are linked through midpoints.
BUCKET = 64
#: Widths of the three segments of a fingerprint, none wider than the 23 bits of the code.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the perfect binary Golay code [23, 12, 7], a fixed value.
GENERATOR = 0b101011100011

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_hashes(text: str | None, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of n words, or of all words if there are fewer; none for a text without words."""
    import xxhash

    ws = text.encode().translate(_LOWER).split() if text else []
    if not ws:
        return np.empty(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    if len(ws) < n:
        return np.array([h(b" ".join(ws), seed)], dtype=np.uint64)
    return np.array([h(b" ".join(s), seed) for s in zip(*(ws[i:] for i in range(n)))], dtype=np.uint64)  # noqa: B905


def fingerprint(text: str | None) -> int:
    """A bit is set if it is in over half the hashes; no words give zero. As a signed 64-bit number."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        counts += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t if isinstance(t, str) else None) for t in texts], dtype="int64")

    return prints(text)


class Golay:
    """Decoding of 23-bit words to the 12-bit index of the only codeword within three bits."""

    def __init__(self):
        rest = [1 << i for i in range(11)]  # x^i modulo the generator
        for _ in range(11, 23):
            x = rest[-1] << 1
            rest.append(x ^ GENERATOR if x >> 11 else x)
        byte = np.arange(256)
        self.tables = []
        for k in range(3):
            t = np.zeros(256, dtype=np.int32)
            for j in range(8):
                if 8 * k + j < 23:
                    t ^= np.where(byte >> j & 1, rest[8 * k + j], 0).astype(np.int32)
            self.tables.append(t)
        self.error = np.zeros(2048, dtype=np.int32)
        one = [1 << i for i in range(23)]
        patterns = np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])], dtype=np.int32)
        self.error[self.syndrome(patterns)] = patterns

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.tables[0][x & 255] ^ self.tables[1][x >> 8 & 255] ^ self.tables[2][x >> 16 & 127]

    def index(self, x: np.ndarray) -> np.ndarray:
        return (x ^ self.error[self.syndrome(x)]) >> 11

    def near(self, x: np.ndarray, bits: int) -> np.ndarray:
        """A row for each word: the indices of all words within one bit, each once, then -1."""
        flips = np.array([0, *(1 << i for i in range(bits))], dtype=np.int32)
        found = np.sort(self.index(x[:, None].astype(np.int32) ^ flips), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def segments(f: np.ndarray) -> list[np.ndarray]:
    f, out = f.astype(np.int64).view(np.uint64), []
    for bits in SEGMENTS:
        out.append((f & np.uint64((1 << bits) - 1)).astype(np.int64))
        f = f >> np.uint64(bits)
    return out


def keys_of(f: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(position in f, key): a key is one segment as it is and a nearby codeword's index of the next segment.

    Two fingerprints at two bits or fewer have a segment without errors, for there are three. In the
    next segment they differ in two bits at most, so some word is within one bit of both, and decodes
    to an index that both have among their keys.
    """
    parts, at, keys = segments(f), [], []
    for k in range(3):
        near = code.near(parts[(k + 1) % 3], SEGMENTS[(k + 1) % 3])
        rows, cols = np.nonzero(near >= 0)
        at.append(rows)
        keys.append((np.int64(k) << 60) | (parts[k][rows] << 12) | near[rows, cols])
    return np.concatenate(at), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for b in batches:
        f, i = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for lo in range(0, len(f), 20_000):
            at, keys = keys_of(f[lo : lo + 20_000], code)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f[lo + at]), pa.array(i[lo + at])], ["k", "f", "i"])


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between the ids of distinct fingerprints (f, i) that join all those at DISTANCE bits or fewer.

    Keys held once are dropped after a pre-aggregated count. Buckets of up to BUCKET fingerprints
    are joined with themselves and verified. In larger buckets each fingerprint is dealt to the 65
    words within one bit of it: fingerprints at two bits or fewer meet at a word between them, and
    all that meet are two bits apart at most, so linking each to the smallest id there loses no link.
    """
    keyed = prints.mapInArrow(_keyed, "k long, f long, i long")
    sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, "k"))
    few = shared.where(F.col("n") <= BUCKET).select("k", "f", "i")
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.i") < F.col("b.i")) & (F.bit_count(F.col("a.f").bitwiseXOR(F.col("b.f"))) <= DISTANCE))
    hot = shared.where(F.col("n") > BUCKET).groupBy("f").agg(F.min("i").alias("i"))
    words = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda j: F.when(j < 0, F.col("f")).otherwise(F.col("f").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))))
    between = hot.select("i", F.explode(words).alias("z"))
    first = between.groupBy("z").agg(F.min("i").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    stars = between.join(first, "z").where("i != m").select(F.col("m").alias("u"), F.col("i").alias("v"))
    return pairs.select(F.col("a.i").alias("u"), F.col("b.i").alias("v")).union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a long, component_id) for each document.

    Documents are linked if their fingerprints differ in DISTANCE bits or fewer; component_id is the
    smallest id reachable. Null, empty and blank texts have fingerprint zero and are linked like any
    other. Rows with a null id keep a fingerprint but are linked to none and have a null component;
    repeated rows give repeated results; an empty table gives none. A very long text is hashed as a
    whole, by one task. Equal fingerprints are one node, so a group of copies costs one.
    """
    own = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text)).alias("f")))
    nodes = cut(own.where("doc_id IS NOT NULL").groupBy("f").agg(F.min("doc_id").alias("i")))
    joined = components(links(nodes))
    named = nodes.join(joined.withColumnRenamed("id", "i"), "i", "left").select("f", F.coalesce("component", "i").alias("component_id"))
    return own.join(named, "f", "left").select("doc_id", F.col("f").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest id; all columns stay, and so do rows without an id.

    The ids that go are broadcast if they are measured to be few, else joined by a shuffle.
    """
    gone = cut(near_duplicates(docs).where("doc_id != component_id").select(F.col("doc_id").alias("__v_id")).distinct())
    side = F.broadcast(gone) if is_small(gone, 16) else gone
    return docs.join(side, docs["doc_id"] == side["__v_id"], "left_anti")


def as_hex(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")
