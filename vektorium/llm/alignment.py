"""Alignment of two tokenizers over the bytes of the same texts, and how often each pair of their tokens overlaps."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, worker_cache

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text aligned at once; longer texts go in parts that end where a word follows a single space.
CHUNK = 500_000
#: Words that a worker keeps the ids of, in each of two generations.
CACHE = 150_000
#: Different pairs that a task counts before it hands them on, and pairs, the most frequent, that travel to every task.
HELD, FREQUENT = 500_000, 1_000_000
#: Links that are sorted or looked up at once.
SORTED = 2_000_000

#: The pre-tokenizer of A, a fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of other characters, and those with a space at an end or beside another one, are encoded whole.
_ODD = re.compile("[^\\n\\r\\t -~ -ԯ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]")
_BREAK = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary spells each byte: printable Latin-1 letters themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both models, and a table from words to their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for t, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.sizes = len(self.bytes_a), len(self.bytes_b)
        self.lengths = tuple(np.array([len(x) for x in xs], np.int32) for xs in (self.bytes_a, self.bytes_b))
        self.code = np.dtype("<u4") if self.sizes[0] * self.sizes[1] < 1 << 32 else np.dtype("<i8")
        # how a group's ids are written: a separator follows each, another one the last of its side
        self.written = [f"{i}{c}" for i in range(self.sizes[0]) for c in ",|"] + [f"{i}{c}" for i in range(self.sizes[1]) for c in ",;"]
        with open(path_a, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        in_order = all(vocabulary.get(x + y) == 256 + k for k, (x, y) in enumerate(pairs))
        ranks = {b: i for i, b in enumerate(self.bytes_a) if i < 256 + len(pairs)}
        self.ordinary = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if in_order and len(ranks) == 256 + len(pairs) else None
        self.by_word = self.ordinary is not None and not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.sizes[1]))
        self.words: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def same(self, want: str, a: list[int], b: list[int]) -> bool:
        plain = want.encode(errors="surrogatepass")
        return b"".join([self.bytes_a[i] for i in a]) == plain and b"".join([self.bytes_b[i] for i in b]) == plain

    def learn(self, words: list[str]) -> None:
        for w, b in zip(words, self.b.encode(words, num_threads=1), strict=True):
            a = self.ordinary(" " + w)
            self.words[w] = (array("I", a).tobytes(), array("I", b).tobytes()) if self.same(" " + w, a, b) else None

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of A and B, of 32 bits each, of every text after a space; none where their bytes aren't the text's."""
        out, cut = [(b"", b"")] * len(texts), {}
        for k, t in enumerate(texts):
            if self.by_word and "  " not in f" {t} " and not _ODD.search(t):
                cut[k] = t.split(" ")
        if len(self.words) > CACHE:  # a new generation begins, and the one before the last goes
            self.older, self.words = self.words, {}
        words, older, missing = self.words, self.older, []
        for w in set().union(*cut.values()).difference(words):
            if w in older:
                words[w] = older[w]
            else:
                missing.append(w)
        self.learn(missing)
        for k, t in enumerate(texts):
            found = [words[w] for w in cut[k]] if k in cut else None
            if found is not None and None not in found:
                out[k] = b"".join([x for x, _ in found]), b"".join([x for _, x in found])
                continue
            a, b = self.a.encode(" " + t, add_special_tokens=False).ids, self.b.encode(t, num_threads=1)
            if self.same(" " + t, a, b):
                out[k] = array("I", a).tobytes(), array("I", b).tobytes()
        return out

    def align(self, texts: list[str]) -> list[tuple[int, int, int, int, str, bytes]]:
        """(n_a, n_b, n_groups, n_links, groups, links) of each text.

        The texts lie one after another on one axis of bytes. The ends of A's and of B's tokens are
        counted on it once; where both occur a group ends, where either does a link ends, whose
        tokens are those that the ends before it number. Differences of prefix sums at the texts' ends
        are each text's results.
        """
        encoded = self.encode(texts)
        a, b = (np.frombuffer(b"".join([x[side] for x in encoded]), np.uint32).astype(np.int64) for side in (0, 1))
        ends_a, ends_b = (np.cumsum(self.lengths[side][ids], dtype=np.int64) for side, ids in ((0, a), (1, b)))
        size = int(ends_a[-1]) if len(a) else 0
        at_a, at_b = (np.bincount(ends, minlength=size + 1).astype(np.int8) for ends in (ends_a, ends_b))
        cut, either = at_a & at_b, at_a | at_b
        sum_a, sum_b, sum_cut, sum_either = (np.cumsum(x, dtype=np.int32) for x in (at_a, at_b, cut, either))

        n_a = np.array([len(x) // 4 for x, _ in encoded], np.int64)
        last = np.concatenate([[0], np.cumsum(n_a)])
        ends = np.concatenate([[0], ends_a])[last]  # of the texts
        per_text = [np.diff(s[ends]) for s in (sum_a, sum_b, sum_cut, sum_either)]

        e = np.flatnonzero(either)
        codes = (a[sum_a[e] - at_a[e]] * self.sizes[1] + b[sum_b[e] - at_b[e]]).astype(self.code)
        cuts = np.flatnonzero(cut)
        b_before = np.concatenate([[0], sum_b[cuts]])[sum_cut[ends_a] - cut[ends_a]]  # B's tokens in the groups before
        a_up_to = sum_a[cuts][sum_cut[ends_b] - cut[ends_b]]  # A's tokens up to the group
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_before] = 2 * a + cut[ends_a]
        order[np.arange(len(b)) + a_up_to] = 2 * (self.sizes[0] + b) + cut[ends_b]

        tokens, links = np.cumsum(per_text[0] + per_text[1]), np.cumsum(per_text[3])
        out, lo, link = [], 0, 0
        for k, (hi, to) in enumerate(zip(tokens.tolist(), links.tolist(), strict=True)):
            written = "".join([self.written[x] for x in order[lo:hi].tolist()])[:-1]
            out.append((*(int(x[k]) for x in per_text), written, codes[link:to].tobytes()))
            lo, link = hi, to
        return out


def _parts(text: str) -> list[str]:
    out = []
    while len(text) > CHUNK and (m := _BREAK.search(text, CHUNK)):
        out.append(text[: m.start()])
        text = text[m.end() :]
    return [*out, text]


def _aligned(aligner: Aligner, texts: Iterable[str | None]) -> Iterator[tuple[int, int, int, int, list[str], bytes]]:
    """(n_a, n_b, n_groups, n_links, groups of each part, links) of each text, some parts of texts at a time."""

    def whole(own: list[tuple]) -> tuple:
        if all(x[0] for x in own):
            return (*(sum(x[c] for x in own) for c in range(4)), [x[4] for x in own], b"".join(x[5] for x in own))
        return (0, 0, 0, 0, [], b"")

    waiting, flat, size, held = [], [], 0, []

    def flush() -> Iterator[tuple]:
        held.extend(aligner.align(flat))
        at = 0
        while waiting and at + waiting[0] <= len(held):
            n = waiting.pop(0)
            yield whole(held[at : at + n])
            at += n
        del held[:at]
        flat.clear()

    for t in texts:
        parts = _parts(t) if t else []
        waiting.append(len(parts))
        for p in parts:
            flat.append(p)
            size += len(p)
            if size >= CHUNK:
                yield from flush()
                size = 0
    yield from flush()


def aligned(spark: SparkSession, text: Column | str = "text", *, model_a: str = MODEL_A, model_b: str = MODEL_B, path_a: str | None = None, path_b: str | None = None, with_groups: bool = False) -> Column:
    """A struct column (n_a, n_b, n_groups, n_links, groups_sha256, links[, groups]) of each whole text.

    A, a byte-level BPE model, encodes the text after a space, B, a SentencePiece model with a
    leading space, the text; special strings are plain text. Byte offsets where tokens of both end cut
    them into groups, written `a1,a2|b1;a3|b2,b3`. A link is a pair of tokens whose bytes
    overlap; ``links`` holds a * size_b + b of each in order, as little-endian numbers. Null and empty texts,
    and those whose bytes are not those that A's or B's tokens spell, have no tokens: zeros, and no
    groups. Whole batches of texts are aligned at once, in parts where they are very long.
    """
    import public_tokenizers

    path_a, path_b, key = path_a or public_tokenizers.path(model_a), path_b or public_tokenizers.path(model_b), uuid.uuid4().hex
    fields = [pa.field(n, t) for n, t in zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "groups"), [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.string()], strict=True)][: 6 + with_groups]

    @F.arrow_udf("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary" + ", groups string" * with_groups)
    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = worker_cache("alignment", key, lambda: Aligner(path_a, path_b))
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            for *n, groups, links in _aligned(aligner, (x.as_py() for x in batch)):
                written = ";".join(groups)
                row = (*n, hashlib.sha256(written.encode()).hexdigest() if written else "", links, written)
                for c, x in zip(columns, row, strict=False):
                    c.append(x)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)

    return align(F.col(text) if isinstance(text, str) else text)


def _codes(links: pa.Array, code: np.dtype) -> np.ndarray:
    """The numbers of all rows, one after another, where they lie."""
    offsets = np.frombuffer(links.buffers()[1], np.int32, len(links) + 1, 4 * links.offset) if len(links) else np.zeros(1, np.int32)
    data = links.buffers()[2] if len(links) else None
    return np.frombuffer(data, code, (offsets[-1] - offsets[0]) // code.itemsize, offsets[0]) if data is not None else np.zeros(0, code)


def _sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes once, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def pair_counts(links: DataFrame, size_b: int, code: np.dtype) -> DataFrame:
    """(pair, n, best) of aligned rows (links): how many links hold each pair of ids, and whether no pair of its B id has more. Tasks count first, HELD different pairs at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _sums(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))

        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].astype(np.int64)), pa.array(x[1])], ["pair", "n"])
        for b in batches:
            every = _codes(b["links"], code)
            for lo in range(0, len(every), SORTED):
                held.append(np.unique(every[lo : lo + SORTED], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(merged())

    counted = stored(links.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    of_b = F.pmod("pair", F.lit(size_b))
    most = counted.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))  # a row for each of B's ids
    return counted.withColumn("b", of_b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least(pairs: DataFrame, rows: int) -> int:
    """The least count of a pair such that no more than so many pairs have it or a larger one, told from sizes by powers of two."""
    sizes = pairs.groupBy(F.floor(F.log2("n") * 4).alias("k")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("n")).orderBy(F.desc("k")).collect()
    total, least = 0, 1 << 62
    for r in sizes:
        total += r["pairs"]
        if total > rows:
            break
        least = r["n"]
    return least


def with_pair_counts(aligned_rows: DataFrame, *, model_a: str = MODEL_A, model_b: str = MODEL_B, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Rows (links, as aligned() gives them, and any others) with ``n_best``, the links whose pair's count is the highest of its B id, ties included, and ``count_sum``, the sum of all links' counts; both over all rows. Repeated rows count as often as they are there.

    The FREQUENT most frequent pairs, 17 bytes each, travel to every task. The other links, all of
    rare pairs, are joined to their counts by a shuffle, a row for each pair of a row.
    """
    import public_tokenizers

    aligner = Aligner(path_a or public_tokenizers.path(model_a), path_b or public_tokenizers.path(model_b))
    size_b, code = aligner.sizes[1], aligner.code
    rows = stored(aligned_rows.withColumn("__v_row", F.monotonically_increasing_id()), codec="zstd")
    pairs = stored(pair_counts(rows, size_b, code))
    least = _least(pairs, FREQUENT)
    common = pairs.where(F.col("n") >= least).toArrow()
    by = np.argsort(common["pair"].to_numpy())
    sent = rows.sparkSession.sparkContext.broadcast(tuple(common[c].to_numpy()[by] for c in ("pair", "n", "best")))

    @F.arrow_udf("n_best long, count_sum long, others array<long>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, n, best = sent.value
        known, n, best = (np.append(x, y) for x, y in ((known, np.int64(-1)), (n, 0), (best, False)))
        size = len(known) - 1
        for batch in batches:
            every, length = _codes(batch, code), pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False) // code.itemsize
            ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
            sums, others, missed = np.zeros((2, len(batch)), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            lo = 0
            while lo < len(batch):  # rows with about SORTED links
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SORTED, side="right")) - 1)
                some = every[ends[lo] : ends[hi]].astype(np.int64)
                at = np.searchsorted(known[:size], some)
                at[known[at] != some] = size
                own = ends[lo : hi + 1] - ends[lo]
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[own])  # noqa: E731, B023
                sums[:, lo:hi] = total(best[at]), total(n[at])
                others.append(some[at == size])
                missed.append(total(at == size))
                lo = hi
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(missed))]).astype(np.int32)), pa.array(np.concatenate(others)))
            yield pa.StructArray.from_arrays([*map(pa.array, sums), listed], ["n_best", "count_sum", "others"])

    looked = rows.withColumn("__v_x", look_up("links"))
    columns = [c for c in aligned_rows.columns if c not in ("n_best", "count_sum")]
    rare = pairs.where(F.col("n") < least)
    if rare.isEmpty():
        return looked.select(*columns, "__v_x.n_best", "__v_x.count_sum")
    looked = stored(looked.select("__v_row", *columns, F.col("__v_x.n_best").alias("__v_best"), F.col("__v_x.count_sum").alias("__v_sum"), F.col("__v_x.others").alias("__v_others")), codec="zstd")
    links = looked.select("__v_row", F.explode("__v_others").alias("pair")).groupBy("__v_row", "pair").agg(F.count(F.lit(1)).alias("times"))
    more = links.join(rare, "pair").groupBy("__v_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__v_b"), F.sum(F.col("times") * F.col("n")).alias("__v_s"))
    both = looked.join(more, "__v_row", "left")
    return both.select(*columns, (F.col("__v_best") + F.coalesce("__v_b", F.lit(0))).alias("n_best"), (F.col("__v_sum") + F.coalesce("__v_s", F.lit(0))).alias("count_sum"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", aligned(spark, "text").alias("x")).select("doc_id", "x.*")
    return with_pair_counts(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
