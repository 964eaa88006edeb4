"""SentencePiece encoding and decoding by suffix-array matching of the model's pieces."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, worker_cache

MODEL = "piece_bpe_32k.model"
#: Space as the model spells it.
BAR = "▁"
#: A worker keeps units that it met lately: beyond so many a new generation begins, and the one before the last goes.
CACHE, PAIRS = 250_000, 500_000
#: So many bytes of new units are indexed by one suffix array.
INDEX_BYTES = 1 << 20
#: No piece crosses the start of a run of spaces that follows other characters, nor a line feed.
_UNIT = re.compile(f"{BAR}+[^{BAR}\n]*|[^{BAR}\n]+|\n")
#: If moreover none has one of these letters beside another character, units end there as well.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_SHORT_UNIT = re.compile(f"{BAR}*[{_LETTER}]+|{BAR}*[^{BAR}\n{_LETTER}]+|{BAR}+|\n")


def suffix_array(buf: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of buf (bytes) in the order of their first ``depth`` bytes or more, by prefix doubling."""
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : n + j]
    width = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        step = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if width >= depth or step[-1] == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = step.astype(np.uint64) + np.uint64(1)
        later = np.zeros(n, np.uint64)
        later[: n - width] = rank[width:]
        key = rank * np.uint64(n + 2) + later
        width *= 2


class Model:
    """A BPE model with byte fallback: its pieces, and the relaxation that finds its segmentation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = [b"" if sp.is_control(i) else "⁇".encode() if sp.is_unknown(i) else p.replace(BAR, " ").encode() for i, p in enumerate(self.piece)]
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        self.is_byte = set(self.byte)
        known = sorted((p.encode(), i) for p, i in self.id.items())
        self.sorted_ids = np.array([i for _, i in known], np.int32)
        self.lengths = np.array([len(p) for p, _ in known], np.int64)
        self.depth = int(self.lengths.max())
        self.sorted = np.array([p for p, _ in known], f"S{self.depth}")
        self.mask = np.arange(self.depth) < self.lengths[:, None]
        self.pairs: list[dict[int, bool]] = [{} for _ in range(n)]
        self.known = 0
        letter = re.compile(f"[{_LETTER}]")
        beside = {(a, b) for p in self.id for a, b in zip(p, p[1:]) if BAR not in (a, b)}  # noqa: B905
        self.unit = _UNIT if any(bool(letter.match(a)) != bool(letter.match(b)) for a, b in beside) else _SHORT_UNIT
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The symbols left when the best-scored pair, leftmost first, is merged until none is a piece."""
        s = list(text)
        while True:
            best, at = None, -1
            for k in range(len(s) - 1):
                i = self.id.get(s[k] + s[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the pieces a and b stay apart when their text is merged."""
        held = self.pairs[a].get(b)
        if held is None:
            self.known += 1
            if self.known > PAIRS:
                self.known = 1
                for d in self.pairs:
                    d.clear()
            held = self.pairs[a][b] = self.merge(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        return held

    def occurrences(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges (start, end, id) of all pieces in buf, by start, the longest first: binary searches of the suffix array give each piece's range."""
        order = suffix_array(buf, self.depth).astype(np.int32)
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(self.depth, np.uint8)]), self.depth)

        def bound(after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(self.sorted), np.int64), np.full(len(self.sorted), len(order), np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                seen = windows[order[np.minimum(mid, len(order) - 1)]] * self.mask
                seen = seen.view(f"S{self.depth}").ravel()
                right = (seen <= self.sorted if after else seen < self.sorted) & open_
                lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
            return lo

        first, last = bound(False), bound(True)
        count = last - first
        at = np.repeat((first - np.concatenate([[0], np.cumsum(count)[:-1]])).astype(np.int32), count)
        at += np.arange(len(at), dtype=np.int32)
        start, which = order[at], np.repeat(np.arange(len(count), dtype=np.int32), count)
        by = np.argsort(start.astype(np.int64) << 8 | 255 - self.lengths[which])
        start, which = start[by], which[by]
        return start, start + self.lengths[which].astype(np.int32), self.sorted_ids[which]

    def learn(self, units: list[str]) -> None:
        """Encodes units into the cache."""
        at = 0
        while at < len(units):
            held, size = [], 0
            while at < len(units) and size < INDEX_BYTES:
                held.append(units[at].encode())
                size += len(held[-1]) + 1
                at += 1
            # a line feed, which no piece holds, ends each unit; a zero byte would pad a piece, and no piece holds that either
            buf = np.frombuffer(b"\n".join(held).replace(b"\0", b"\n"), np.uint8)
            start, end, ids = self.occurrences(buf)
            row = np.searchsorted(start, np.arange(len(buf) + 1, dtype=np.int32)).astype(np.int32)
            base = lo = 0
            while lo < len(held):  # numbers become Python's for few units at a time
                hi, size = lo, 0
                while hi < len(held) and size < 1 << 14:
                    size += len(held[hi]) + 1
                    hi += 1
                size = min(size, len(buf) - base)
                r = row[base : base + size + 1]
                self._relax(held[lo:hi], (r - r[0]).tolist(), (end[r[0] : r[-1]] - base).tolist(), ids[r[0] : r[-1]].tolist())
                base, lo = base + size, hi

    def _relax(self, units: list[bytes], row: list[int], ends: list[int], ids: list[int]) -> None:
        """Segments units that lie one after another, each followed by one byte; row[p]: the first edge from position p on.

        Edges extend the segmentation of what lies before them if their piece and its last one stay
        apart. A prefix has one segmentation, so an end reached once is never reached by another;
        where the longest edges lead nowhere, the search steps back.
        """
        pairs, cache, base, none = self.pairs, self.cache, 0, {}
        for unit in units:
            n = base + len(unit)
            pos, prev, e, apart = base, -1, row[base], none
            steps, out, dead = [], [], none
            while pos < n:
                last = row[pos + 1]
                while e < last:
                    i = ids[e]
                    e += 1
                    if prev >= 0:
                        ok = apart.get(i)
                        if ok is None:
                            ok = self.adjacent(prev, i)
                        if not ok:
                            continue
                    end = ends[e - 1]
                    if not dead or end not in dead:
                        break
                else:
                    c = unit[pos - base]
                    end, i = pos + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4), -1
                    # a character with a piece of its own has an edge for it, and one without merges with nothing
                    if end in dead or unit[pos - base : end - base].decode() in self.id:
                        dead = {**dead, pos: True}
                        pos, prev, e = steps.pop()
                        out.pop()
                        apart = pairs[prev] if prev >= 0 else none
                        continue
                steps.append((pos, prev, e))
                out.append(i)
                pos, prev, e = end, i, row[end]
                apart = pairs[i] if i >= 0 else none
            if -1 in out:
                ends_ = [p for p, _, _ in steps[1:]] + [n]
                out = [j for i, (p, _, _), q in zip(out, steps, ends_, strict=True) for j in ([i] if i >= 0 else [self.byte[b] for b in unit[p - base : q - base]])]
            cache[unit.decode()] = array("i", out).tobytes()
            base = n + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        cut = [self.unit.findall(BAR + t.replace(" ", BAR)) if t else [] for t in texts]
        every = set().union(*cut)
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        older, missing = self.older, []
        for u in every.difference(self.cache):
            if u in older:
                self.cache[u] = older[u]
            else:
                missing.append(u)
        self.learn(missing)
        cache = self.cache
        return [b"".join([cache[u] for u in us]) for us in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids: the space that encoding put first goes, bytes that aren't UTF-8 become U+FFFD."""
        got = b"".join([self.text[i] for i in np.frombuffer(ids, "<i4").tolist()])
        return got.decode(errors="replace").removeprefix(" ")


def encoded(spark: SparkSession, text: Column | str = "text", *, model: str = MODEL, path: str | None = None, chunk: int = 2_000_000) -> Column:
    """A struct column: ``ids``, the piece ids of the whole text, and ``decoded``, the text they give again.

    Null and empty texts have no ids and decode to the empty string; repeated rows are encoded alike, an
    empty table has no rows, and a very long text is encoded as a whole. The ids are those of the
    model's library. Each batch's texts are cut into units that no piece crosses; the units that the
    worker hasn't met are concatenated and indexed by a suffix array, each piece's range of
    occurrences found by binary search, and the resulting edges, sorted by position, relaxed: an
    edge extends the segmentation that ends where it starts, if its piece and the last one there
    stay apart under the model's merges. Every prefix of a unit has one such segmentation, for no
    merge crosses a boundary of the final one. ``chunk``: characters of text held at once.
    """
    import public_tokenizers

    path = path or public_tokenizers.path(model)

    @F.arrow_udf("ids array<int>, decoded string")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = worker_cache("pieces", path, lambda: Model(path))
        for batch in batches:
            at = 0
            while at < len(batch):
                texts, size = [], 0
                while at < len(batch) and size < chunk:
                    texts.append(batch[at].as_py())
                    size += len(texts[-1] or "")
                    at += 1
                raw = held.encode(texts)
                ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.StructArray.from_arrays([ids, pa.array([held.decode(r) for r in raw], pa.string())], ["ids", "decoded"])

    return encode(F.col(text) if isinstance(text, str) else text)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("e", encoded(spark))
    return found.select(
        "doc_id",
        F.col("e.ids").alias("ids"),
        F.size("e.ids").cast("long").alias("n_pieces"),
        (F.col("e.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
