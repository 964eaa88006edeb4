import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vektorium.llm import packing


def library_pieces(texts, capacity=4096):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = []
    for i, t in texts:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        found += [(i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    return found


def check_packing(rows, capacity):
    """(sequence_id, offset, length) of each row: gapless, none too long; how many sequences."""
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for held in by.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_query_against_the_library(spark, small, texts):
    got = packing.op12_best_fit_packing(spark, small).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == sorted(library_pieces(texts.items()))
    n = check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in got], 4096)
    assert n <= -(-sum(r["length"] for r in got) // 4096) + 1


ODD = ["", "a", "<|endoftext|>", "x <|startoftext|> y<|endoftext|>", "it's we'll THEY'RE 'sup", "ΑΣ Σ ΟΔΟΣ", "İstanbul ǅ ﬁ", "é é", "a b c d\x1ce\x85f", "1234 ½ ² ٣", "日本語 テスト 한국어", "\U0001f600\U0001f468‍\U0001f469", "a\x00b", "!!??..--", "x" * 9_000, "w1 " * 5_000, "\n\r\t "]


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 40)
    docs = spark.createDataFrame(list(enumerate([*ODD, *ODD, None])), "doc_id long, text string").coalesce(1)
    got = docs.select("doc_id", F.explode(packing.pieces(spark, "text", capacity=1000, with_ids=True)).alias("p")).select("doc_id", "p.*").collect()
    assert [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got] == library_pieces(enumerate([*ODD, *ODD, None]), 1000)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in got)


def test_odd_rows(spark, odd, none):
    docs = odd.select("*", F.explode(packing.pieces(spark, "text")).alias("p")).select("*", "p.length")
    got = packing.pack(docs)
    assert got.columns == [*docs.columns, "sequence_id", "offset"]
    rows = got.collect()
    assert len(rows) == docs.count()
    check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 4096)
    assert packing.pack(none.select("*", F.explode(packing.pieces(spark, "text")).alias("p")).select("*", "p.length")).collect() == []


@pytest.mark.parametrize("bad", [0, 11, None, -1])
def test_lengths_that_do_not_fit(spark, bad):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(5,), (bad,)], "length long"), capacity=10)


def test_many_equal_rows_and_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 50)
    rows = [(7, 3)] * 900 + [(8, 4)] * 400 + [(k, 1 + k % 10) for k in range(500)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long").repartition(5), capacity=10).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted(rows)
    n = check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in got], 10)
    plain = sum(t for t, _ in packing.best_fit(np.bincount([n for _, n in rows], minlength=11)))
    assert n <= 1.01 * sum(x for _, x in rows) / 10 < plain  # best fit alone needs a tenth more here


def test_patterns_are_all_that_fill_a_sequence():
    present = np.array([True, True, False, True, True, False, True, True, False, False, True])  # lengths 1 3 4 6 7 10
    assert sorted(map(tuple, packing.patterns_of(present, 10).tolist())) == [(4, 3, 3), (6, 3, 1), (6, 4, 0), (7, 3, 0), (10, 0, 0)]


def test_the_fit_recovers_a_histogram_of_patterns():
    h = np.zeros(101, np.int64)
    for times, lengths in ((500, (60, 30, 10)), (300, (55, 45)), (80, (40, 35, 25)), (7, (100,)), (90, (34, 33, 33))):
        for n in lengths:
            h[n] += times
    found, repeats = packing.fit(h)
    covered = np.zeros(101)
    for p, x in zip(found, repeats, strict=True):
        for n in p:
            covered[n] += x
    assert (repeats >= 0).all() and np.abs(covered[1:] - h[1:]).max() < 0.02 * h.max()
    assert sum(t for t, _ in packing.plan(h)) == 977  # no token of padding


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_up_every_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 64, 500]))
    h = np.zeros(capacity + 1, np.int64)
    np.add.at(h, rng.integers(1, capacity + 1, rng.integers(0, 3_000)) if seed % 2 else np.minimum(capacity, 1 + rng.geometric(8 / capacity, 2_000)), 1)
    used, n = np.zeros_like(h), 0
    for times, content in packing.plan(h):
        assert times > 0 and sum(k * m for k, m in content.items()) <= capacity
        n += times
        for k, m in content.items():
            used[k] += times * m
    assert (used == h).all()
    plain = sum(t for t, _ in packing.best_fit(h))  # best fit alone
    assert n <= plain


def test_best_fit_is_that_of_single_documents():
    rng = np.random.default_rng(3)
    lengths = np.minimum(100, 1 + rng.geometric(0.04, 800))
    room = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(100 - n)
    assert sum(t for t, _ in packing.best_fit(np.bincount(lengths, minlength=101))) == len(room)
