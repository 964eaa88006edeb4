import re
import zlib
from collections import Counter

import pytest

from vektorium.llm import spelling


def lower(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def plain_counts(rows, length=6, drop_every=None):
    found = Counter()
    for i, t in rows:
        for w in map(lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= length:
                found[w] += 1
    return found


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(counts, occurrences=5, ratio=5):
    n = {w: k for w, k in counts.items() if k >= occurrences}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= ratio * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def forms(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_forms(words, **options).collect()}


def test_query_against_brute_force(spark, small, texts):
    counts = plain_counts(texts.items(), drop_every=199)
    kept = {w: n for w, n in counts.items() if n >= 5}
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.op11_spelling_variants(spark, small).collect()]
    assert len(got) == len(set(got)) == len(kept) > 300
    by_length = {}
    for w in kept:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if one_edit(w, x)] for w in kept}
    assert {(w, n, k) for w, _, _, n, k, _ in got} == {(w, kept[w], len(near[w])) for w in kept}
    form = {}
    for w in kept:
        best = min(near[w], key=lambda x: (-kept[x], x), default=None)
        form[w] = best if best and kept[best] >= 5 * kept[w] else None
    assert {(w, f, n) for w, f, _, _, _, n in got} == {(w, form[w], kept.get(form[w])) for w in kept}
    for w, _, root, *_ in got:
        while form[w]:
            w = form[w]
        assert root == w


def test_runs_of_one_letter_ends_and_ties(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaaab", "baaaaaa", "aaabaaa", "abcdef", "abcdefg", "abcdeg", "xabcdef", "abcde", "bcdef", "ÀÀÀÀÀÀ", "ÀÀÀÀÀà", "a", "b", "ab"]
    counts = {w: 5 + k % 3 for k, w in enumerate(words)}
    assert forms(spark, counts) == plain_forms(counts)


def test_random_words(spark):
    import random

    rng = random.Random(5)
    for letters, length in (("ab", 7), ("abc", 6), ("abcdefghijklmnopqrstuvwxyz", 3)):
        counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, length))): rng.choice([1, 4, 5, 6, 25, 30, 125, 130, 700, 4000]) for _ in range(400)}
        assert forms(spark, counts) == plain_forms(counts)


def test_long_chains_and_long_words(spark):
    counts = {"w" * (10 + k): 5**k for k in range(1, 9)} | {"y" * 3_000: 5, "y" * 3_001: 50, "z" * 2_999: 9}
    assert forms(spark, counts) == plain_forms(counts)


def test_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)  # tasks hand on several times
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for every in (None, 3):
        counts = plain_counts(rows, drop_every=every)
        got = {r["word"]: r["n"] for r in spelling.word_counts(odd, drop_every=every).collect()}
        assert got == counts
    assert {r["word"] for r in spelling.spelling_forms(spelling.word_counts(odd)).collect()} == {w for w, n in plain_counts(rows).items() if n >= 5}
    empty = spelling.spelling_forms(spelling.word_counts(none))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("every", [1, 2])
def test_dropped_code_points(spark, every):
    rows = [(k, f"abcdefgh{chr(97 + k)} Ünïcödé abcdef") for k in range(20)] + [(None, "abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs, drop_every=every).collect()} == plain_counts(rows, drop_every=every)
