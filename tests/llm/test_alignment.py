import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vektorium.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}, b


def plain(models, rows):
    """The contract by loops over tokens: sets of byte positions, every pair of a group compared."""
    a, bytes_a, b = models
    texts = []
    for i, t in rows:
        if not t:
            texts.append((i, [], [], []))
            continue
        whole = (" " + t).encode()
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        sb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ib]
        sa = [bytes_a[x] for x in ia]
        if b"".join(sa) != whole or b"".join(sb) != whole:
            texts.append((i, [], [], []))
            continue
        ends = lambda xs: np.cumsum([len(x) for x in xs]).tolist()
        ea, eb = ends(sa), ends(sb)
        groups, ka, kb, links = [], 0, 0, []
        for end in sorted(set(ea) & set(eb)):
            ja, jb = ea.index(end, ka) + 1, eb.index(end, kb) + 1
            groups.append((ia[ka:ja], ib[kb:jb]))
            for x in range(ka, ja):
                for y in range(kb, jb):
                    if max(ea[x] - len(sa[x]), eb[y] - len(sb[y])) < min(ea[x], eb[y]):
                        links.append((ia[x], ib[y]))
            ka, kb = ja, jb
        texts.append((i, ia, ib, groups, links))
    count = Counter(x for t in texts for x in t[-1] if t[1])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for i, ia, ib, groups, *links in texts:
        links = links[0] if links else []
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(ia), len(ib), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if written else ""))
    return out


def by(rows):
    return sorted((tuple(r) for r in rows), key=repr)


ODD = [
    "", " ", "a", "a b", " a", "a ", "a  b", "a   b\n  c", "a\n\nb \n c\t\td\r\ne", "it's we'll THEY'RE", "<|endoftext|> <s></s><unk>", "▁", "a▁b ▁c", "é ñandú É é", "日本語 テスト 한국어 字", "\U0001f600\U0001f468‍\U0001f469 x",
    "a\x00b", "a\x1cb \x1c c", "a\xa0b \xa0c \xa0", "a b　c", "١٢٣ 1234567 ½", "!!!???...---", "x" * 3_000, "ab " * 2_000, "\n" * 50, "ａｂｃ ﬁ", "<0x41> <0x0A>",
]


def test_query_against_the_libraries(spark, small, texts, models):
    got = alignment.op13_tokenizer_alignment(spark, small).select(*COLUMNS).collect()
    assert by(got) == by(plain(models, list(texts.items())))
    assert sum(r["n_a"] > 0 for r in got) > 150


@pytest.mark.parametrize("limits", [{}, {"FREQUENT": 40, "HELD": 60, "CACHE": 20, "SORTED": 30}, {"FREQUENT": 0}, {"CHUNK": 50}])
def test_odd_texts_and_rare_pairs(spark, models, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(alignment, k, v)
    rows = list(enumerate([*ODD, *ODD[:9], None]))
    # texts in parts, words kept by few at a time: in this process, as the workers have the module's own limits
    aligner = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    want = plain(models, rows)
    local = [x for t in rows for x in alignment._aligned(aligner, [t[1]])]
    assert [(x[0], x[1], x[2], x[3], hashlib.sha256(";".join(x[4]).encode()).hexdigest() if x[4] else "") for x in local] == [(*w[1:5], w[7]) for w in want]
    assert local == list(alignment._aligned(aligner, (t for _, t in rows)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = alignment.with_pair_counts(docs.select("doc_id", alignment.aligned(spark, "text").alias("x")).select("doc_id", "x.*"))
    assert by(found.select(*COLUMNS).collect()) == by(want)


def test_odd_rows(spark, odd, none, models):
    docs = odd.select("*", alignment.aligned(spark, "text", with_groups=True).alias("x")).select(*odd.columns, "x.*")
    got = alignment.with_pair_counts(docs)
    assert got.columns == [*docs.columns, "n_best", "count_sum"]
    assert by(got.select(*COLUMNS).collect()) == by(plain(models, [(r["doc_id"], r["text"]) for r in odd.collect()]))
    empty = none.select("doc_id", alignment.aligned(spark, "text").alias("x")).select("doc_id", "x.*")
    assert alignment.with_pair_counts(empty).collect() == []


def test_groups_as_text(spark):
    docs = spark.createDataFrame([(1, "unbelievably so")], "doc_id long, text string")
    r = docs.select(alignment.aligned(spark, "text", with_groups=True).alias("x")).select("x.*").first()
    sides = [[[int(i) for i in s.split(",")] for s in g.split("|")] for g in r["groups"].split(";")]
    assert sum(len(a) for a, _ in sides) == r["n_a"] and sum(len(b) for _, b in sides) == r["n_b"] and len(sides) == r["n_groups"]
    assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] == len(r["links"]) // 4
