"""Every operator against a brute-force version or the library it stands for, and on odd input."""

import hashlib
import html
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import rows_of
from pyspark.sql import functions as F

from vektorium.llm import components, decontaminate, html_text, lines, ngram_lm, pieces, pii, quality, registry, simhash, substrings, token_counts

WORD = re.compile("[^\x20\x09-\x0D]+")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_against_sql(spark, small, duck, name):
    got, want = registry.queries()[name](spark, small).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


# 1 substrings


def sentences_again(text):
    out = []
    for line in (text or "").split("\n"):
        sentence = []
        words = line.split()
        for k, w in enumerate(words):
            sentence.append(w)
            if w[-1] in ".!?" or k == len(words) - 1:
                pieces_, now = [], []
                for x in sentence:
                    now.append(x)
                    if len(sentence) > 15 and (len(now) == 24 or (ord(x[0]) + 3 * ord(x[-1]) + 5 * len(x)) % 6 == 0):
                        pieces_.append(now)
                        now = []
                out += pieces_ + ([now] if now else [])
                sentence = []
    return out


def removed_spans(texts):
    first, gone = set(), {}
    for i in sorted(texts):
        parts, covered = sentences_again(texts[i]), set()
        for k in range(len(parts)):
            for e in range(k + 3, len(parts) + 1):
                if sum(map(len, parts[k:e])) >= 15:
                    key = tuple(map(tuple, parts[k:e]))
                    covered.update(range(k, e) if key in first else ())
                    first.add(key)
                    break
        gone[i] = (len(covered), [w for k, p in enumerate(parts) if k not in covered for w in p])
    return gone


def test_substrings_brute_force(documents, texts):
    got = by_id(substrings.dedup_substrings(documents), "n_removed", "text")
    want = removed_spans(texts)
    assert {i: (n, t.split()) for i, (n, t) in got.items()} == want and sum(n for n, _ in want.values()) > 20


def test_substrings_find_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    sentence = lambda: " ".join(word() for _ in range(9)) + "."
    passage = [sentence() for _ in range(7)]
    rows = [(k, " ".join([*(sentence() for _ in range(5)), *(passage if k % 2 else []), *(sentence() for _ in range(5))])) for k in range(20)]
    got = by_id(substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed", "text", "first_doc_ids")
    for k, text in rows:
        if k % 2 and k > 1:
            assert got[k][0] == 7 and not any(s in got[k][1] for s in passage) and got[k][2] == [1]
        else:
            assert got[k][:2] == (0, text)


@pytest.mark.parametrize("edits", [0, 1])
def test_passages_without_sentence_ends(spark, edits):
    """Passages of 50 words, at any offset of unpunctuated text: 0.9 of the later copies are caught, other text stays."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    some = lambda n: [word() for _ in range(n)]
    rows, later = [], []
    for k in range(150):
        passage = some(50)
        for c in range(2):
            now = list(passage)
            if c and edits:
                now[rng.choice((3, 46))] = word()
            rows.append((2 * k + c, " ".join([*some(rng.randint(10, 60)), *now, *some(rng.randint(10, 60))])))
            later += [2 * k + 1] * c
    rows += [(1000 + k, " ".join(some(120))) for k in range(100)]
    got = by_id(substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed", "text")
    assert sum(got[i][0] > 0 for i in later) >= 0.9 * len(later) and not any(n for i, (n, _) in got.items() if i not in later)
    assert all(len(t.split()) >= len(dict(rows)[i].split()) - 50 for i, (_, t) in got.items())


def test_substrings_of_rows_that_share_an_id(spark):
    a, b, c = ("One of the first sentences here. Two of the other sentences there. Three and four of all of them.", "Quite another text of its own. With sentences that nobody else has. And one more to end with it.", "Yet more words for this one. They are nowhere else to be seen. So nothing of them may ever go.")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, a + " " + c), (4, b)]
    got = Counter((r["doc_id"], r["text"].strip(), r["n_removed"]) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[2, b, 0] == 2 and got[1, a, 0] == 1 and got[2, "", 3] == 1 and got[4, "", 3] == 1 and sum(got.values()) == 7
    assert (got[3, c, 0] and got[3, "", 6]) or (got[3, "", 3] and got[3, c, 3])


def test_substrings_odd(odd, none):
    got = substrings.dedup_substrings(odd)
    assert got.count() == odd.count() and substrings.dedup_substrings(none).count() == 0
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[1] is None and texts[2] == "" and texts[9].startswith("One") and texts[10] == "" and texts[None].startswith("One")
    assert texts[7].startswith("word0x0 ") and texts[7].count(" ") == 19_999 and len(texts[11]) == 50_000


# 2 lines


def removed_lines(texts):
    sets, places, seen, index, gone = [], [], set(), defaultdict(list), defaultdict(set)
    for i in sorted(texts):
        for p, line in enumerate((texts[i] or "").split("\n")):
            s = frozenset(WORD.findall(line))
            if s and s in seen:
                gone[i].add(p)
            elif s:
                near = Counter(j for w in s for j in index[w])
                if any(5 * o >= 4 * (len(s) + len(sets[j]) - o) for j, o in near.items()):
                    gone[i].add(p)
                seen.add(s)
                for w in s:
                    index[w].append(len(sets))
                sets.append(s)
    del places
    return gone


@pytest.fixture(scope="module")
def near_lines(spark):
    """A line in many versions, edited here and there, and frequent short lines."""
    rng = random.Random(3)
    base = [f"tok{k}" for k in range(25)]
    rows = []
    for i in range(150):
        line = list(base)
        for _ in range(rng.randint(0, 4)):
            line[rng.randrange(25)] = f"new{rng.randint(0, 40)}"
        rows.append((i, "\n".join([" ".join(line), "the of", "the of and to", f"unique line number {i}", "", "the of and to in"])))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), dict(rows)


@pytest.mark.parametrize(("keys", "heads"), [(1, 2), (3, 16)])
def test_lines_brute_force(spark, documents, texts, near_lines, monkeypatch, keys, heads):
    monkeypatch.setattr(lines, "CROWD_KEYS", keys)
    monkeypatch.setattr(lines, "HEADS", heads)
    monkeypatch.setattr(lines, "CROWD", heads)
    for df, own in ((documents, texts), near_lines):
        gone = removed_lines(own)
        got = by_id(lines.dedup_lines(spark, df).select("doc_id", "text", "__v_lines.n_removed"), "text", "n_removed")
        assert got == {i: ("\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]), len(gone[i])) for i, t in own.items()}


SHARED = [
    (1, "one two three four five six seven\nonly here\tand here"), (2, "one two three four five six seven\nsomething else of its own"), (2, "totally unrelated words\n foo  bar \nlast words of all"),
    (2, "totally unrelated words\n foo  bar \nlast words of all"), (2, "foo bar\ncompletely fresh line\none two three four five six seven eight"), (3, "only here and here\nbar\x0bfoo"), (3, "bar foo bar"),
]


def test_lines_of_rows_that_share_an_id(spark):
    import xxhash

    number = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), 42), "big", signed=True)
    ids = Counter(i for i, _ in SHARED)
    own = {(i, number(t) if ids[i] > 1 else 0): t for i, t in SHARED}
    gone = removed_lines(own)
    want = sorted((k[0], "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[k])) for i, t in SHARED for k in [(i, number(t) if ids[i] > 1 else 0)])
    got = lines.dedup_lines(spark, spark.createDataFrame(SHARED, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert sum("totally unrelated words" in t for _, t in want) == 2


def test_lines_odd(spark, odd, none):
    got = lines.dedup_lines(spark, odd)
    assert got.columns == [*odd.columns, "__v_lines"] and got.count() == odd.count() and lines.dedup_lines(spark, none).count() == 0
    t = {r["doc_id"]: r["text"] for r in got.collect()}
    assert t[1] is None and t[2] == "" and t[3] == " \t\n \r\n" and t[4] == "a" and t[5] == "" and t[10] == "" and t[None].startswith("One") and t[12] == "\n" * 1000


# 3 pages


def test_min_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        t = [rng.randint(-5, 5) for _ in range(n)]
        e = [(a, b, rng.randint(0, 4)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda x: sum(abs(c) for c, y in zip(t, x) if c and (c > 0) != y) + sum(c for a, b, c in e if x[a] != x[b])  # noqa: E731, B023, B905
        assert cost(html_text.min_cut(t, e)) == min(map(cost, itertools.product((False, True), repeat=n)))


def test_pages_give_their_articles(spark, small):
    got = registry.queries()["op3_html_extraction"](spark, small).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("  \n", ""), ("<p></p>", ""), ("plain words only here", "plain words only here"), ("<html><body><p>Unclosed <b>bold &amp; &eacute;", "Unclosed bold & é"),
        ('<body><header class="site"><h1>Site</h1></header><div id="content"><p>Hello there,&nbsp;this   is long\ttext.</p><ul><li>one item<li>two items</ul><div class="user-comments"><p>Nice post, really!</p></div></div><div class="cookie-notice">We use cookies on this site.</div><footer>All rights reserved.</footer>', "Hello there, this is long text.\none item\ntwo items"),
        ('<nav><a href="/">Home</a></nav><main><script>var a="<p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><h2>Title</h2><p>Body text of the page.</p><form><label>Name</label><input></form><aside>Related things to read.</aside><p hidden>secret</p></main>', "Title\nBody text of the page."),
        ("<article><p>1 < 2 &lt; 3</p><p title='a > b'>quoted</p></article>", "1 < 2 < 3\nquoted"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page)[0] == text


STORY = [" ".join(f"word{k}x{i}" for i in range(30)) + "." for k in range(4)]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in STORY)


@pytest.mark.parametrize(
    ("page", "n"),
    [
        ("<body class='single has-sidebar'><article>{}</article></body>", 4),
        ("<body><main class='has-sidebar'>{}</main></body>", 4),
        ("<body><div class='page header-fixed'><article>{}</article></div></body>", 4),
        ("<body><div class='page header-fixed'><div class='has-sidebar'>{}</div></div></body>", 4),
        ("<form id='aspnetForm'><nav><a href=a>Home</a></nav><div>{}</div><div class='comments'><p>Nice post, really, I liked it.</p></div></form>", 4),
        ("<div class='text'>Call us</div><div>{}</div>", 4),
        ("<article>{}<div class='share-bar'><p>Share this long story with all of your many friends.</p></div></article>", 4),
        ("<div class='post'><p>" + STORY[0] + " " + STORY[1] + "</p></div><div id='comments'><div class='text'>{}{}{}</div></div>", 0),
        ("<article><p>" + STORY[0] + "</p></article><section class='related'><article class='teaser'>{}</article></section>", 0),
    ],
)
def test_wrappers_with_boilerplate_names(page, n):
    assert html_text.main_text("<div class='page header-fixed'><p>Only a few words here.</p></div>")[0] == "Only a few words here."
    text = html_text.main_text(page.replace("{}", PARAGRAPHS))[0].split("\n")
    assert [t for t in text if t in STORY] == (STORY if n else STORY[:1] if "<article><p>" in page else [])
    assert not any(t.startswith(("Nice", "Share", "Home")) for t in text)


@pytest.mark.parametrize("before", ["<datalist><option value=a><option value=b></datalist>", "<select><option>One<option>Two</select>", "<button>Menu", "<svg><path d=x>", "<video src=a>", "<audio>", "<canvas>", "<object>", "<select><option>One", "İ<SCRIPT>var a = 'İ<p>no' + x<y;</SCRIPT>", "<script>if (a<b && c == '</script>", "<button><div>No</div></button><svg><g><svg></svg><text>No</text></g></svg>"])
@pytest.mark.parametrize("after", ["", "<button>B</button><video></video><svg></svg><canvas></canvas><object></object><audio></audio><select></select>"])
def test_unclosed_elements_lose_no_text(before, after):
    page = f"<article><p>First words of the page.</p>{before}<p>Second words of the page.</p>{after}<p>Third words of the page.</p></article>"
    text = html_text.main_text(page)[0].split("\n")
    assert [t for t in text if t != "İ"] == ["First words of the page.", "Second words of the page.", "Third words of the page."]


def test_the_cut_beats_the_classifier_on_pages_without_marks(spark, small):
    """Pages whose elements are all div, without classes: held-out F-scores of the blocks, by the classifier's signs and by the cut."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_text.fit_weights(pages.where("page_id % 2 = 0"))
    assert weights != html_text.PRIOR
    counts = {"sign": [0, 0, 0], "cut": [0, 0, 0]}
    for r in pages.where("page_id % 2 = 1").collect():
        article = re.search("<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = Counter(b for x in re.split(r"</?(?:p|h1)>", article) if (b := " ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split())))
        soup = re.sub(r"(</?)(?:nav|article|footer|p|h1)(?=[ >])", r"\1div", r["html"]).replace(' class="ad"', "")
        found = html_text.blocks(soup)
        html_text.settle(found)
        costs, edges = html_text.costs(found, weights)
        for name, labels in (("sign", [c > 0 for c in costs]), ("cut", html_text.min_cut(costs, edges))):
            got = Counter(b.text for b, x in zip(found, labels, strict=True) if x)
            both = (got & want).total()
            counts[name] = [n + m for n, m in zip(counts[name], (both, got.total() - both, want.total() - both), strict=True)]
    score = {k: 2 * a / (2 * a + b + c) for k, (a, b, c) in counts.items()}
    print(score)
    assert score["cut"] > 0.85 and score["cut"] > score["sign"] + 0.05


def test_the_cut_keeps_short_blocks_between_long_ones():
    page = "<div><div><a href=a>Home</a></div><div><a href=b>News</a></div></div><div>" + f"<div>{STORY[0]}</div><div>See <a href=c>there</a></div><div>{STORY[1]}</div>" + "</div><div><div><a href=d>Imprint</a></div></div>"
    found = html_text.blocks(page)
    costs, edges = html_text.costs(found, html_text.PRIOR)
    assert [c > 0 for c in costs] == [False, False, True, False, True, False]
    assert html_text.min_cut(costs, edges) == [False, False, True, True, True, False]


def test_the_classifier_keeps_its_prior_without_pages(spark, odd, none):
    assert html_text.fit_weights(odd, "text") == html_text.fit_weights(none, "text") == html_text.PRIOR
    page = f"<nav><a href=a>Home</a></nav><article><p>{STORY[0]}</p></article>"
    many, once = (spark.createDataFrame([(page,)] * n, "html string") for n in (50, 1))
    assert html_text.fit_weights(many) == html_text.fit_weights(once) != html_text.PRIOR


def test_formulas_are_text():
    assert html_text.main_text("<article><p>As <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p></article>")[0] == "As x=2 here."


def test_pages_odd(odd, none):
    assert odd.select(html_text.extracted("text").alias("x")).count() == odd.count()
    assert none.select(html_text.extracted("text").alias("x")).count() == 0


# 4 personal data


def test_surrogates_keep_type_format_and_coreference():
    c = pii.Cipher(b"key")
    text = 'Call +1 (718) 555-1498 or 718-555-1498; Bob.42@mail8.example.com, bob.42@mail8.example.com; card 4111 1111 1111 1111; from 42.144.35.254 and 192.168.0.1; token = "0597a73c7eab90018cb426a8235f23534924216d"; Mrs Anna Schmidt and John Miller; Господин Иванов; 123-45-6789; DE89 3704 0044 0532 0130 00.'
    new, found = pii.replaced(text, c, {})
    assert {k for k, _, _ in found} >= {"phone", "email", "card", "ip", "secret", "givenf", "givenm", "surname", "ssn", "iban"}
    assert not any(text[a:b] in new for _, a, b in found) and len(new.split()) == len(text.split())
    phones = re.findall(r"\(?(\d{3})\)?[ -](\d{3}-\d{4})", new)
    assert phones[0] == phones[1]
    mails = re.findall(r"(\S+)@mail8.example.com", new)
    assert mails[0].lower() == mails[1] and mails[0][0].isupper()
    assert pii.luhn(re.sub(r"\D", "", re.search(r"card ([\d ]+)", new)[1])) and "192.168." in new and pii._iban_ok(new.split("; ")[-1].rstrip(".").replace(" ", ""))
    assert re.search(r"Mrs (\w+)", new)[1] in pii.GIVEN["latin", "f"] and re.search("Господин ([А-Яа-я]+)", new)
    assert pii.replaced(text, c, {}) == (new, found) and pii.replaced(text, pii.Cipher(b"other"), {})[0] != new


@pytest.mark.parametrize("kind", ["phone", "ssn", "surname", "email", "ip", "card"])
def test_surrogates_are_distinct(kind):
    c, rng = pii.Cipher(b"k"), random.Random(2)
    make = {"phone": lambda: f"{rng.randrange(10**7):07d}", "ssn": lambda: f"{rng.randrange(10**9):09d}", "surname": lambda: "".join(rng.choice("abeo") for _ in range(4)), "email": lambda: f"{rng.choice('abc')}{rng.randrange(100):02d}@x.{rng.choice(['de', 'fr'])}", "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), "card": lambda: f"4{rng.randrange(10**15):015d}"}[kind]
    values = {make() for _ in range(1500)}
    new = {v: pii.surrogate(c, kind, v) for v in values}
    assert len(set(new.values())) == len(values) and all(k != v for k, v in new.items())


def test_collisions_get_another_attempt(spark):
    c = pii.Cipher(b"k")
    value = "ab"
    found = spark.createDataFrame([("surname", value), ("surname", pii.surrogate(c, "surname", value))], "kind string, value string")
    odd = {(r["kind"], r["value"]): r["attempt"] for r in pii.tries(found, b"k").collect()}
    assert odd["surname", value] >= 1


def test_later_mentions_of_names():
    c = pii.Cipher(b"key")
    text = "The Schmidts met. Mrs Anna Schmidt came with Dr Paul Ódz. Schmidt said that Anna's house and Schmidt's, or Annas, are SCHMIDT-built; Ódz left Paul at mail anna@gmail.com. Annabel Schmidtke stays, as schmidt and Paulus do. Paul Miller came."
    new, found = pii.replaced(text, c, {})
    anna, schmidt, paul, odz = (pii.dressed(k, "x", pii.surrogate(c, k, v)) for k, v in (("givenf", "anna"), ("surname", "schmidt"), ("givenm", "paul"), ("surname", "ódz")))
    mail = new[new.index("mail ") + 5 :].split(". ")[0]
    assert new == f"The {schmidt}s met. Mrs {anna} {schmidt} came with Dr {paul} {odz}. {schmidt} said that {anna}'s house and {schmidt}'s, or {anna}s, are {schmidt.upper()}-built; {odz} left {paul} at mail {mail}. Annabel Schmidtke stays, as schmidt and Paulus do. {paul} {pii.dressed('surname', 'x', pii.surrogate(c, 'surname', 'miller'))} came."
    assert found == sorted(found, key=lambda x: x[1]) and all(a[2] <= b[1] for a, b in zip(found, found[1:]))
    assert [x[:2] for x in pii.detect("Mr Miller saw Mrs Anna-Schmidt. Anna Schmidt and Miller-Schmidt")][-2:] == [(49, 55), (56, 63)]
    assert pii.detect("The Schmidt Anna and Paul") == [] and "anna" not in mail


def test_crowded_names_get_surrogates(spark):
    found = {(f"given{key[1]}", n.lower()) for key, names in pii.GIVEN.items() for n in names}
    found |= {("surname", a + b) for a in "bcdfghjklmnpqrst" for b in "aeiou"} | {("secret", "-" * 12), ("ip", "8.8.8.8"), ("surname", "schmidt")}
    odd = {(r["kind"], r["value"]): r["attempt"] for r in pii.tries(spark.createDataFrame(sorted(found), "kind string, value string"), b"k").collect()}
    new = {(k, v): pii.surrogate(pii.Cipher(b"k"), k, v, odd.get((k, v), 0)) for k, v in found}
    assert len({(k, x) for (k, _), x in new.items()}) == len(found) and all(x != v for (k, v), x in new.items() if k != "secret")


def test_a_space_without_an_assignment_is_crowded(spark):
    """Values are real or shared in every round, so that the space counts as crowded after the last one; other spaces aren't touched."""
    found = {("surname", a + b) for a in "bcdfghjklmnpqrstvwxyz"[:5] for b in "aeiou"} | {("surname", "schmidt"), ("ipv6", "2001:db8::1")}
    odd = {(r["kind"], r["value"]): r["attempt"] for r in pii.tries(spark.createDataFrame(sorted(found), "kind string, value string"), b"k", 1).collect()}
    new = {(k, v): pii.surrogate(pii.Cipher(b"k"), k, v, odd.get((k, v), 0)) for k, v in found}
    assert len({(k, x) for (k, _), x in new.items()}) == len(found) and all(x != v for (_, v), x in new.items())


def words_of(text):
    return re.findall(r"[\w:.@-]*\w", text)


def test_names_are_one_person_s_whatever_the_title():
    c = pii.Cipher(b"key")
    new, _ = pii.replaced("Dr Zorblat Quux came. Mr Zorblat Quux left. Frau Quux and Prof Zorblat stayed.", c, {})
    a, b = words_of(new)[1:3]
    assert new == f"Dr {a} {b} came. Mr {a} {b} left. Frau {b} and Prof {a} stayed." and (a, b) != ("Zorblat", "Quux")
    for text, names in (("James Thomas wrote to Peter Martin", "James Thomas Peter Martin"), ("Thomas Martin met Anna Maria Schmidt; Mr Martin left", "Thomas Martin Anna Maria Schmidt")):
        new, found = pii.replaced(text, c, {})
        assert not set(words_of(new)) & set(names.split()) and {text[lo:hi] for _, lo, hi in found} == set(names.split())
        assert len({(x, y) for x, y in zip(words_of(text), words_of(new), strict=True)}) == len(set(words_of(text)))
    assert pii.detect("Anna Anna and Peter") == []


def test_numbers_that_their_words_tell():
    import ipaddress

    c = pii.Cipher(b"key")
    text = "call 555-1234, passport no X1234567, from 2001:DB8:0:0::A1 (2001:db8::a1); pages 555-1234, at 12:30:45, std::vector, a::b, version 1:2:3:4"
    new, found = pii.replaced(text, c, {})
    assert [k for k, _, _ in found] == ["phone", "passport", "ipv6", "ipv6"]
    phone, passport, upper, lower = re.match(r"call (\d{3}-\d{4}), passport no ([A-Z]\d{7}), from (\S+) \((\S+)\);", new).groups()
    assert phone != "555-1234" and passport != "X1234567" and new.endswith("; pages 555-1234, at 12:30:45, std::vector, a::b, version 1:2:3:4")
    assert upper == lower.upper() and ipaddress.IPv6Address(lower) != ipaddress.IPv6Address("2001:db8::a1") and lower.startswith("2001:")


def test_clean_text_stays(documents, texts):
    got = by_id(pii.pseudonymised(documents, key=b"k").select("doc_id", "__v_pii.text", "__v_pii.entities"), "text", "entities")
    assert all((t == texts[i]) == (not e) for i, (t, e) in got.items()) and 0 < sum(bool(e) for _, e in got.values()) < len(got)


def plain_entities(text):
    """What a plain reader finds: mail addresses, and runs of digits in the shape of numbers, cards and addresses."""
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+", text or "", re.A)]
    for m in re.finditer(r"(?<![\w.@-])\d{3}-\d{2}-\d{4}(?![\w-])", text or ""):
        found.append((m.start(), m.end(), "ssn"))
    for m in re.finditer(r"(?<![\w.@-])\d{1,3}(?:\.\d{1,3}){3}(?![\w.-])", text or ""):
        if all(int(p) < 256 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"(?<![\w.@-])\d{4}(?: \d{4}){3}(?![\w-])", text or ""):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0:
            found.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"(?<![\w-])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![\w-])", text or ""):
        rest = 0
        for ch in m[0][4:] + m[0][:4]:
            rest = (rest * (10 if ch.isdigit() else 100) + int(ch, 36)) % 97
        if rest == 1:
            found.append((m.start(), m.end(), "iban"))
    for m in re.finditer(r"(?<![\w.@+-])\+\d{1,3}[ -]\d{3}[ -]\d{3}[ -]\d{4}(?![\w-])", text or ""):
        found.append((m.start(), m.end(), "phone"))
    for m in re.finditer(r"(?:Mrs|Mr|Ms|Herr|Frau)\.? ([A-Z][a-z]+)\b(?!-)", text or ""):
        found.append((*m.span(1), "name"))
    return found


def test_pii_against_a_plain_reader(spark, small, texts):
    """op4_pii on all documents: what the plain reader finds is replaced, alike wherever it occurs, by distinct values of its kind; the rest stays, piece by piece."""
    spark.conf.set(pii.KEY, "a test's key")
    out = by_id(registry.queries()["op4_pii"](spark, small), "text", "n_entities")
    spans = by_id(pii.pseudonymised(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), key=b"a test's key").select("doc_id", "__v_pii.text", "__v_pii.entities"), "text", "entities")
    new_of, n = defaultdict(set), 0
    for i, text in texts.items():
        new, found = spans[i]
        assert out[i] == (new, len(found))
        at, to, pairs = 0, 0, {}
        for k, e in enumerate(found):
            gap = text[at : e["start"]]
            assert new.startswith(gap, to)
            to += len(gap)
            after = text[e["end"] : found[k + 1]["start"] if k + 1 < len(found) else len(text)]
            size = e["end"] - e["start"]
            if e["kind"] != "ip" and "given" not in e["kind"]:  # of those the length may change
                end = to + size
            else:
                end = new.index(after, to) if after else len(new)
            pairs[e["start"], e["end"]] = new[to:end]
            at, to = e["end"], end
        assert new[to:] == text[at:]
        for lo, hi, kind in plain_entities(text):
            held = [x for x in pairs if x[0] <= lo and hi <= x[1]]
            assert held, (i, kind, text[lo:hi])
            n += 1
            if (lo, hi) in pairs:
                assert pairs[lo, hi].lower() != text[lo:hi].lower()
                assert kind == "name" or re.sub(r"\d+", "0", re.sub("[A-Za-z]", "a", pairs[lo, hi])) == re.sub(r"\d+", "0", re.sub("[A-Za-z]", "a", text[lo:hi]))
                new_of[kind, text[lo:hi].lower()].add(pairs[lo, hi].lower())
    assert n > 5 and all(len(x) == 1 for x in new_of.values())
    for kind in {k for k, _ in new_of}:
        values = [next(iter(x)) for (k, _), x in new_of.items() if k == kind]
        assert len(set(values)) == len(values)


def test_the_key_is_the_session_s(spark):
    spark.conf.unset(pii.KEY)
    a = pii.session_key(spark)
    assert a == pii.session_key(spark) and len(a) == 64
    spark.conf.set(pii.KEY, "mine")
    assert pii.session_key(spark) == b"mine"
    spark.conf.unset(pii.KEY)


def test_pii_odd(odd, none):
    got = pii.pseudonymised(odd, key=b"k")
    assert got.columns == [*odd.columns, "__v_pii"] and got.count() == odd.count() and pii.pseudonymised(none, key=b"k").count() == 0
    assert {r["doc_id"]: r["t"] for r in got.selectExpr("doc_id", "__v_pii.text t").collect()}[1] is None


# 5 tokens


def test_token_counts(spark, documents, texts, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_counts.MODEL))
    extra = ["<|endoftext|> a<|startoftext|>B", "it's I'LL they'd '", "Σας ΟΔΟΣ İstanbul ǅ", "é 中文字 １２ ½", "a b c\x85d\x1ce", "１²3 -- ''s !!'t"]
    df = documents.union(spark.createDataFrame([(10_000 + k, x) for k, x in enumerate(extra)], documents.schema))
    df = df.union(odd.where("doc_id IS NOT NULL").select(F.col("doc_id") + 20_000, "text"))
    got = {(r["doc_id"], r["text"]): r["n"] for r in df.select("doc_id", "text", token_count_of(spark, df).alias("n")).collect()}
    assert all(n == (len(t.encode(x, add_special_tokens=False).ids) if x else 0) for (_, x), n in got.items())
    assert none.select(token_count_of(spark, none)).count() == 0


def token_count_of(spark, df):
    return token_counts.token_count(spark, df)


def test_token_counts_are_the_same_without_tables(monkeypatch, texts):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "CACHE", 50)
    some = list(texts.values())[:30]
    a, b = (token_counts.Counter5(public_tokenizers.path(token_counts.MODEL), f) for f in ({}, {"the": 1}))
    assert a.count(some) == b.count(some) == a.whole(some)


# 6 simhash


def fingerprint_again(text):
    import xxhash

    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_brute_force(documents, texts):
    got = by_id(simhash.near_duplicates(documents).select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("f"), "component_id"), "f", "component_id")
    prints = {i: fingerprint_again(t) for i, t in texts.items()}
    assert got == {i: (f"{prints[i]:016x}", c) for i, c in linked(prints).items()}


def test_golay_keys_meet_within_two_bits():
    rng, code = np.random.default_rng(4), simhash.Golay()
    x = rng.integers(0, 1 << 63, 3000)
    for bits in ((), (1,), (2,)):
        y = x.copy()
        for _ in range(sum(bits)):
            y ^= np.int64(1) << rng.integers(0, 63, len(x))
        keys = [defaultdict(set) for _ in range(2)]
        for k, f in zip(keys, (x, y)):  # noqa: B905
            for i, key in zip(*simhash.keys_of(f, code)):  # noqa: B905
                k[i].add(key)
        assert all(keys[0][i] & keys[1][i] for i in range(len(x)))


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_in_large_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(9)
    prints = {}
    for c in range(4):
        base = rng.getrandbits(63)
        for k in range(60):
            f = base
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(63)
            prints.setdefault(f, len(prints))
    df = spark.createDataFrame([(f, i) for f, i in prints.items()], "f long, i long")
    found = {r["id"]: r["component"] for r in components.components(simhash.links(df)).collect()}
    want = linked({i: f for f, i in prints.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_components_of_long_chains(spark, monkeypatch):
    monkeypatch.setattr(components, "FOREST_EDGES", 7)
    edges = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)] + [(1000, k) for k in range(1001, 1100)]
    got = Counter(r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect())
    assert got == {0: 201, 500: 2, 1000: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_odd(spark, odd, none):
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count() and simhash.near_duplicates(none).count() == 0
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got.collect()}
    assert rows[1] == rows[2] == rows[3] == rows[12] == (0, 1) and rows[5][1] == 4 and rows[10][1] == 9 and rows[None][1] is None
    kept = simhash.keep_first(spark, odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 4, 6, 7, 8, 9, 11]


# 7 quality


def test_repeated_words_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abc" if k % 2 else "abcdefghijkl") * (1 + k % 3) for _ in range(rng.randint(0, 90)))) for k in range(60)] + [(100, "x " * 500), (101, "a b c d e f g h " * 2)]
    got = {r["k"]: r["n"] for r in spark.createDataFrame(rows, "k int, t string").select("k", quality.base_counts(F.col("t"))["n_repeat_words"].alias("n")).collect()}
    for k, t in rows:
        ws = t.split()
        seen = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        assert got[k] == len({i + j for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for j in range(8)})


def test_quality_odd(spark, odd, none):
    got = quality.judged(spark, odd)
    assert got.count() == odd.count() and quality.judged(spark, none).count() == 0
    b = {r["doc_id"]: (r["b"]["n_words"], r["b"]["word_chars"], r["__v_kept"]) for r in got.select("doc_id", F.col("__v_base").alias("b"), "__v_kept").collect()}
    assert b[1] == b[2] == b[3] == b[12] == (0, 0, False) and b[7][0] == 20_000 and b[11] == (1, 50_000, False)
    assert quality.keep_good(spark, odd).columns == odd.columns


def test_every_order_gives_the_same_verdict(spark, documents, monkeypatch):
    names = list(quality.rules(F.col("text"), F.col("__v_base")))
    seen = set()
    for order in (names, names[::-1]):
        monkeypatch.setattr(quality, "cascade_order", lambda *_, o=order: o)
        seen.add(tuple(sorted((r["doc_id"], r["__v_kept"]) for r in quality.judged(spark, documents).collect())))
    assert len(seen) == 1


# 8 language model


def scores_again(texts, order=3):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    counts = [Counter() for _ in range(order + 1)]
    for w in words.values():
        for n in range(1, order + 1):
            counts[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total = sum(counts[1].values())

    def s(g):
        if len(g) == 1:
            return counts[1][g] / total
        return counts[len(g)][g] / counts[len(g) - 1][g[:-1]] if counts[len(g)][g] > 1 else 0.4 * s(g[1:])

    return {i: sum(math.log10(s(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w))) for i, w in words.items()}


@pytest.mark.parametrize(("chunk", "bucket", "order"), [(1 << 24, 2_000_000, 3), (50_000, 20_000, 3), (50_000, 20_000, 2), (50_000, 20_000, 1)])
def test_scores_brute_force(documents, texts, chunk, bucket, order):
    got = by_id(ngram_lm.score_documents(documents, order=order, chunk_bytes=chunk, bucket_grams=bucket), "score")
    want = scores_again(texts, order)
    assert got.keys() == want.keys() and all(abs(got[i][0] - want[i]) < 1e-6 for i in want)


def test_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(1, 1 << 58, n, dtype=np.uint64))
        assert (ngram_lm.unpack(ngram_lm.pack(keys)) == keys).all()
    counts = rng.integers(1, 600, 500)
    assert (ngram_lm.unpack_counts(ngram_lm.pack_counts(counts), 500) == counts).all()


def test_scores_odd(odd, none):
    got = {r["doc_id"]: r for r in ngram_lm.score_documents(odd).collect()}
    assert got[1]["score"] == got[2]["score"] == got[12]["score"] == 0 and got[1]["mean_score"] is None and got[4]["score"] == got[5]["score"] < 0 and None in got
    assert ngram_lm.score_documents(none).count() == 0


# 9 sentencepiece


def test_pieces_are_the_library_s(spark, documents, odd, none):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    rng = random.Random(6)
    alphabet = "ab cde  the\n\t▁éßя中\U0001f600ng ing th e1.,\"'²"
    extra = [(50_000 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for k in range(500)] + [(60_000, " " * 700), (60_001, "ab" * 300), (60_002, "\x00a\x00")]
    df = documents.union(spark.createDataFrame(extra, documents.schema)).union(odd.where("doc_id IS NOT NULL").select(F.col("doc_id") + 90_000, "text"))
    for r in df.select("text", pieces.encoded(spark).alias("e")).collect():
        want = sp.encode(r["text"]) if r["text"] else []
        assert r["e"]["ids"] == want and r["e"]["decoded"] == (sp.decode(want) if want else "")
    assert none.select(pieces.encoded(spark)).count() == 0


@pytest.mark.parametrize("depth", [8, 20])
def test_suffix_array(depth):
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 100, 400).astype(np.uint8)
    raw = buf.tobytes()
    order = pieces.suffix_array(buf, depth)
    assert sorted(order) == list(range(400)) and all(raw[a : a + depth] <= raw[b : b + depth] for a, b in itertools.pairwise(order))


def test_long_units_and_small_caches(texts, monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(pieces.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(pieces, "CACHE", 10)
    monkeypatch.setattr(pieces, "PAIRS", 50)
    monkeypatch.setattr(pieces, "INDEX_BYTES", 500)
    model = pieces.Model(path)
    for coarse in (False, True):
        model.unit = pieces._UNIT if coarse else model.unit
        for t in list(texts.values())[:12]:
            assert np.frombuffer(model.encode([t])[0], "<i4").tolist() == sp.encode(t)


# 10 decontamination


def hits_again(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    ws, hit, ids = words(text), set(), set()
    for i, t in items.items():
        own = words(t)
        n = min(10, len(own))
        grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else ()
        for k in range(len(ws) - n + 1):
            if tuple(ws[k : k + n]) in grams:
                hit.update(range(k, k + n))
                ids.add(str(i))
    return len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


ITEMS = [(1, "One two THREE four five six seven eight nine ten eleven twelve"), (2, "short item"), (10, "Short, item!"), (3, None), (4, ""), (5, "..."), (6, "ñandú 中文"), (7, "five six seven eight nine ten eleven twelve one two")]
DOCS = [(1, None), (2, ""), (3, "x one two three four five six seven eight nine ten y"), (4, "A SHORT-ITEM here, short item"), (5, "shorts item"), (6, "ñandú, 中文."), (7, "one two three four five six seven eight nine ten eleven twelve one two three"), (8, "shortitem"), (9, "(one, two) " * 3), (9, "short item " * 2000)]


@pytest.mark.parametrize("bound", [1 << 20, 30])
def test_decontamination_brute_force(spark, bound):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = docs.select("doc_id", "text", decontaminate.hits(spark, bench, automaton_bytes=bound).alias("h")).collect()
    for r in got:
        n, hit, n_items, digest = hits_again(r["text"], dict(ITEMS))
        ids = r["h"]["item_ids"]
        assert (r["h"]["n_words"], r["h"]["n_hit"], len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()) == (n, hit, n_items, digest)
        inside = sum(len(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", r["text"][a:b])) for a, b in r["h"]["spans"])
        assert inside == hit


def test_decontamination_odd(spark, odd, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.decontaminate(spark, odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontaminate.decontaminate(spark, odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.decontaminate(spark, none, bench).count() == 0


def test_items_without_an_id(spark, tmp_path):
    import duckdb

    docs = [(1, "Here one two three four stand"), (2, "five six seven and one two three four"), (3, "nothing"), (4, None)]
    items = [(None, "one two three four"), (None, "seven and"), ("b", "one two three"), ("a", None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = decontaminate.op10_decontaminate(spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(con.sql(decontaminate.ORACLE).df())
    for bound in (1 << 20, 5):
        found = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", decontaminate.hits(spark, spark.createDataFrame(items, "item_id string, text string"), automaton_bytes=bound).alias("h")).collect()
        assert {r["doc_id"]: (r["h"]["n_hit"], r["h"]["item_ids"]) for r in found} == {1: (4, ["b", None]), 2: (6, ["b", None]), 3: (0, []), 4: (0, [])}
