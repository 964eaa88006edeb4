"""Line dedup as an exact set-similarity join, in DataFrame functions only."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, is_small, keyed, let, stored, table
from .quality import BLANK, word_array

#: Lines are alike at this Jaccard similarity of their token sets or more: 4/5.
NUMERATOR, DENOMINATOR = 4, 5
#: Token counts are kept in so many slots for each document, a power of two between these bounds; tokens share slots by hash.
DOCUMENT_SLOTS, SLOTS = 2, (1 << 14, 1 << 22)
#: Lines with one of their CROWD_KEYS keys in common with more than CROWD lines are first compared with HEADS of those at most.
CROWD_KEYS, CROWD, HEADS = 2, 4, 1
#: Sets of so many tokens have a parity of two words.
WIDE = 64
#: Bits of a place that hold a line's position in its text, where places are single numbers.
POSITION_BITS = 31
#: Bits of a token's key that hold its hash, below its rarity class.
HASH_BITS = 56


class Places(NamedTuple):
    """Where a line stands, as one orderable value: a number where ids are near each other and none is shared, else a struct.

    Numbers keep the aggregations over places on fixed buffers, which need no sort. base: the least id, None for structs.
    """

    base: int | None

    @classmethod
    def over(cls, least: int | None, greatest: int | None, shared: bool) -> Places:
        near = least is not None and greatest - least < 1 << 63 - POSITION_BITS
        return cls(least if near and not shared else None)

    def of(self, doc: Column, sub: Column, pos: Column) -> Column:
        if self.base is None:
            return F.struct(doc.alias("doc"), sub.alias("sub"), pos.alias("pos"))
        return F.shiftleft(doc - F.lit(self.base).cast("long"), POSITION_BITS).bitwiseOR(pos.cast("long"))

    def parts(self, at: Column) -> list[Column]:
        """doc, sub and pos of a place."""
        if self.base is None:
            return [at["doc"].alias("doc"), at["sub"].alias("sub"), at["pos"].alias("pos")]
        pos = at.bitwiseAND(F.lit((1 << POSITION_BITS) - 1).cast("long")).cast("int")
        return [(F.shiftright(at, POSITION_BITS) + F.lit(self.base).cast("long")).alias("doc"), F.lit(0).cast("long").alias("sub"), pos.alias("pos")]


def _other_blanks(text: Column) -> Column:
    """Whether a text has blanks other than spaces and line feeds. Each is one byte, which a scan finds without comparing parts."""
    odd = F.lit(False)
    for blank in ("\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(text, F.lit(blank))
    return odd


def tokens(line: Column) -> Column:
    """A line's tokens. Splitting at single spaces is the quick way, open to lines without other blanks; empty parts go after it."""
    return F.when(_other_blanks(line), word_array(line)).otherwise(F.array_remove(F.split(line, " "), ""))


def _words(text: Column) -> Column:
    """A text's tokens, empty parts among them. Splitting at single spaces is the quick way, open to texts without other blanks than line feeds."""
    return F.when(_other_blanks(text), F.split(text, "[ \\t-\\r]+")).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "))


def _slot(h: Column, slots: int) -> Column:
    return h.bitwiseAND(F.lit(slots - 1)).cast("int")


def rarity(docs: DataFrame, text: str, slots: int) -> DataFrame:
    """One row (a, m): an array of ``slots`` classes, 0 to 127, two for each doubling of a slot's token count over the whole corpus, and about the middle class of all tokens."""
    spark = docs.sparkSession
    found = docs.select(F.explode(_words(F.col(text))).alias("w")).where("w != ''").select(_slot(F.xxhash64("w"), slots).alias("s"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("s"), F.lit(0).cast("long").alias("n"))
    counts = found.groupBy("s").agg(F.count(F.lit(1)).alias("n")).union(every).groupBy("s").agg(F.sum("n").alias("n"))
    classes = counts.select("s", "n", F.least(F.lit(127), F.floor(2 * F.log2(1 + F.col("n")))).cast("tinyint").alias("c"))
    # in two steps, so that the last one gets a few rows
    middle = F.percentile("c", 0.5, F.col("n"))
    parts = classes.groupBy(F.shiftright("s", 12).alias("part")).agg(F.sort_array(F.collect_list(F.struct("s", "c"))).alias("a"), middle.alias("m"), F.sum("n").alias("n"))
    whole = parts.agg(F.sort_array(F.collect_list(F.struct("part", F.col("a.c").alias("c")))).alias("a"), F.percentile("m", 0.5, F.col("n")).alias("m"))
    return whole.select(F.flatten("a.c").alias("a"), F.coalesce("m", F.lit(0)).cast("long").alias("m"))


def token_keys(line: Column, classes: Column, slots: int) -> Column:
    """A line's distinct tokens as numbers, rarest class first and by hash within a class."""

    def key(h):
        rare = F.coalesce(F.get(classes, _slot(h, slots)), F.lit(0).cast("tinyint"))  # never null, which keeps the sort on primitive values
        return F.shiftleft(rare.cast("long"), HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))

    return F.sort_array(F.array_distinct(F.transform(F.transform(tokens(line), lambda w: F.xxhash64(w)), key)))


def _least_overlap(n: Column) -> Column:
    """ceil(t n)"""
    return F.floor((n * NUMERATOR + DENOMINATOR - 1) / DENOMINATOR).cast("int")


def _least_overlap_of_shorter(n: Column) -> Column:
    """ceil(2 t / (1 + t) n): what a set has in common at least with one that is alike and no smaller."""
    whole = NUMERATOR + DENOMINATOR
    return F.floor((n * 2 * NUMERATOR + whole - 1) / whole).cast("int")


def exploded(docs: DataFrame, places: Places) -> DataFrame:
    """(at, line) for each line."""
    lines = docs.select("doc", "sub", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(places.of(F.col("doc"), F.col("sub"), F.col("pos")).alias("at"), "line")


def _parity(keys: Column) -> Column:
    """Which of 64 bits are those of an odd number of members. A member's bit is told by a hash, of which a shift takes the low six bits."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(x))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x)))


def _differing(x: str, y: str) -> Column:
    """Bits in which two sets' parities differ: no more than the members of one set alone.

    Two sets of WIDE tokens are told apart by twice as many bits: q is the parity of the members of
    the middle rarity class or above, and so p without q that of the rest.
    """
    p, q = (F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}")) for w in ("p", "q"))
    both = F.bit_count(p.bitwiseXOR(q)) + F.bit_count(q)
    return F.when(F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) >= WIDE, both).otherwise(F.bit_count(p))


def first_lines(docs: DataFrame, slots: int, places: Places) -> DataFrame:
    """A row for each different line with a token: where it is first, its number of tokens, its prefix, its set's parity and its keys for crowds()."""
    # the classes come in after the lines are made: a generator would copy them with each line
    some = (F.col("line") >= "!") | (F.btrim("line", F.lit(BLANK)) != "")
    classes = cut(rarity(docs, "text", slots))
    # each by itself and named once, or else the classes would be a column of every line
    per_line = exploded(docs, places).where(some).withColumn("classes", classes.select("a").scalar())
    middle = F.shiftleft(classes.select("m").scalar(), HASH_BITS)
    per_line = per_line.select("at", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), token_keys(F.col("line"), F.col("classes"), slots).alias("keys"), middle.alias("middle"))
    # the middle key, put among a line's own, tells where its common tokens begin; sorting and slicing take no lambda, which is far dearer
    n, own = F.size("keys"), F.sort_array(F.array_append("keys", F.col("middle")))
    per_line = per_line.select("at", "h", "g", n.alias("n"), F.slice("keys", 1, n - _least_overlap(n) + 1).alias("prefix"), "keys", (F.array_position(own, F.col("middle")) - 1).cast("int").alias("rare"))
    per_line = per_line.select("at", "h", "g", "n", "prefix", F.slice("keys", 1, F.col("rare")).alias("rare"), F.slice("keys", F.col("rare") + 1, F.col("n")).alias("common"))
    # both are named twice, so that they are made by themselves and not within a lambda's call
    per_line = per_line.select("at", "h", "g", (F.size("rare") + F.size("common")).alias("n"), "prefix", _parity(F.col("rare")).alias("r"), _parity(F.col("common")).alias("c"))
    shaped = per_line.select("at", "h", "g", "n", "prefix", F.col("r").bitwiseXOR(F.col("c")).alias("p"), F.when(F.col("n") >= WIDE, F.col("c")).otherwise(F.lit(0).cast("long")).alias("q"))
    # what a line's text tells is part of the key, not a first() of the group, which would sort the lines
    firsts = shaped.groupBy("h", "g", "n", "p", "q", "prefix").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"))
    firsts = firsts.withColumn("hashes", F.transform("prefix", lambda t: F.shiftleft(t, 64 - HASH_BITS)))
    return firsts.withColumn("least", F.array(*[_least("hashes", r) for r in range(CROWD_KEYS)])).drop("hashes")


def _least(hashes: str, r: int) -> Column:
    """The least of the hashes in the r-th of several orders: upwards, downwards, then each by the hash with other bits turned."""
    if r < 2:
        return F.array_min(hashes) if r == 0 else F.array_max(hashes)
    turned = F.lit(int.from_bytes(hashlib.blake2b(b"%d" % r, digest_size=8).digest(), "big", signed=True)).cast("long")
    return F.array_min(F.transform(hashes, lambda t: t.bitwiseXOR(turned)))


def _before(x: str, y: str) -> Column:
    return F.col(f"{x}.at") < F.col(f"{y}.at")


def _alike(x: str, y: str) -> Column:
    """The length and parity filters: false only for sets that aren't alike."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    length = (DENOMINATOR * nx >= NUMERATOR * ny) & (DENOMINATOR * ny >= NUMERATOR * nx)
    # overlap >= t / (1 + t) (nx + ny); the symmetric difference has nx + ny - 2 overlap members, and no fewer than the bits in which the parities differ
    whole = NUMERATOR + DENOMINATOR
    return length & (whole * (nx + ny - _differing(x, y)) >= 2 * NUMERATOR * (nx + ny))


def _position(x: str, y: str) -> Column:
    """The positional filter on two postings of a token, for a pair's first common token: what comes after it in both sets can't be enough."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    i, j = (F.shiftright(f"{side}.i", 2) for side in (x, y))
    return (NUMERATOR + DENOMINATOR) * (1 + F.least(nx - i, ny - j)) >= NUMERATOR * (nx + ny)


def _ends(x: str, y: str) -> list[Column]:
    return [F.col(f"{x}.at").alias("xat"), F.col(f"{y}.at").alias("yat")]


def verified(docs: DataFrame, pairs: DataFrame, places: Places) -> DataFrame:
    """The places of the later lines y of pairs whose token sets are alike, by the words themselves."""
    pairs = cut(pairs)
    ends = pairs.select(F.col("xat").alias("at")).union(pairs.select(F.col("yat").alias("at"))).select(*places.parts(F.col("at")))
    wanted = cut(ends.groupBy("doc", "sub").agg(F.collect_set("pos").alias("wanted")))
    side = F.broadcast(wanted) if is_small(wanted, 40 + 4 * F.size("wanted")) else wanted
    held = docs.join(side, ["doc", "sub"]).select("doc", "sub", "wanted", F.split("text", "\n").alias("ls"))
    held = held.select("doc", "sub", F.explode(F.transform("wanted", lambda p: F.struct(p.alias("pos"), F.get("ls", p).alias("line")))).alias("w"))
    words = held.select(places.of(F.col("doc"), F.col("sub"), F.col("w.pos")).alias("at"), F.col("w.line").alias("line"))
    named = lambda s: words.select(F.col("at").alias(f"{s}at"), F.col("line").alias(f"{s}s"))
    joined = pairs.join(named("x"), "xat").join(named("y"), "yat")
    distinct = lambda c: F.array_distinct(tokens(F.col(c)))
    # in one value, as a filter would make the sets anew wherever it names them
    alike = lambda s: (NUMERATOR + DENOMINATOR) * F.size(F.array_intersect(s["x"], s["y"])) >= NUMERATOR * (F.size(s["x"]) + F.size(s["y"]))
    sets = joined.where(let(F.struct(distinct("xs").alias("x"), distinct("ys").alias("y")), alike))
    return sets.select(F.col("yat").alias("at")).distinct()


def crowds(firsts: DataFrame) -> DataFrame:
    """Pairs of a line of a crowd and the likeliest match among a few heads of it, at most one for each line.

    A line's keys are the least of its prefix tokens by a few hashes, so that near copies, whatever
    their edits, share most of them. A crowd is the lines with a key in common, and its heads are the
    earliest of each of HEADS groups of them by hash: the cost is in proportion to the crowd.
    """
    keyed_ = firsts.select("at", "n", "p", "q", F.explode("least").alias("key"))
    part = F.pmod(F.xxhash64("at"), F.lit(HEADS))
    heads = []
    for k in range(HEADS):  # by min_by alone, which needs no sort
        own = F.when(part == k, F.col("at"))
        heads.append(F.struct(F.min(own).alias("at"), *[F.min_by(c, own).alias(c) for c in ("n", "p", "q")]))
    found = keyed_.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *[h.alias(f"h{k}") for k, h in enumerate(heads)]).where(F.col("c") > CROWD)
    x = cut(found.select("key", F.explode(F.array(*[f"h{k}" for k in range(HEADS)])).alias("x")).select("key", "x.*").where("at IS NOT NULL"))
    x = (F.broadcast(x) if is_small(x, 64) else x).alias("x")
    stars = keyed_.alias("y").join(x, (F.col("x.key") == F.col("y.key")) & _before("x", "y") & _alike("x", "y"))
    return likeliest(stars.select(*_ends("x", "y"), _differing("x", "y").alias("d")))


def likeliest(pairs: DataFrame) -> DataFrame:
    """Of each later line's pairs the one whose parities differ least, and how many it had."""
    return pairs.groupBy("yat").agg(F.min_by("xat", "d").alias("xat"), F.count(F.lit(1)).alias("c"))


def later_matches(docs: DataFrame, firsts: DataFrame, places: Places) -> DataFrame:
    """Places of the lines that are alike to a different line with an earlier first place.

    Lines of crowds are compared with a few heads first, which finds a match for most members of a
    large group; only lines that this leaves meet all earlier lines with a prefix token in common,
    so that nothing is lost.
    """
    found = cut(verified(docs, crowds(firsts), places))
    settled = found.withColumn("settled", F.lit(True))
    marked = firsts.join(F.broadcast(settled) if is_small(settled, 40) else settled, "at", "left")
    postings = marked.select("at", "n", "p", "q", F.coalesce("settled", F.lit(False)).cast("int").alias("settled"), F.posexplode("prefix").alias("i", "token"))
    # i: the token's place in its line from 1, and in the two lowest bits whether it is in the prefix that does if no
    # shorter line is met, and whether the line is settled; so both sides read the same exchange
    early = (F.col("i") <= F.col("n") - _least_overlap_of_shorter(F.col("n"))).cast("int")
    postings = postings.select("token", "at", "n", F.shiftleft(F.col("i") + 1, 2).bitwiseOR(F.shiftleft(early, 1)).bitwiseOR(F.col("settled")).alias("i"), "p", "q")
    x, y = postings.alias("x"), postings.alias("y")
    # x is the shorter line, or the earlier of two of one length; all conditions name both sides, as others would be filters below the exchange
    reach = F.when(F.col("x.i").bitwiseAND(F.lit(2)) != 0, F.col("x.n")).otherwise(F.lit((1 << 31) - 1)) <= F.col("y.n")
    once = (F.col("x.n") != F.col("y.n")) | _before("x", "y")
    open_ = F.when(_before("x", "y"), F.col("y.i")).otherwise(F.col("x.i")).bitwiseAND(F.lit(1)) == 0
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & reach & once & open_ & _position("x", "y") & _alike("x", "y"))
    pairs = cut(pairs.select(F.least("x.at", "y.at").alias("xat"), F.greatest("x.at", "y.at").alias("yat"), _differing("x", "y").alias("d")).distinct())
    # the likeliest pair of each line first; all others only of lines for which that was not one
    best = cut(likeliest(pairs))
    more = cut(verified(docs, best, places))
    left = cut(best.where("c > 1").join(more.select(F.col("at").alias("yat")), "yat", "left_anti").select("yat"))
    rest = pairs.join(F.broadcast(left) if is_small(left, 40) else left, "yat", "left_semi")
    return found.union(more).union(verified(docs, rest, places)).distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc, sub, removed): the positions of the lines that match an earlier line, removed or not, for each of keyed() documents that has any.

    Lines are what line feeds separate, tokens runs of non-blank characters, a line's set its distinct
    tokens; places are ordered by document id, then, where texts share an id, by the text's number,
    then by position. Two lines match if their sets are equal or have a Jaccard similarity of 4/5 or
    more; lines without tokens match nothing. Null ids and null and empty texts have no lines, an
    empty table gives none. Rows of one id with different texts are different documents, rows of one
    id and equal text the same. Texts and lines of any length are read whole.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"), F.max("doc").alias("greatest"), F.coalesce(F.max(F.col("sub") != 0), F.lit(False)).alias("shared")).first()
    slots = min(SLOTS[1], max(SLOTS[0], 1 << (DOCUMENT_SLOTS * ids["n"] + 1).bit_length() - 1))
    places = Places.over(ids["least"], ids["greatest"], ids["shared"])
    docs = docs.where("doc IS NOT NULL AND text IS NOT NULL")
    firsts = stored(first_lines(docs, slots, places))
    copied = firsts.where("copies > 1").select("h", "g", F.col("at").alias("first"))
    lines = exploded(docs, places).select("at", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))
    side = F.broadcast(copied) if is_small(copied, 48) else copied
    copies = lines.join(side, ["h", "g"]).where("at != first").select("at")
    gone = copies.union(later_matches(docs, firsts, places)).select(*places.parts(F.col("at")))
    removed = cut(gone.groupBy("doc", "sub").agg(F.collect_set("pos").alias("removed")))
    discard(firsts)
    return removed


def without_lines(text: Column, removed: Column) -> Column:
    """A struct of the text without the lines at the given positions, how many lines it had and how many went."""

    def of(ls):
        at = F.sequence(F.lit(0), F.size(ls) - 1)
        kept = F.array_except(at, removed)
        return F.struct(F.array_join(F.transform(kept, lambda p: F.get(ls, p)), "\n").alias("text"), F.size(ls).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"))

    def whole(n):
        return F.struct(text.alias("text"), n.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))

    # a text that keeps all its lines is not split: they are its line feeds and one
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text.isNull(), whole(F.lit(0))).when(removed.isNull(), whole(feeds + 1)).otherwise(let(F.split(text, "\n"), of))


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with later matches of lines removed from the text; ``__v_lines`` tells of each what without_lines() does.

    All rows and columns stay, null texts as null; a text may end up empty. The positions to remove
    are broadcast if they are measured to be few, else joined by a shuffle.
    """
    own = keyed(docs, id_col, text)
    removed = repeated_lines(own.select(F.col("__v_doc").alias("doc"), F.col("__v_sub").alias("sub"), F.col(text).alias("text")))
    removed = removed.select(F.col("doc").alias("__v_doc"), F.col("sub").alias("__v_sub"), F.col("removed").alias("__v_removed"))
    side = F.broadcast(removed) if is_small(removed, 56 + 4 * F.size("__v_removed")) else removed
    cut_ = own.join(side, ["__v_doc", "__v_sub"], "left").withColumn("__v_lines", without_lines(F.col(text), F.col("__v_removed")))
    return cut_.select(*[F.col("__v_lines.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], "__v_lines")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "__v_lines.n_lines", "__v_lines.n_removed")


ORACLE = r"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, list_distinct(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS ws
           FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
s AS (SELECT min({'d': doc_id, 'i': i}) AS loc, w, len(w) AS n FROM (SELECT doc_id, i, list_sort(ws) AS w FROM l WHERE len(ws) > 0) GROUP BY w),
t AS (SELECT loc, n, unnest(w) AS tok FROM s),
f AS (SELECT tok, count(*) AS df FROM t GROUP BY tok),
p AS (SELECT loc, n, tok FROM (SELECT loc, n, t.tok, row_number() OVER (PARTITION BY loc ORDER BY df, t.tok) AS k FROM t JOIN f ON f.tok = t.tok)
      WHERE k <= n - (4*n + 4) // 5 + 1),
c AS (SELECT DISTINCT x.loc AS xa, y.loc AS ya FROM p x JOIN p y ON x.tok = y.tok AND x.loc < y.loc AND 5*x.n >= 4*y.n AND 5*y.n >= 4*x.n),
m AS (SELECT DISTINCT ya AS loc FROM c JOIN s a ON a.loc = xa JOIN s b ON b.loc = ya WHERE 5*len(list_intersect(a.w, b.w)) >= 4*(a.n + b.n - len(list_intersect(a.w, b.w)))),
g AS (SELECT l.doc_id, l.i FROM l JOIN s ON s.w = list_sort(l.ws) LEFT JOIN m ON m.loc = s.loc WHERE len(l.ws) > 0 AND (m.loc IS NOT NULL OR s.loc.d <> l.doc_id OR s.loc.i <> l.i))
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text, count(*) AS n_lines, count(g.i) AS n_removed
FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
"""
