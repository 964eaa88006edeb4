import pytest
from pyspark.sql import functions as F
from test_operators import removed_lines

from vektorium.llm import lines

TEXTS = ["a b c d e\n  a  b c d e \nx\ty z", "x y z\n\na b c d e f", "z  y x\nq\rr\ns t", " s  t\nq r\n\x0b", "one two three four five six", "one two three four five seven\none two three four five six"]


@pytest.mark.parametrize("ids", [[5, 6, 7, 8, 9, 10], [-(2**63), -5, 0, 7, 2**40, 2**63 - 1], [-(2**31), -1, 0, 1, 2, 2**31 - 1], [-(2**31) - 1, -1, 0, 1, 2, 2**31 - 1]])
def test_ids_near_and_far(spark, ids):
    own = dict(zip(ids, TEXTS, strict=True))
    gone = removed_lines(own)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark, spark.createDataFrame(list(own.items()), "doc_id long, text string")).collect()}
    assert got == {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in own.items()}


def test_places_are_ordered():
    assert lines.Places.over(3, 3 + 2**32 - 1, False).base == 3
    assert lines.Places.over(3, 3 + 2**32, False).base is None and lines.Places.over(3, 4, True).base is None and lines.Places.over(None, None, False).base is None


def test_lines_are_grouped_without_a_sort(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc long, text string").withColumn("sub", F.lit(0).cast("long"))
    plan = lines.first_lines(docs, 1 << 14, lines.Places(0))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_double_blanks_take_no_scan(spark):
    df = spark.createDataFrame([(" a  b ",), ("a b",), ("  ",), ("a\tb",)], "line string")
    assert [r["t"] for r in df.select(lines.tokens(F.col("line")).alias("t")).collect()] == [["a", "b"], ["a", "b"], [], ["a", "b"]]
    plan = df.select(lines.tokens(F.col("line")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(line" in plan and ",   )" not in plan


def test_parities_take_no_filter_and_classes_are_no_column(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j % 97}" for j in range(k, k + 9 * k % 150)) + "\nx y") for k in range(40)], "doc long, text string").withColumn("sub", F.lit(0).cast("long"))
    firsts = lines.first_lines(docs, 1 << 14, lines.Places(0))
    plan = firsts._jdf.queryExecution().optimizedPlan().toString()
    assert " AS classes#" not in plan and "filter(keys" not in plan
    assert all(bin(r["p"] & (1 << 64) - 1).count("1") % 2 == r["n"] % 2 for r in firsts.select("p", "n").collect())


def test_untouched_texts_are_not_split(spark):
    df = spark.createDataFrame([("a\nb\n", None), ("", None), (None, None), ("é\n\nb", [1])], "text string, removed array<int>")
    got = [tuple(r["x"]) for r in df.select(lines.without_lines(F.col("text"), F.col("removed")).alias("x")).collect()]
    assert got == [("a\nb\n", 3, 0), ("", 1, 0), (None, 0, 0), ("é\nb", 3, 1)]
    plan = df.select(lines.without_lines(F.col("text"), F.col("removed")))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan
