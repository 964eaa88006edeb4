import gzip
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vektorium.sources import jsonarrays as ja

TEXT = st.text(st.sampled_from('ab"\\[]{},: ü\n'), max_size=9)
VALUES = st.recursive(TEXT | st.integers(-9, 9) | st.none() | st.booleans(), lambda x: st.lists(x, max_size=3) | st.dictionaries(TEXT, x, max_size=3), max_leaves=8)


def by_ranges(data: bytes, size: int) -> list[bytes]:
    """The elements as the two passes find them."""
    ranges = [ja.Range("x", at, min(at + size, len(data))) for at in range(0, len(data), size)]
    ja.placed(ranges, [ja.shape(io.BytesIO(data), r.start, r.end) for r in ranges[:-1]])
    return [t for r in ranges for t in ja.elements(io.BytesIO(data), r)]


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUES, max_size=6), st.integers(1, 40), st.booleans(), st.sampled_from([1, 3, 1 << 20]))
def test_any_ranges_give_the_elements(values, size, spaced, piece):
    data = (" \n" + json.dumps(values, ensure_ascii=False, indent=1 if spaced else None) + " ").encode()
    held = ja.PIECE, ja.BEYOND
    ja.PIECE, ja.BEYOND = piece, 2
    try:
        assert [json.loads(t) for t in by_ranges(data, size)] == values
        assert [json.loads(t) for t in ja.elements(io.BytesIO(data), ja.Range("x", 0, None))] == values
    finally:
        ja.PIECE, ja.BEYOND = held


@pytest.mark.parametrize("data", ['[{"a":1}', '[{"a":1}]]', "[1][2]", "[1,]", "[,1]", "[1,,2]", '{"a":1}', "7", '"a"', '"a', "[1] x", '["a]', "]", "[[1]"])
@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_what_is_no_array_fails(data, size):
    with pytest.raises(ValueError):
        by_ranges(data.encode(), size)
    with pytest.raises(ValueError):
        list(ja.elements(io.BytesIO(data.encode()), ja.Range("x", 0, None)))


@pytest.mark.parametrize("data", [b"", b" \n ", b"[]", b" [ ] ", b"\xef\xbb\xbf[]"])
def test_nothing_in_it(data):
    assert by_ranges(data, 4) == [] and list(ja.elements(io.BytesIO(data), ja.Range("x", 0, None))) == []


SCHEMA = "id long, s string, more array<struct<x:array<long>>>"
ROWS = [{"id": k, "s": ['"', "]},{[", "\\", '\\"', "ü\n", None][k % 6], "more": [{"x": list(range(k % 4))}] * (k % 3), "unknown": {"a": ["]"]}} for k in range(500)]


def test_files_by_ranges(spark, tmp_path):
    """Plain files are split, a compressed one is whole, and other files are left alone."""
    a, b, c = (json.dumps(r, ensure_ascii=False).encode() for r in (ROWS[:300], ROWS[300:400], ROWS[400:]))
    (tmp_path / "a.json").write_bytes(a)
    (tmp_path / "b.json").write_bytes(b"\xef\xbb\xbf" + b)
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(c[:50]) + gzip.compress(c[50:]))
    (tmp_path / "d.json").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    want = sorted((r["id"], r["s"], [m["x"] for m in r["more"]]) for r in [{**r, "s": r["s"] or ""} for r in ROWS])
    for path in (str(tmp_path), f"file://{tmp_path}"):
        found = ja.read_json_arrays(spark, path, SCHEMA, range_bytes=1_000)
        assert found.rdd.getNumPartitions() == -(-len(a) // 1_000) + -(-(len(b) + 3) // 1_000) + 1
        assert sorted((r["id"], r["s"] or "", [m["x"] for m in r["more"]]) for r in found.collect()) == want
    one = ja.read_json_arrays(spark, str(tmp_path / "a.json"), SCHEMA)
    assert one.rdd.getNumPartitions() == 1 and one.count() == 300
    spark.dataSource.register(ja.JsonArrays)
    assert spark.read.format("json_arrays").load(str(tmp_path)).count() == 500


def test_a_long_record_is_whole(spark, tmp_path):
    long = [{"id": k, "s": '"]\\' * 100_000} for k in range(3)]
    (tmp_path / "a.json").write_text(json.dumps(long))
    found = ja.read_json_arrays(spark, str(tmp_path), SCHEMA, range_bytes=50_000)
    assert sorted((r["id"], r["s"]) for r in found.collect()) == [(r["id"], r["s"]) for r in long]


def test_broken_and_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ja.read_json_arrays(spark, str(tmp_path / "none"), SCHEMA)
    assert ja.read_json_arrays(spark, str(tmp_path), SCHEMA).collect() == []
    (tmp_path / "a.json").write_text('[{"id":1},{"id":2,]')
    with pytest.raises(Exception, match=r"no JSON array|text without an end|MALFORMED"):
        ja.read_json_arrays(spark, str(tmp_path), SCHEMA, range_bytes=4).collect()
    (tmp_path / "a.json").write_text('[{"id":1},{"id":x}]')
    with pytest.raises(Exception, match="MALFORMED"):
        ja.read_json_arrays(spark, str(tmp_path), SCHEMA, range_bytes=4).collect()
