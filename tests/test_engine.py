import json
import shutil

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vektorium.functions import scalars as s
from vektorium.functions.features import is_valid, request_features
from vektorium.operators import evaluate, index, kmeans, ranges, search, tree
from vektorium.schema import DIM
from vektorium.sources import ingest, records, requests

#: A Saturday's purchase. Expected values are worked out by hand in the tests.
PAYLOAD = {
    "id": "order 77",
    "transaction": {"amount": 1234.5, "installments": 6, "requested_at": "2025-11-15T21:07:30Z"},
    "customer": {"avg_amount": 617.25, "tx_count_24h": 5, "known_merchants": ["bakery", "garage"]},
    "merchant": {"id": "garage", "mcc": "7801", "avg_amount": 2500.0},
    "terminal": {"is_online": True, "card_present": False, "km_from_home": 40.0},
    "last_transaction": None,
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def parsed(spark, payload):
    body = payload if isinstance(payload, str) else json.dumps(payload)
    return spark.createDataFrame([(body,)], "body string").select(requests.parse_body(F.col("body")).alias("r"))


def test_features_of_a_request(spark):
    df = parsed(spark, PAYLOAD)
    got = df.select(*[f.alias(f"f{k}") for k, f in enumerate(request_features(F.col("r")))]).first()
    # 1234.5/10000, 6/12, (1234.5/617.25)/10, 21/23, day 5 of 0-6, no last one twice, 40/1000, 5/20, online, no card, known, risk, 2500/10000
    assert list(got) == [0.1235, 0.5, 0.2, 0.913, 0.8333, -1.0, -1.0, 0.04, 0.25, 1.0, 0.0, 0.0, 0.8, 0.25]
    assert df.select(is_valid(F.col("r")).alias("x")).first()["x"]


def test_features_without_average_and_with_last_transaction(spark):
    payload = json.loads(json.dumps(PAYLOAD))
    payload["customer"]["avg_amount"] = 0.0
    payload["last_transaction"] = {"timestamp": "2025-11-15T09:07:30Z", "km_from_current": 730.0}
    got = list(parsed(spark, payload).select(*request_features(F.col("r"))).first())
    assert got[2] == 1.0 and got[5] == 0.5 and got[6] == 0.73  # half a day of 1440 minutes


@pytest.mark.parametrize("body", ['{"id": 1', "", "[]", json.dumps(PAYLOAD | {"merchant": None}), json.dumps(PAYLOAD | {"transaction": {"amount": 1.0, "installments": 1, "requested_at": "2025-11-31T21:07:30Z"}})])
def test_malformed_bodies_are_rejected(spark, body):
    assert not parsed(spark, body).select(is_valid(F.col("r")).alias("x")).first()["x"]


@pytest.mark.parametrize(("x", "q"), [(0.9999, 9999), (0.99996, 10000), (7.25, 10000), (0.00004, 0), (0.12345, 1235), (-0.0001, -10000), (-42.0, -10000), (0.0, 0)])
def test_quantize(spark, x, q):
    assert one(spark, s.quantize(s.d(x))) == q


@pytest.mark.parametrize(("mcc", "risk"), [("5411", 0.15), ("7995", 0.85), ("9999", 0.5), ("", 0.5), (None, 0.5)])
def test_risk(spark, mcc, risk):
    assert one(spark, s.risk(F.lit(mcc).cast("string"))) == risk


def ints(values):
    return F.array(*[F.lit(v) for v in values])


def test_distances(spark):
    ramp, back = list(range(0, 14000, 1000)), list(range(13000, -1000, -1000))
    # differences 13000, 11000, ..., 1000 and back: 2 (1 + 9 + 25 + ... + 169) = 910 millions
    assert one(spark, s.squared_distance(ints(ramp), ints(back))) == 910_000_000
    assert one(spark, s.squared_distance(ints(ramp), ints(ramp))) == 0
    assert one(spark, s.squared_distance(ints([-10000, 3] * 7), ints([10000, 7] * 7))) == 7 * (20000**2 + 4**2)
    # outside of the box by 2000 in the first, by 500 in the last coordinate
    assert one(spark, s.box_lower_bound(ints([0, *[50] * 12, 900]), ints([2000, *[0] * 13]), ints([9000, *[100] * 12, 400]))) == 2000**2 + 500**2
    assert one(spark, s.box_lower_bound(ints([7] * 14), ints([7] * 14), ints([8] * 14))) == 0


def test_verdicts(spark):
    got = spark.range(6).select(s.approved(F.col("id")).alias("a"), s.fraud_score(F.col("id")).alias("f"), s.verdict_json(F.col("id")).alias("j")).collect()
    assert [(r["a"], r["f"]) for r in got] == [(True, 0.0), (True, 0.2), (True, 0.4), (False, 0.6), (False, 0.8), (False, 1.0)]
    assert got[3]["j"] == '{"approved":false,"fraud_score":0.6}'


def test_routing(spark):
    body = json.dumps(PAYLOAD)
    size = len(body)
    raw = [
        ("GET /ready HTTP/1.0\r\naccept: text/plain\r\n\r\n", 200),
        ("GET /fraud-score HTTP/1.1\r\n\r\n", 404),
        ("DELETE /ready HTTP/1.1\r\n\r\n", 404),
        (f"POST /fraud-score HTTP/1.1\r\naccept: */*\r\nConTent-lengtH:  {size}\r\n\r\n{body}", 200),
        (f"POST /fraud-score HTTP/1.1\r\nContent-Length: {size}\r\n\r\n{body[:-2]}", 400),
        ("POST /fraud-score HTTP/1.1\r\n\r\n" + "x" * 4200, 413),
    ]
    df = requests.route(spark.createDataFrame([(k, *r) for k, r in enumerate(raw)], "event_id long, raw string, want int"))
    assert [r["status"] for r in df.orderBy("event_id").collect()] == [r[1] for r in raw]
    assert df.where("event_id = 3").first()["content_length"] == size


def entries(*approved):
    return {"entries": [{"request": PAYLOAD, "expected_approved": x} for x in approved], "stats": {"total": len(approved)}}


def test_evaluation_lines_are_not_read_whole(spark, tmp_path):
    """A file of an object a line is read in splits, and its entries keep their places over all of them."""
    one = '{"entries":[{"expected_approved":%s},{"expected_approved":false}]}'
    (tmp_path / "a b.json").write_text("\r\n".join(one % ("true" if k % 3 else "false") for k in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = requests.read_evaluation(spark, str(tmp_path))
        plan = found.groupBy("expected_approved").count()._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "transform" not in plan
        rows = found.orderBy("entry").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["entry"] for r in rows] == list(range(800)) and len({r["entry_id"] for r in rows}) == 800
    assert [r["expected_approved"] for r in rows[::2]] == [k % 3 > 0 for k in range(400)]


def test_evaluation_files(spark, tmp_path):
    """Objects over many lines, several objects a file, several files; ids are unique over all of them."""
    (tmp_path / "a.json").write_text(json.dumps(entries(True, False, True), indent=2))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(entries(*x)) for x in ([True], [], [False] * 4)) + "\r\n\n")
    (tmp_path / "c.json").write_text(json.dumps(entries(False)))
    (tmp_path / "d.json").write_text(" \n")
    rows = requests.read_evaluation(spark, str(tmp_path)).collect()
    assert sorted((r["file"][-6:-5], r["entry"], r["expected_approved"]) for r in rows) == [
        ("a", 0, True), ("a", 1, False), ("a", 2, True), ("b", 0, True), ("b", 1, False), ("b", 2, False), ("b", 3, False), ("b", 4, False), ("c", 0, False)
    ]
    assert len({r["entry_id"] for r in rows}) == 9 and all(r["request"]["id"] == "order 77" for r in rows)


@pytest.mark.parametrize("text", ['{"entries": [{"request"', '{"stats": {}}', "[1, 2]", "nonsense"])
def test_evaluation_files_that_are_none(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="entries|MALFORMED|malformed"):
        requests.read_evaluation(spark, str(tmp_path)).collect()


def changed(path, value):
    payload = json.loads(json.dumps(PAYLOAD))
    *way, last = path.split(".")
    at = payload
    for k in way:
        at = at[k]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return json.dumps(payload)


def test_reasons_for_rejection(spark):
    """Each body with what is told of it; accepted ones are those that is_valid() accepts."""
    cases = [
        (json.dumps(PAYLOAD), None), (None, "$: no JSON"), ("", "$: no JSON"), ("  ", "$: no JSON"), ("{", "$: no JSON"), ("7", "$: no object"), ("null", "$: no object"), ("{}", "$.transaction: missing"),
        (changed("id", ...), None), (changed("id", 5), "$.id: no string"), (changed("last_transaction", ...), None), (changed("merchant", []), "$.merchant: no object"), (changed("merchant", None), "$.merchant: null"),
        (changed("transaction.amount", 7), None), (changed("transaction.amount", None), "$.transaction.amount: null"), (changed("transaction.installments", "6"), "$.transaction.installments: no number"),
        (changed("transaction.installments", 2**31), "$.transaction.installments: no whole number"), (changed("customer.known_merchants", []), None), (changed("customer.known_merchants", "x"), "$.customer.known_merchants: no array"),
        (changed("customer.known_merchants", ["a", None]), "$.customer.known_merchants: no array of strings"), (changed("terminal.is_online", "true"), "$.terminal.is_online: no boolean"),
        (changed("transaction.requested_at", "2025-02-30T00:00:00Z"), "$.transaction.requested_at: no time"), (changed("last_transaction", {"timestamp": "2025-11-15T09:07:30Z"}), "$.last_transaction.km_from_current: missing"),
        (changed("last_transaction", {"timestamp": "2025-11-15T09:07:30Z", "km_from_current": 1}), None), (changed("last_transaction", {"timestamp": "x", "km_from_current": 1}), "$.last_transaction.timestamp: no time"),
    ]
    df = ingest.ingest(spark.createDataFrame([(k, b) for k, (b, _) in enumerate(cases)], "id long, body string"))
    rows = df.withColumn("ok", is_valid(F.col("request"))).orderBy("id").collect()
    assert [r["reason"] for r in rows] == [x for _, x in cases]
    assert all(bool(r["ok"]) == (r["reason"] is None) for r in rows)
    body = json.dumps(PAYLOAD | {"channel": {"app": 7}, "note": "x"})
    r = ingest.ingest(spark.createDataFrame([(body,)], "body string")).first()
    assert r["unknown"] == {"channel": '{"app":7}', "note": '"x"'} and r["request"]["id"] == "order 77"


def test_split_trim(spark):
    assert one(spark, s.split_trim(F.lit(" a ,, b c,  "))) == ["a", "b c"]


def test_records(spark, tmp_path):
    good = spark.createDataFrame([([0.5] * 14, "fraud", 1), ([-1.0] * 14, "legit", 2)], "vector array<double>, label string, extra int")
    records.write_json_array(good, str(tmp_path / "r"))
    back = records.quantised(records.require_valid(records.read_json_array(spark, str(tmp_path / "r"))))
    assert sorted((r["v"][0], r["label"]) for r in back.collect()) == [(-10000, 0), (5000, 1)]
    bad = spark.createDataFrame([([0.5] * 13, "fraud"), (None, "x"), ([0.1] * 14, None), ([0.1] * 13 + [None], "x")], "vector array<double>, label string")
    assert not any(r["is_valid"] for r in records.valid(bad).collect())
    with pytest.raises(Exception, match="14 numbers"):
        records.require_valid(bad).collect()
    with pytest.raises(ValueError, match="too few"):
        records.require_at_least(good, 5)


def points(spark, n=600):
    rng = kmeans.Lcg(7)
    rows = [(k, [rng.below(40) * 250 for _ in range(DIM)], rng.below(3) // 2) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, v array<int>, label int")


def test_index_and_search(spark, tmp_path):
    p = points(spark).cache()
    q = p.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), F.col("v").alias("q"))
    clusters, members = index.build(p, kmeans.step(p, kmeans.lowest_rows(p, 8)))
    index.write(clusters, members, str(tmp_path / "i"), files=2)
    clusters, members = index.read(spark, str(tmp_path / "i"))
    exact = {(r["query_id"], r["rank"]): r["dist"] for r in search.knn_exact(q, p).collect()}
    every = search.top(search.probes(q, clusters, 8), members)
    assert {(r["query_id"], r["rank"]): r["dist"] for r in every.collect()} == exact
    brute = {(r["query_id"], r["row_id"]): r["d"] for r in q.crossJoin(p).select("query_id", "row_id", s.squared_distance(F.col("q"), F.col("v")).alias("d")).collect()}
    for k in {k for k, _ in exact}:
        assert [exact[k, i] for i in range(1, 6)] == sorted(d for (a, _), d in brute.items() if a == k)[:5]
    left = search.bounded(search.probes(q, clusters, 8), clusters, members)
    assert {(r["query_id"], r["rank"]): r["dist"] for r in search.top(left, members).collect()} == exact
    votes = [{r["query_id"]: r["votes"] for r in df.collect()} for df in (search.ivf_votes(q, clusters, members, 2), search.ivf_votes(q, clusters, members, 6), search.ivf_adaptive(q, clusters, members, 2, 6))]
    assert all(votes[2][k] == (votes[1][k] if 1 <= votes[0][k] <= 4 else votes[0][k]) for k in votes[0]) and len(votes[2]) == 30


def neighbours(df):
    return sorted(tuple(r[c] for c in ("query_id", "rank", "cluster_id", "probe_rank", "row_id", "label", "dist")) for r in df.collect())


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """(index, points, queries, clusters, members): blocks of 16 members, a cluster without any."""
    p = points(spark, 900).cache()
    q = p.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), F.col("v").alias("q")).cache()
    far = spark.createDataFrame([(99, [-10_000.0] * DIM)], "cluster_id int, c array<double>")
    clusters, members = index.build(p, kmeans.step(p, kmeans.lowest_rows(p, 12)).union(far))
    folder, block = str(tmp_path_factory.mktemp("index") / "i"), index.MEMBER_BLOCK
    index.MEMBER_BLOCK = 16
    index.packed.__defaults__ = (16, DIM)
    index.write(clusters, members, folder, files=4)
    index.MEMBER_BLOCK = block
    index.packed.__defaults__ = (block, DIM)
    found = index.Index(spark, folder)
    yield found, p, q, clusters, members
    found.close()


@pytest.mark.parametrize("sent", [65_536, 10])
def test_search_of_a_written_index(spark, written, monkeypatch, sent):
    """Queries that travel and queries that are shuffled find what the join of members finds."""
    monkeypatch.setattr(search, "SENT_QUERIES", sent)
    monkeypatch.setattr(search, "SLICE", 20)
    i, p, q, clusters, members = written
    assert sorted(map(str, i.members.collect())) == sorted(map(str, members.select("row_id", "v", "label", "cluster_id").collect()))
    assert i.blocks.count() > 50
    for count in (2, 13):
        want = neighbours(search.top(search.probes(q, clusters, count), members))
        work = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        assert neighbours(search.index_neighbours(i, q, count, work=work)) == want
        assert 0 < work[0].value <= work[1].value
        votes = {r["query_id"]: r["votes"] for r in search.ivf_votes(q, clusters, members, count).collect()}
        assert {r["query_id"]: r["votes"] for r in search.index_votes(i, q, count).collect()} == votes
    exact = {(r["query_id"], r["rank"]): r["dist"] for r in search.knn_exact(q, p).collect()}
    assert {(a, b): d for a, b, *_, d in want} == exact  # over all clusters
    votes = {r["query_id"]: r["votes"] for r in search.ivf_adaptive(q, clusters, members, 1, 6).collect()}
    assert {r["query_id"]: r["votes"] for r in search.index_adaptive(i, q, 1, 6).collect()} == votes
    none = q.limit(0)
    assert search.index_adaptive(i, none, 1, 6).collect() == [] and search.index_votes(i, none, 3).collect() == []


def test_members_of_a_written_index_stay(spark, written, monkeypatch):
    """No exchange below which the index lies, and only blocks of probed clusters are read."""
    i, p, q, _, _ = written
    few = q.where("query_id < 20").cache()

    def exchanged(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        at = next(k for k, line in enumerate(lines) if "FileScan parquet" in line and "vectors" in line)
        depth, above = lines[at].index("+-") if "+-" in lines[at] else lines[at].index(":-"), []
        for line in reversed(lines[:at]):
            mark = max(line.find("+-"), line.find(":-"))
            if 0 <= mark < depth:
                depth = mark
                above.append(line)
        below = [x for x in above if "MapInArrow" in x or "FlatMapCoGroups" in x][0]
        return [x for x in above[: above.index(below)] if "Exchange" in x], lines[at]

    hit, scan = exchanged(search.index_neighbours(i, few, 1))
    assert not hit and "PushedFilters: [Or" in scan or "GreaterThanOrEqual(block_id" in scan
    monkeypatch.setattr(search, "SENT_QUERIES", 0)
    hit, scan = exchanged(search.index_neighbours(i, few, 1))
    assert not hit and "Bucketed: true" in scan


def test_kept_index_is_read_once(spark, written, tmp_path):
    """Later batches find the blocks in the executors, even if the files have gone."""
    i, p, q, clusters, members = written
    folder = str(tmp_path / "own")
    index.write(clusters, members, folder, files=2)
    own = index.Index(spark, folder).keep()
    votes = [{r["query_id"]: r["votes"] for r in search.index_votes(own, q, 13).collect()}]
    shutil.rmtree(folder)
    votes.append({r["query_id"]: r["votes"] for r in search.index_votes(own, q, 13).collect()})
    own.close()
    assert votes[0] == votes[1] == {r["query_id"]: r["votes"] for r in search.ivf_votes(q, clusters, members, 13).collect()}


@pytest.mark.parametrize(("size", "clumped"), [(1, False), (40, False), (4_096, True), (4_096, False), (65_536, True)])
def test_balls_find_what_all_distances_find(size, clumped):
    rng = np.random.default_rng(size)
    if clumped:
        p = np.clip(rng.integers(0, 9, (300, DIM))[rng.integers(0, 300, size)] * 1200 + rng.integers(-200, 200, (size, DIM)), -10_000, 10_000)
    else:
        p = rng.integers(0, 3, (size, DIM)) * 5_000  # with many ties
    q = p[rng.integers(0, size, 50)] + rng.integers(0, 300, (50, DIM)) * (rng.random((50, 1)) < 0.5)
    at, d, done = tree.nearest_in_balls(tree.balls(p), q.astype(float), 32)
    every = ((q[:, None] - p[None]) ** 2).sum(axis=2)
    want = np.argsort(every * size + np.arange(size), axis=1, kind="stable")[:, :32]
    assert (at == want).all() and (d == np.take_along_axis(every, want, axis=1)).all()
    if clumped:  # a few points a clump help little, many a lot
        assert done < (0.35 if size > 10_000 else 0.95) * size * len(q)


def test_probes_by_balls(spark, written, monkeypatch):
    i, p, q, _, _ = written
    want = search.probe_plan(q, i, 4, 9).collect()
    lists = i.lists._replace(tree=tree.balls(i.lists.centroids))
    monkeypatch.setattr(i, "sent", spark.sparkContext.broadcast(lists))
    assert search.probe_plan(q, i, 4, 9).collect() == want


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(1, 9), st.integers(0, 2**32), st.booleans(), st.sampled_from([0.0, 0.05, 1.0]), st.sampled_from([3, 256]))
def test_kernel_with_and_without_early_exit(n, m, seed, tight, dense, leading):
    search.DENSE, search.LEADING = dense, leading
    rng = np.random.default_rng(seed)
    v, q = rng.integers(0, 5, (DIM, n)).astype(float), rng.integers(0, 5, (m, DIM)).astype(float)
    cutoff = rng.integers(0, 60, m) if tight else np.full(m, search.FAR)
    i, j, d, work = search.near_in_block(q, cutoff, v, 3)
    want = []
    for a in range(m):
        dist = ((q[a] - v.T) ** 2).sum(axis=1).astype(int)
        want += [(a, b, dist[b]) for b in sorted(range(n), key=lambda b: (dist[b], b))[:3] if dist[b] <= cutoff[a]]
    search.DENSE, search.LEADING = 0.05, 256
    assert list(zip(i.tolist(), j.tolist(), d.tolist(), strict=True)) == want and work <= DIM * n * m


def test_too_few_points_are_refused(spark):
    p = points(spark, 3)
    with pytest.raises(ValueError, match="too few"):
        kmeans.fit(p, 4, 1)
    with pytest.raises(ValueError, match="too few"):
        kmeans.fit(p.limit(0), 1, 1)
    with pytest.raises(ValueError, match="too few"):
        index.build(p, kmeans.lowest_rows(points(spark, 8), 8))


def seeded_again(rows, k, seed):
    """k-means++ in plain Python: rows of whole numbers."""
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    state = seed

    def draw():
        nonlocal state
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        return state

    chosen = [draw() % len(rows)]
    while len(chosen) < min(k, len(rows)):
        least = [min(dist(r, rows[c]) for c in chosen) for r in rows]
        total = sum(least)
        goal, acc, at = (draw() >> 11) / 2**53 * total if total else 0, 0, 0
        if total:
            for at, w in enumerate(least):
                acc += w
                if acc >= goal:
                    break
        chosen.append(at)
    return [rows[c] for c in chosen], dist


@pytest.mark.parametrize(("n", "k", "size"), [(200, 6, 80), (5, 5, 100), (40, 3, 40)])
def test_seeding_and_fit_brute_force(spark, n, k, size):
    p = points(spark, n).cache()
    drawn = [tuple(r["v"]) for r in kmeans.sample_with_replacement(p, size, 5).orderBy("draw").collect()]
    all_rows = [tuple(r["v"]) for r in p.orderBy("row_id").collect()]
    rng = kmeans.Lcg(5)
    assert drawn == [all_rows[rng.below(n)] for _ in range(min(size, n))]
    sample = spark.createDataFrame([(i, list(v)) for i, v in enumerate(drawn)], "row_id long, v array<int>")
    want, dist = seeded_again(drawn, k, 5)
    assert [tuple(r["c"]) for r in kmeans.seed_plus_plus(sample, k, 5).orderBy("cluster_id").collect()] == want
    now = [list(map(float, c)) for c in want]
    for _ in range(3):
        near = [min(range(len(now)), key=lambda i, r=r: (dist(r, now[i]), i)) for r in drawn]
        now = [[sum(r[d] for r, b in zip(drawn, near, strict=True) if b == i) * (1.0 / near.count(i)) for d in range(DIM)] if i in near else c for i, c in enumerate(now)]
    assert [r["c"] for r in kmeans.fit(p, k, 3, seed=5, sample_size=size).orderBy("cluster_id").collect()] == now


@pytest.mark.parametrize("few", [10, 50_000])
def test_ranges(spark, monkeypatch, few):
    """Ranks, running totals and numbers by ranges are those of the sorted rows, with ties, nulls and far outliers."""
    monkeypatch.setattr(ranges, "FEW", few)
    rng = kmeans.Lcg(3)
    values = sorted([rng.below(50) / 7 for _ in range(400)] + [1e9, -1e9] + [3.25] * 300)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    for rank in (0, 1, 200, 350, len(values) - 1):
        assert ranges.value_at_rank(df, "x", rank) == values[rank]
    assert ranges.value_at_rank(df, "x", len(values)) is None and ranges.value_at_rank(df.limit(0), "x", 0) is None
    want = df.agg(F.percentile("x", F.lit(0.99)).alias("p")).first()["p"]
    assert evaluate.percentile99(df, "x").first()["p99"] == pytest.approx(want) and evaluate.percentile99(df.limit(0), "x").first()["p99"] is None
    rows = spark.createDataFrame([(k * k, k % 3, k % 5) for k in range(300)], "row_id long, g int, w long").repartition(4)
    got = {r["row_id"]: r["place"] for r in ranges.numbered(rows, "row_id", "g").collect()}
    assert got == {k * k: k // 3 for k in range(300)} and ranges.numbered(rows.limit(0), "row_id").count() == 0
    acc = 0
    for k in range(300):
        acc += k % 5
        if acc >= 250:
            break
    assert [tuple(r) for r in kmeans.weighted_pick(rows, 250).select("row_id", "acc").collect()] == [(k * k, acc)] and kmeans.weighted_pick(rows, 10**6).count() == 0


def clumps(spark, n=400):
    rng = np.random.default_rng(8)
    v = np.clip(rng.integers(0, 6, (n, 1)) * 1500 + rng.integers(-300, 300, (n, DIM)), -10_000, 10_000)
    return spark.createDataFrame([(k, x, 0) for k, x in enumerate(v.tolist())], "row_id long, v array<int>, label int")


def test_bounded_steps_are_plain_steps(spark):
    """Clumps, ties between equal centroids, one centroid, an empty cluster; and far fewer distances."""
    p = clumps(spark).cache()
    same = kmeans.lowest_rows(p, 6).union(kmeans.lowest_rows(p, 2).selectExpr("cluster_id + 50", "c")).union(spark.createDataFrame([(99, [-9_000.0] * DIM)], "cluster_id int, c array<double>"))
    for start in (kmeans.lowest_rows(p, 9), same, kmeans.lowest_rows(p, 1)):
        plain = start
        for _ in range(4):
            ids, c = kmeans.centroid_matrix(kmeans.step(p, plain), "c")
            plain = kmeans._frame(spark, ids, c)
        work = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        got = kmeans.lloyd(p, start, 4, work=work)
        assert {r["cluster_id"]: r["c"] for r in got.collect()} == {r["cluster_id"]: r["c"] for r in plain.collect()}
        assert work[0].value < (0.75 if start is not same else 1.01) * work[1].value


def test_parallel_seeding_brute_force(spark):
    import xxhash

    p = clumps(spark, 300).cache()
    rows = [(r["row_id"], tuple(r["v"])) for r in p.orderBy("row_id").collect()]
    k, seed, rounds = 5, 11, 3

    def draw(i, turn):
        h = 42
        for x in (i, seed, turn):
            h = xxhash.xxh64(int(x).to_bytes(8, "little"), seed=h).intdigest()
        return (h if h < 2**63 else h - 2**64) % 2**53 / 2.0**53

    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    found = [min(rows, key=lambda r: (draw(r[0], 0), r[0]))[1]]
    for turn in range(1, rounds + 1):
        w = [min(dist(v, c) for c in found) for _, v in rows]
        found = found + [v for (i, v), d in zip(rows, w, strict=True) if d > 0 and draw(i, turn) * sum(w) < d * 2 * k]
    near = [min(range(len(found)), key=lambda j, v=v: (dist(v, found[j]), j)) for _, v in rows]
    weights = [near.count(j) for j in range(len(found))]
    rng, chosen = kmeans.Lcg(seed), []
    while len(chosen) < k:
        now = [w * (min(dist(c, found[x]) for x in chosen) if chosen else 1) for c, w in zip(found, weights, strict=True)]
        goal, acc = rng.unit() * sum(now), 0
        for j, x in enumerate(now):
            acc += x
            if acc > goal:
                break
        chosen.append(j)
    got = kmeans.seed_parallel(p, k, seed, rounds).orderBy("cluster_id").collect()
    assert len(found) > 12 and [tuple(r["c"]) for r in got] == [found[j] for j in chosen]
    assert kmeans.fit_all(p, k, 2).count() == k
    few = spark.createDataFrame([(k, [k % 2] * DIM, 0) for k in range(30)], "row_id long, v array<int>, label int")
    assert sorted(r["c"][0] for r in kmeans.seed_parallel(few, 6, 1).collect()) == [0.0, 1.0]
    with pytest.raises(ValueError, match="no points"):
        kmeans.seed_parallel(few.limit(0), 2, 1)


def test_states_of_a_stream(spark):
    rng, steps = kmeans.Lcg(42), [0, 1, 2, 3, 1000]
    want = [42] + [rng.next() for _ in range(1000)]
    assert kmeans.Lcg(42).after(np.array(steps)).tolist() == [want[k] for k in steps]


INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize(
    ("kind", "values", "few"),
    [
        ("double", [k * 0.5 for k in range(700)] + [NAN], 50_000),
        ("double", [1.0, INF, -INF, NAN, NAN, 2.0] * 40, 3),
        ("double", [0.0, -0.0, 1e-300, -1e300, 1e300] * 90, 50_000),
        ("double", [INF] * 300, 50_000),
        ("double", [NAN] * 30, 50_000),
        ("long", [2**60, 2**60 + 1] * 200 + [-(2**63), 2**63 - 1, 2**60 - 1], 3),
        ("long", [7] * 500, 50_000),
        ("long", list(range(-300, 300)) + [2**62], 40),
        ("float", [0.1, 0.2, 0.3] * 50, 50_000),
        ("int", [5], 50_000),
    ],
)
def test_values_at_ranks_that_halving_could_not_tell_apart(spark, monkeypatch, kind, values, few):
    monkeypatch.setattr(ranges, "FEW", few)
    monkeypatch.setattr(ranges, "SKETCH_K", 32)  # far off
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, f"x {kind}").repartition(3).cache()
    want = sorted((as_float(v) if kind == "float" else v for v in values), key=lambda v: (v != v, v))
    for first in (0, int((len(values) - 1) * 0.99), len(values) - 1):
        got = ranges.values_at_ranks(df, "x", first, first + 1)
        assert [repr(x + 0 if x is not None else x) for x in got] == [repr(x + 0 if x is not None else x) for x in (want + [None])[first : first + 2]]
    df.unpersist()


def as_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_p99_with_infinities_and_nan(spark):
    p99 = lambda values: evaluate.percentile99(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()["p99"]
    assert p99([1.0, INF]) == INF and p99([INF, INF]) == INF and p99([None]) is None
    assert p99([1.0] * 150 + [NAN]) == 1.0
    assert (x := p99([1.0, NAN])) != x
    assert p99([2.0**60, 2.0**60 + 256] * 30_000) == 2**60 + 256


def test_ranges_are_even_whatever_the_ids(spark, monkeypatch):
    """One outlier, hash-like ids, one group with all rows: ranges grow in number with the rows, and not in size."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", 500)
    ids = list(range(4_000)) + [2**62]
    for own in (ids, [(k * 0x9E3779B97F4A7C15) % 2**63 for k in ids]):
        df = spark.createDataFrame([(k, 7) for k in own], "row_id long, g int").repartition(6)
        sizes = [r["count"] for r in ranges.ordered(df, "row_id").groupBy("__part").count().collect()]
        assert len(sizes) == 9 and max(sizes) < 800
        assert {r["row_id"]: r["place"] for r in ranges.numbered(df, "row_id", "g").collect()} == {k: i for i, k in enumerate(sorted(own))}
        assert len(ranges.ordered(df.limit(900), "row_id").select("__part").distinct().collect()) == 2
    with_null = spark.createDataFrame([(k, None if k % 2 else 1, 1) for k in range(50)], "row_id long, g int, place int")
    assert {r["row_id"]: r["place"] for r in ranges.numbered(with_null.drop("place"), "row_id", "g").collect()} == {k: k // 2 for k in range(50)}


def test_recall_of_the_index(spark):
    """Recall of the five nearest against brute force, for the queries divisible by 20, over an index fitted on a sample."""
    p = points(spark, 600).cache()
    q = p.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), F.col("v").alias("q"))
    clusters, members = index.build(p, kmeans.fit(p, 8, 3, sample_size=300))
    near = {(r["query_id"], r["row_id"]) for r in search.top(search.probes(q, clusters, 6), members, clusters=clusters).collect()}
    exact = {(r["query_id"], r["row_id"]) for r in search.knn_exact(q, p).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_a_half_written_index_is_refused(spark, tmp_path):
    p = points(spark, 40)
    clusters, members = index.build(p, kmeans.lowest_rows(p, 4))
    index.write(clusters, members, str(tmp_path / "i"), files=1)
    tables = next(x for x in (tmp_path / "i").iterdir() if x.name.startswith("tables"))
    members.limit(3).write.mode("overwrite").parquet(str(tables / "members"))
    with pytest.raises(ValueError, match="other numbers"):
        index.read(spark, str(tmp_path / "i"))


def test_exact_search_in_blocks(spark, monkeypatch):
    p = points(spark, 300)
    q = p.where("row_id % 10 = 0").select(F.col("row_id").alias("query_id"), F.col("v").alias("q"))
    whole = sorted(map(tuple, search.knn_exact(q, p).select("query_id", "rank", "row_id", "dist").collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "POINT_BLOCK", 40)
    assert sorted(map(tuple, search.knn_exact(q, p).select("query_id", "rank", "row_id", "dist").collect())) == whole


def test_index_of_another_version_is_refused(spark, tmp_path):
    spark.createDataFrame([(1, DIM, 8, 3, 9, "t")], "version int, dim int, block_size int, k long, n long, tables string").write.parquet(str(tmp_path / "meta"))
    with pytest.raises(ValueError, match="version"):
        index.read(spark, str(tmp_path))


def test_kmeans_keeps_empty_clusters_and_lower_ids(spark):
    p = spark.createDataFrame([(k, [k // 2] * DIM, 0) for k in range(6)], "row_id long, v array<int>, label int")
    c = spark.createDataFrame([(0, [0.0] * DIM), (1, [0.0] * DIM), (2, [99.0] * DIM)], "cluster_id int, c array<double>")
    assert {r["cluster_id"] for r in kmeans.assign(p, c).collect()} == {0}
    assert {r["cluster_id"]: r["c"][0] for r in kmeans.step(p, c).collect()} == {0: 1.0, 1: 0.0, 2: 99.0}
    sizes = {r["cluster_id"]: (r["n"], r["bb_max"][0]) for r in index.boxes(kmeans.assign(p, c), c).collect()}
    assert sizes == {0: (6, 2), 1: (0, 0), 2: (0, 0)}


def test_lcg():
    rng = kmeans.Lcg(0)
    assert rng.next() == 1442695040888963407
    assert rng.next() == (1442695040888963407 * 6364136223846793005 + 1442695040888963407) % 2**64


def test_scores(spark):
    counts = spark.createDataFrame([(50, 50, 0, 0, 0, 1.0), (0, 0, 10, 0, 0, 3000.0), (0, 0, 0, 0, 0, 0.0)], "tp long, tn long, fp long, fn long, err long, p99 double")
    best, worst, none = evaluate.scores(counts).collect()
    assert (best["final_score"], worst["final_score"]) == (6000.0, -6000.0)
    assert none["p99_score"] == 0 and none["failure_rate"] == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 10000), min_size=DIM, max_size=DIM), min_size=3, max_size=12))
def test_box_bound_is_a_bound(spark, vectors):
    q, rest = vectors[0], vectors[1:]
    lo, hi = [min(c) for c in zip(*rest, strict=True)], [max(c) for c in zip(*rest, strict=True)]
    df = spark.createDataFrame([(q, v, lo, hi) for v in rest], "q array<int>, v array<int>, lo array<int>, hi array<int>")
    assert all(r["lb"] <= r["d"] for r in df.select(s.box_lower_bound(F.col("q"), F.col("lo"), F.col("hi")).alias("lb"), s.squared_distance(F.col("q"), F.col("v")).alias("d")).collect())
