"""DuckDB SQL with the rows of each query of plans.queries, where SQL can express it."""

from __future__ import annotations

from ..schema import DEFAULT_RISK, DIM, RISK
from ..sources.fixtures import CATEGORIES, DAY_US, QUERY_EVERY
from .queries import FAST, FULL, K

_DIMS = range(1, DIM + 1)


def _r4(x: str) -> str:
    return f"(round(({x})*10000)/10000)"


def _clamp(x: str) -> str:
    return f"least(greatest({x}, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"


def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def _risk(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN {_d(v)}" for k, v in RISK.items()) + f" ELSE {_d(DEFAULT_RISK)} END"


def _quantize(x: str) -> str:
    return f"CAST(CASE WHEN ({x}) < 0 THEN -10000 ELSE round(least({x}, CAST(1 AS DOUBLE))*10000) END AS INTEGER)"


def _dist(a: str, b: str, dims: int = DIM) -> str:
    return "+".join(f"(CAST({a}[{k}] AS BIGINT)-{b}[{k}])*(CAST({a}[{k}] AS BIGINT)-{b}[{k}])" for k in range(1, dims + 1))


def _distf(a: str, b: str) -> str:
    return "+".join(f"({a}[{k}]-{b}[{k}])*({a}[{k}]-{b}[{k}])" for k in _DIMS)


def _lower(q: str, lo: str, hi: str) -> str:
    gap = lambda k: f"greatest(CAST({lo}[{k}] AS BIGINT)-{q}[{k}], CAST({q}[{k}] AS BIGINT)-{hi}[{k}], 0)"
    return "+".join(f"{gap(k)}*{gap(k)}" for k in _DIMS)


def _features(customer: str, fallback: str, has_last: str, known: str) -> list[str]:
    return [
        _clamp(f"amount/{_d(10000)}"),
        _clamp(f"installments/{_d(12)}"),
        f"CASE WHEN {customer} > 0 THEN {_clamp(f'(amount/{customer})/{_d(10)}')} ELSE {_d(fallback)} END",
        f"hour/{_d(23)}",
        f"dow/{_d(6)}",
        f"CASE WHEN {has_last} THEN {_clamp(f'((us // 1000000 - last_us // 1000000)/{_d(60)})/{_d(1440)}')} ELSE {_d(-1)} END",
        f"CASE WHEN {has_last} THEN {_clamp(f'km_since_last/{_d(1000)}')} ELSE {_d(-1)} END",
        _clamp(f"km_from_home/{_d(1000)}"),
        _clamp(f"tx_count_24h/{_d(20)}"),
        "CAST(is_online AS DOUBLE)",
        "CAST(card_present AS DOUBLE)",
        f"CASE WHEN {known} THEN {_d(0)} ELSE {_d(1)} END",
        _risk("mcc"),
        _clamp(f"merchant_avg/{_d(10000)}"),
    ]


_IN_ORDER = "PARTITION BY user_id ORDER BY us, event_id"
TX = f"""
ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              CAST(round(value*1000) AS BIGINT) AS cents FROM events),
tx AS (SELECT event_id, event_type, us, k, cents/{_d(100)} AS amount, CAST(event_id % 12 + 1 AS INTEGER) AS installments,
  CAST(sum(cents) OVER (PARTITION BY user_id) AS DOUBLE)/count(*) OVER (PARTITION BY user_id)/100 AS customer_avg,
  CAST(count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) - 1 AS INTEGER) AS tx_count_24h,
  coalesce(list(k) OVER ({_IN_ORDER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), CAST([] AS INTEGER[])) AS known,
  [{', '.join(f"'{c}'" for c in CATEGORIES)}][k % {len(CATEGORIES)} + 1] AS mcc,
  CAST(sum(cents) OVER (PARTITION BY k) AS DOUBLE)/count(*) OVER (PARTITION BY k)/100 AS merchant_avg,
  event_type IN ('click', 'view') AS is_online, event_type = 'purchase' AS card_present,
  ((user_id*7919 + event_id*104729) % 150000)/{_d(100)} AS km_from_home,
  lag(us) OVER ({_IN_ORDER}) AS last_us, ((event_id*15485863) % 120000)/{_d(100)} AS km_since_last,
  CAST(event_type = 'error' AS INTEGER) AS label,
  CAST((us // 3600000000) % 24 AS INTEGER) AS hour, CAST(isodow(make_timestamp(us)) - 1 AS INTEGER) AS dow
  FROM ev)"""
FEAT = TX + ",\nfeat AS (SELECT event_id, label, " + ", ".join(f"{_r4(x)} AS f{k}" for k, x in enumerate(_features("customer_avg", "1", "last_us IS NOT NULL", "list_contains(known, k)"))) + " FROM tx)"
VEC = FEAT + f",\nvec AS (SELECT event_id AS row_id, label, [{', '.join(_quantize(f'f{k}') for k in range(DIM))}] AS v FROM feat),\nq AS (SELECT row_id AS query_id, v AS q FROM vec WHERE row_id % {QUERY_EVERY} = 0)"
EXACT = VEC + f""",
ex AS (SELECT * FROM (SELECT query_id, row_id, label, {_dist('q', 'v')} AS dist FROM q, vec)
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) <= 5)"""
_SUMS = ", ".join(f"CAST(sum(v[{k}]) AS DOUBLE)*(CAST(1 AS DOUBLE)/count(*))" for k in _DIMS)
CENT = VEC + f""",
c0 AS (SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS INTEGER) AS cluster_id, v AS c FROM (SELECT * FROM vec ORDER BY row_id LIMIT {K})),
a0 AS (SELECT row_id, v, cluster_id FROM (SELECT row_id, v, cluster_id, {_dist('v', 'c')} AS d FROM vec, c0)
       QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, cluster_id) = 1),
c1 AS (SELECT c0.cluster_id, CASE WHEN m IS NULL THEN CAST(c0.c AS DOUBLE[]) ELSE m END AS c
       FROM c0 LEFT JOIN (SELECT cluster_id, [{_SUMS}] AS m FROM a0 GROUP BY cluster_id) s ON s.cluster_id = c0.cluster_id)"""
INDEX = CENT + f""",
cl AS (SELECT cluster_id, [{', '.join(f'CAST(round(c[{k}]) AS INTEGER)' for k in _DIMS)}] AS ci FROM c1),
mem AS (SELECT row_id, v, label, cluster_id FROM (SELECT row_id, v, label, cluster_id, {_distf('v', 'c')} AS d FROM vec, c1)
        QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, cluster_id) = 1),
bx AS (SELECT cl.cluster_id, cl.ci, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(lo, [{', '.join('0' for _ in _DIMS)}]) AS lo, coalesce(hi, [{', '.join('0' for _ in _DIMS)}]) AS hi
       FROM cl LEFT JOIN (SELECT cluster_id, count(*) AS n, [{', '.join(f'min(v[{k}])' for k in _DIMS)}] AS lo, [{', '.join(f'max(v[{k}])' for k in _DIMS)}] AS hi FROM mem GROUP BY cluster_id) b
       ON b.cluster_id = cl.cluster_id),
cd AS (SELECT query_id, q, cluster_id, {_dist('q', 'ci')} AS cdist FROM q, cl),
pr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cdist, cluster_id) AS INTEGER) AS probe_rank FROM cd
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cdist, cluster_id) <= {FULL}),
cand AS (SELECT query_id, pr.cluster_id, probe_rank, row_id, label, {_dist('q', 'v')} AS dist, {_dist('q', 'v', 4)} AS part FROM pr JOIN mem ON mem.cluster_id = pr.cluster_id),
tf AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, probe_rank, row_id) AS INTEGER) AS rank FROM cand WHERE probe_rank <= {FAST}
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, probe_rank, row_id) <= 5),
tl AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, probe_rank, row_id) <= 5),
vf AS (SELECT q.query_id, CAST(coalesce(sum(label), 0) AS INTEGER) AS votes FROM q LEFT JOIN tf ON tf.query_id = q.query_id GROUP BY q.query_id),
vl AS (SELECT q.query_id, CAST(coalesce(sum(label), 0) AS INTEGER) AS votes FROM q LEFT JOIN tl ON tl.query_id = q.query_id GROUP BY q.query_id)"""


def _cols(column: str, prefix: str) -> str:
    return ", ".join(f"{column}[{k}] AS {prefix}{k - 1}" for k in _DIMS)


def _lloyd(k: int, steps: int) -> str:
    """Steps from the k lowest rows: m0, m1, ..."""
    out = [f"m0 AS (SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS INTEGER) AS cluster_id, CAST(v AS DOUBLE[]) AS c FROM (SELECT * FROM vec ORDER BY row_id LIMIT {k}))"]
    for i in range(1, steps + 1):
        out.append(f"""n{i} AS (SELECT row_id, v, cluster_id FROM (SELECT row_id, v, cluster_id, {_distf('v', 'c')} AS d FROM vec, m{i - 1})
        QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, cluster_id) = 1),
m{i} AS (SELECT o.cluster_id, CASE WHEN m IS NULL THEN o.c ELSE m END AS c FROM m{i - 1} o
       LEFT JOIN (SELECT cluster_id, [{_SUMS}] AS m FROM n{i} GROUP BY cluster_id) s ON s.cluster_id = o.cluster_id)""")
    return ",\n".join(out)


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


_BROKEN = '{"id": "broken"'
_KIND = "event_id % 7"
_CONF = """SELECT CAST(count(*) FILTER (ok AND m AND NOT a) AS BIGINT) AS tp, CAST(count(*) FILTER (ok AND m AND a) AS BIGINT) AS tn,
  CAST(count(*) FILTER (ok AND NOT m AND NOT a) AS BIGINT) AS fp, CAST(count(*) FILTER (ok AND NOT m AND a) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS err
  FROM (SELECT doc_id % 97 <> 0 AS ok, toxic = 0 AS a, (toxic = 0) = (quality = 1) AS m FROM labels)"""
_SCORED = """s1 AS (SELECT *, tp+tn+fp+fn+err AS n, fp + 3*fn + 5*err AS weighted_errors FROM c),
s2 AS (SELECT *, CASE WHEN n > 0 THEN CAST(weighted_errors AS DOUBLE)/n ELSE 0 END AS epsilon, CASE WHEN n > 0 THEN CAST(fp+fn+err AS DOUBLE)/n ELSE 0 END AS failure_rate FROM s1),
s3 AS (SELECT *, CASE WHEN p99 <= 0 THEN CAST(0 AS DOUBLE) WHEN p99 > 2000 THEN CAST(-3000 AS DOUBLE) ELSE CAST(1000 AS DOUBLE)*log10(CAST(1000 AS DOUBLE)/greatest(p99, CAST(1 AS DOUBLE))) END AS p99_score,
  CASE WHEN failure_rate > CAST(0.15 AS DOUBLE) THEN CAST(-3000 AS DOUBLE) ELSE CAST(1000 AS DOUBLE)*log10(CAST(1 AS DOUBLE)/greatest(epsilon, CAST(0.001 AS DOUBLE))) - CAST(300 AS DOUBLE)*log10(CAST(1 AS DOUBLE)+weighted_errors) END AS detection_score FROM s2),
s4 AS (SELECT *, p99_score + detection_score AS final_score FROM s3)"""

_TYPED = ", ".join(
    f"{_r4(x)} AS f{k}"
    for k, x in enumerate(_features("(CASE WHEN event_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE customer_avg END)", "0.5", "coalesce(last_us, 0) // 1000000 > 0", "list_contains(known, k)"))
)


def oracle_sql() -> dict[str, str]:
    o = "CAST(o_totalprice AS DOUBLE)"
    return {
        "knn_verdict": _with(EXACT, "SELECT q.query_id, CAST(coalesce(sum(label), 0) AS INTEGER) AS votes, coalesce(sum(label), 0) < 3 AS approved, coalesce(sum(label), 0)/CAST(5 AS DOUBLE) AS fraud_score FROM q LEFT JOIN ex ON ex.query_id = q.query_id GROUP BY q.query_id"),
        "ref_count": "SELECT count(*) AS n FROM events",
        "ref_scan": _with(VEC, f"SELECT label, {_cols('v', 'v')} FROM vec"),
        "ref_scan_ranges": _with(VEC, f"SELECT label, {_cols('v', 'v')} FROM vec"),
        "ref_validate": "SELECT event_id, event_id % 5 > 2 AS is_valid FROM events",
        "label_encode": "SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS label FROM events",
        "route_requests": f"SELECT event_id, CASE WHEN {_KIND} < 2 THEN 'GET' ELSE 'POST' END AS method, CASE {_KIND} WHEN 0 THEN '/ready' WHEN 1 THEN '/nowhere' ELSE '/fraud-score' END AS path, CASE {_KIND} WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 400 WHEN 3 THEN 413 ELSE 200 END AS status FROM events",
        "header_parse": f"SELECT event_id, {_KIND} > 1 AS told, {_KIND} > 1 AS \"right\", {_KIND} <> 1 AS keep_alive FROM events",
        "reject_malformed": f"SELECT event_id, '{_BROKEN}' AS body FROM events WHERE {_KIND} = 2",
        "split_trim": "SELECT p_partkey, array_to_string(p, '|') AS parts, CAST(len(p) AS BIGINT) AS n FROM (SELECT p_partkey, list_filter(list_transform(string_split(translate(p_name, ' ', ',') || ' ,  , ' || p_brand, ','), lambda x: trim(x)), lambda x: length(x) > 0) AS p FROM part)",
        "parse_json": _with(TX, "SELECT event_id, amount, installments, tx_count_24h, CAST(len(known) AS BIGINT) AS n_known, mcc, is_online, CASE WHEN last_us IS NOT NULL THEN km_since_last END AS km_since_last, true AS is_valid FROM tx"),
        "reject_reasons": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '$: no JSON' WHEN 1 THEN '$.transaction.amount: no number' WHEN 2 THEN '$.merchant.mcc: missing' WHEN 3 THEN '$.transaction.requested_at: no time'
            WHEN 4 THEN '$.customer.known_merchants: no array of strings' WHEN 5 THEN '$.transaction.installments: no whole number' WHEN 6 THEN '$: no object' END AS reason,
            CASE WHEN event_id % 8 = 7 THEN '{"app":7}' END AS channel, event_id % 8 = 7 AS is_valid FROM events""",
        "datetime_parts": _with(TX, "SELECT event_id, us // 1000000 AS seconds, hour, dow AS weekday FROM tx"),
        "merchant_known": _with(TX, "SELECT event_id, list_contains(known, k) AS known FROM tx"),
        "features": _with(FEAT, "SELECT event_id, " + ", ".join(f"f{k}" for k in range(DIM)) + " FROM feat"),
        "features_sentinel": _with(FEAT, "SELECT event_id, f5, f6 FROM feat WHERE f5 < 0"),
        "features_typed": _with(TX, f"SELECT event_id, {_TYPED} FROM tx"),
        "clamp": f"SELECT o_orderkey, {_clamp(f'({o} - 100000)/{_d(200000)}')} AS clamped FROM orders",
        "round4": f"SELECT o_orderkey, {_r4(f'{o}/{_d(500000)}')} AS rounded FROM orders",
        "mcc_risk": _with(TX, f"SELECT event_id, mcc, {_risk('mcc')} AS risk FROM tx"),
        "quantize": f"SELECT o_orderkey, {_quantize(f'({o} - 50000)/{_d(300000)}')} AS q FROM orders",
        "quantize_vector": f"SELECT vec_id, v[1] AS first, v[len(v)] AS last, CAST(list_sum(v) AS BIGINT) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: {_quantize('CAST(x AS DOUBLE)')}) AS v FROM embeddings)",
        "vectors": _with(VEC, f"SELECT row_id, label, {_cols('v', 'v')} FROM vec"),
        "verdict": "SELECT event_id, event_id % 7 < 3 AS approved, least(event_id % 7, 5)/CAST(5 AS DOUBLE) AS fraud_score FROM events",
        "score_json": "SELECT event_id, '{\"approved\":' || CASE WHEN event_id % 6 < 3 THEN 'true' ELSE 'false' END || ',\"fraud_score\":' || ['0.0', '0.2', '0.4', '0.6', '0.8', '1.0'][event_id % 6 + 1] || '}' AS response FROM events",
        "l2_distance": _with(VEC + ",\np AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS other FROM events)", f"SELECT event_id, other, {_dist('a.v', 'b.v')} AS dist FROM p JOIN vec a ON a.row_id = event_id JOIN vec b ON b.row_id = other"),
        "knn_exact": _with(EXACT, "SELECT query_id, row_id, label, dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS INTEGER) AS rank FROM ex"),
        "centroid_distances": _with(INDEX, "SELECT query_id, cluster_id, cdist FROM cd"),
        "kmeans_assign": _with(INDEX, "SELECT row_id, cluster_id FROM mem"),
        "kmeans_step": _with(CENT, f"SELECT cluster_id, {_cols('c', 'c')} FROM c1"),
        "centroid_round": _with(INDEX, f"SELECT cluster_id, {_cols('ci', 'c')} FROM cl"),
        "kmeanspp_weights": _with(VEC, f"SELECT vec.row_id, min({_dist('vec.v', 's.v')}) AS w FROM vec, (SELECT v FROM vec ORDER BY row_id LIMIT 4) s GROUP BY vec.row_id"),
        "weighted_pick": _with(VEC + f",\nw AS (SELECT vec.row_id, min({_dist('vec.v', 's.v')}) AS w FROM vec, (SELECT v FROM vec ORDER BY row_id LIMIT 4) s GROUP BY vec.row_id),\nr AS (SELECT row_id, CAST(sum(w) OVER (ORDER BY row_id) AS BIGINT) AS acc FROM w)", "SELECT row_id, acc FROM r WHERE acc >= (SELECT CAST(sum(w) AS BIGINT) // 3 FROM w) ORDER BY row_id LIMIT 1"),
        "cluster_sizes": _with(INDEX, "SELECT cluster_id, count(*) AS n FROM mem GROUP BY cluster_id"),
        "cluster_bbox": _with(INDEX, f"SELECT cluster_id, n, {_cols('lo', 'lo')}, {_cols('hi', 'hi')} FROM bx"),
        "block_offsets": _with(INDEX, "SELECT cluster_id, (n + 7) // 8 AS n_blocks, CAST(coalesce(sum((n + 7) // 8) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM bx"),
        "block_slots": _with(INDEX, "SELECT row_id, cluster_id, CAST((s - 1) // 8 AS INTEGER) AS block, CAST((s - 1) % 8 AS INTEGER) AS lane FROM (SELECT row_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY row_id) AS s FROM mem)"),
        "ivf_build": _with(INDEX, "SELECT bx.cluster_id, ci[1] AS first, ci[14] AS last, n, CAST(coalesce(fraud, 0) AS BIGINT) AS fraud, (n + 7) // 8 AS n_blocks, CAST(coalesce(sum((n + 7) // 8) OVER (ORDER BY bx.cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM bx LEFT JOIN (SELECT cluster_id, sum(label) AS fraud FROM mem GROUP BY cluster_id) f ON f.cluster_id = bx.cluster_id"),
        "index_roundtrip": _with(INDEX, "SELECT cluster_id, n FROM bx"),
        "ivf_probes": _with(INDEX, "SELECT query_id, cluster_id, cdist, probe_rank FROM pr"),
        "ivf_scan": _with(INDEX, f"SELECT query_id, cluster_id, count(*) AS n, min(dist) AS nearest FROM cand WHERE probe_rank <= {FAST} GROUP BY query_id, cluster_id"),
        "knn_top5": _with(INDEX, "SELECT query_id, row_id, label, dist, rank FROM tf"),
        "bbox_lower_bound": _with(INDEX, f"SELECT query_id, pr.cluster_id, {_lower('q', 'lo', 'hi')} AS lb FROM pr JOIN bx ON bx.cluster_id = pr.cluster_id"),
        "bbox_prune": _with(INDEX + f""",
f1 AS (SELECT query_id, dist FROM cand WHERE probe_rank = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) = 5),
b AS (SELECT pr.query_id, pr.cluster_id, probe_rank, {_lower('q', 'lo', 'hi')} AS lb FROM pr JOIN bx ON bx.cluster_id = pr.cluster_id)""", "SELECT b.query_id, b.cluster_id, b.lb FROM b LEFT JOIN f1 ON f1.query_id = b.query_id WHERE probe_rank = 1 OR dist IS NULL OR lb < dist"),
        "l2_partial_filter": _with(INDEX, f"SELECT query_id, count(*) AS n, min(dist) AS nearest FROM cand WHERE probe_rank <= {FAST} AND part < 100000000 GROUP BY query_id"),
        "fraud_vote": _with(EXACT, "SELECT q.query_id, CAST(coalesce(sum(label), 0) AS INTEGER) AS votes FROM q LEFT JOIN ex ON ex.query_id = q.query_id GROUP BY q.query_id"),
        "ivf_fast": _with(INDEX, "SELECT query_id, votes FROM vf"),
        "ivf_full": _with(INDEX, "SELECT query_id, votes FROM vl"),
        "ivf_adaptive": _with(INDEX, "SELECT vf.query_id, CASE WHEN vf.votes BETWEEN 1 AND 4 THEN vl.votes ELSE vf.votes END AS votes FROM vf JOIN vl ON vl.query_id = vf.query_id"),
        "ivf_joined": _with(INDEX, "SELECT vf.query_id, CASE WHEN vf.votes BETWEEN 1 AND 4 THEN vl.votes ELSE vf.votes END AS votes FROM vf JOIN vl ON vl.query_id = vf.query_id"),
        "eval_confusion": _CONF,
        "eval_p99": "SELECT quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem",
        "stream_eval": _with(f"c AS (SELECT * FROM ({_CONF}), (SELECT quantile_cont(doc_id * 7919 % 200003 / CAST(100 AS DOUBLE), 0.99) AS p99 FROM labels)),\n" + _SCORED, "SELECT tp, tn, fp, fn, err, n, weighted_errors, round(p99, 6) AS p99, round(epsilon, 6) AS epsilon, round(failure_rate, 6) AS failure_rate, round(p99_score, 6) AS p99_score, round(detection_score, 6) AS detection_score, round(final_score, 6) AS final_score FROM s4"),
        "eval_score": _with("""c AS (SELECT o_orderpriority, o_orderstatus, count(*) FILTER (o_orderkey % 3 = 0) AS tp, count(*) FILTER (o_orderkey % 3 = 1) AS tn,
  count(*) FILTER (o_orderkey % 41 = 0 AND o_orderstatus <> 'P') AS fp, count(*) FILTER (o_orderkey % 199 = 5) AS fn, count(*) FILTER (o_orderkey % 499 = 7) AS err, max(o_totalprice)/CAST(400 AS DOUBLE) AS p99
  FROM orders GROUP BY o_orderpriority, o_orderstatus),\n""" + _SCORED, "SELECT o_orderpriority, o_orderstatus, n, weighted_errors, round(epsilon, 6) AS epsilon, round(failure_rate, 6) AS failure_rate, round(p99_score, 6) AS p99_score, round(detection_score, 6) AS detection_score, round(final_score, 6) AS final_score FROM s4"),
        "eval_report": _with(f"c AS (SELECT * FROM ({_CONF}), (SELECT quantile_cont(l_extendedprice/100, 0.99) AS p99 FROM lineitem)),\n" + _SCORED, "SELECT round(p99, 2) AS p99, round(p99_score, 2) AS p99_score, round(failure_rate*100, 2) AS failure_percent, weighted_errors, CASE WHEN NOT failure_rate > CAST(0.15 AS DOUBLE) THEN round(epsilon, 6) END AS epsilon, round(detection_score, 2) AS detection_score, failure_rate > CAST(0.15 AS DOUBLE) AS detection_cut, round(final_score, 2) AS final_score, tp, fn FROM s4"),
        "eval_entries": _with(TX, "SELECT label = 0 AS expected_approved, count(*) AS n, count(last_us) AS with_last FROM tx GROUP BY label = 0"),
        "label_stats": "SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS fraud_count, count(*) FILTER (event_type <> 'error') AS legit_count, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE)/count(*) AS fraud_rate, CAST(count(*) FILTER (event_type <> 'error') AS DOUBLE)/count(*) AS legit_rate FROM events",
        "sample_with_replacement": f"WITH RECURSIVE {VEC.strip()}" + """,
g(k, s) AS (SELECT 0, CAST((CAST(42 AS UHUGEINT)*6364136223846793005 + 1442695040888963407) % 18446744073709551616 AS UHUGEINT)
            UNION ALL SELECT k + 1, CAST((s*6364136223846793005 + 1442695040888963407) % 18446744073709551616 AS UHUGEINT) FROM g WHERE k < 499),
p AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place, count(*) OVER () AS n FROM vec)
SELECT CAST(k AS INTEGER) AS draw, row_id FROM g JOIN p ON p.place = CAST(g.s % CAST(p.n AS UHUGEINT) AS BIGINT) WHERE k < p.n""",
        "lcg_sequence": """WITH RECURSIVE g(k, s) AS (SELECT CAST(0 AS BIGINT), CAST(42 AS UHUGEINT)
            UNION ALL SELECT k + 1, CAST((s*6364136223846793005 + 1442695040888963407) % 18446744073709551616 AS UHUGEINT) FROM g WHERE k < (SELECT max(event_id) FROM events))
            SELECT event_id, CAST(s AS VARCHAR) AS state FROM events JOIN g ON g.k = event_id""",
        "kmeans_lloyd": _with(VEC + ",\n" + _lloyd(8, 3), f"SELECT cluster_id, {_cols('c', 'c')} FROM m3"),
        "synthetic_queries": "SELECT event_id AS query_id, " + ", ".join(f"CAST((((event_id*{DIM} + {k} + 1) % 1048573 * 2654435761) % 4294967296) % 10001 AS INTEGER) AS q{k}" for k in range(DIM)) + " FROM events",
        "round_robin": "SELECT CAST(w AS INTEGER) AS worker, CAST((SELECT count(*) FROM events) // 8 AS BIGINT) AS n FROM range(8) t(w)",
    }
