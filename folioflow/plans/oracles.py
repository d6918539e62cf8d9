"""DuckDB twins of the registered queries, where SQL can express them."""

from __future__ import annotations

from folioflow.functions.hashing import MINHASH_EMPTY, MINHASH_MODULUS, minhash_coefficients
from folioflow.functions.text import STOP_WORDS
from folioflow.plans.queries import BANDS, HASHES

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOPS}))"


def _split(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


def _bloom(item: str, m: int, i: str) -> str:
    digest = f"sha256({item} || {i})"
    at = "0::BIGINT"
    for word in range(8):
        at = f"(({at}) * 4294967296 + CAST('0x' || substr({digest}, {8 * word + 1}, 8) AS BIGINT)) % {m}"
    return at


def _draw(n: str, text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {n}"


DOCS = f"""docs AS (SELECT CAST(doc_id AS VARCHAR) AS _id, doc_id AS ord, array_to_string(list_slice({_split('text')}, 1, 6), ' ') AS title, text AS content,
  {_tokens('text')} AS tok, source AS category FROM documents),
tags AS (SELECT DISTINCT _id, ord, category, tag FROM (SELECT _id, ord, category, unnest(list_slice(tok, 1, 3)) AS tag FROM docs))"""
EVENTS = """ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
acc AS (SELECT user_id, CAST(k AS VARCHAR) AS document_id, event_id AS seq FROM ev)"""
STATES = """ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
st AS (SELECT event_id, lag(event_type) OVER w AS from_state, event_type AS to_state, event_type AS state, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 60000000.0 AS time_in_state,
  value AS throughput, value / 500 AS utilization, k::DOUBLE AS queue_length, event_type = 'error' AS bottleneck FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
MATRIX = STATES + """,
tc AS (SELECT from_state, to_state, count(*) AS n FROM st WHERE from_state IS NOT NULL GROUP BY ALL),
ss AS (SELECT from_state AS s FROM tc UNION SELECT to_state FROM tc),
tm AS (SELECT a.s AS from_state, b.s AS to_state, CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY a.s) > 0 THEN coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY a.s) ELSE 1.0 / count(*) OVER (PARTITION BY a.s) END AS prob
  FROM ss a CROSS JOIN ss b LEFT JOIN tc ON from_state = a.s AND to_state = b.s)"""
GRAPH = """ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ed AS (SELECT * FROM (SELECT lpad(CAST(k AS VARCHAR), 3, '0') AS src, lead(lpad(CAST(k AS VARCHAR), 3, '0')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM ev) WHERE dst IS NOT NULL),
nd AS (SELECT src AS id FROM ed UNION SELECT dst FROM ed)"""


def _pagerank(rounds: int, head: str) -> str:
    """CTEs over ed (src, dst) and nd (id); the result is pr (id, score)."""
    out = head + """,
dg AS (SELECT nd.id, count(src) AS degree FROM nd LEFT JOIN ed ON src = id GROUP BY nd.id),
lk AS (SELECT DISTINCT src, dst FROM ed), nn AS (SELECT count(*) AS n FROM nd),
p0 AS (SELECT id, degree, 1.0::DOUBLE / n AS score FROM dg, nn)"""
    for i in range(rounds):
        out += f""",
p{i + 1} AS MATERIALIZED (SELECT p.id, p.degree, 0.15 / n + 0.85 * (coalesce(g, 0) + coalesce(lost, 0) / n) AS score FROM p{i} p
  LEFT JOIN (SELECT dst, sum(q.score / q.degree) AS g FROM lk JOIN p{i} q ON q.id = lk.src GROUP BY dst) ON dst = p.id, nn, (SELECT sum(score) AS lost FROM p{i} WHERE degree = 0))"""
    return out + f", pr AS (SELECT id, score / sum(score) OVER () AS score FROM p{rounds})"


PAGERANK = _pagerank(20, GRAPH)
TAG_GRAPH = f"{DOCS}, ed AS MATERIALIZED (SELECT DISTINCT a._id AS src, b._id AS dst FROM tags a JOIN tags b ON a.tag = b.tag AND a._id <> b._id), nd AS (SELECT DISTINCT src AS id FROM ed)"
ADJACENT = GRAPH + ", adj AS (SELECT src, list_sort(list(DISTINCT dst)) AS nx FROM ed GROUP BY src)"


def _walk(steps: int, starts: str, back: float = 0.0) -> str:
    out = f"{ADJACENT}, w0 AS ({starts})"
    for s in range(1, steps + 1):
        step = f"nx[{_draw('len(nx)', f"'42:' || walk_id || ':{s}'")} + 1]"
        if back:
            step = f"CASE WHEN {_draw('1000000', f"'42:back:' || walk_id || ':{s}'")} < {int(back * 1_000_000)} THEN start ELSE coalesce({step}, node) END"
        out += f", w{s} AS MATERIALIZED (SELECT walk_id, start, coalesce({step}, node) AS node FROM w{s - 1} LEFT JOIN adj ON src = node)"
    return out + ", wk AS (" + " UNION ALL ".join(f"SELECT walk_id, {s} AS step, node FROM w{s}" for s in range(steps + 1)) + ")"


_NODE_STARTS = "SELECT id AS walk_id, id AS start, id AS node FROM nd"
_STUDY = f"SELECT CAST(w AS VARCHAR) AS walk_id, al[{_draw('len(al)', "'42:start:' || w")} + 1] AS start, al[{_draw('len(al)', "'42:start:' || w")} + 1] AS node FROM range(100) AS r(w), (SELECT list_sort(list(id)) AS al FROM (SELECT id FROM nd ORDER BY id LIMIT 10))"

_CHAR = "CASE WHEN length(t) = 0 THEN [] WHEN length(t) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) END"
SETS = f"{DOCS}, sets AS (SELECT id, {_CHAR} AS sh FROM (SELECT _id AS id, lower(title || ' ' || content) AS t FROM docs))"


def _words(k: int) -> str:
    return f"""{DOCS}, sets AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(list_slice(w, i, i + {k - 1}), ' '))) END AS sh
  FROM (SELECT _id AS id, {_split("lower(title || ' ' || content)")} AS w FROM docs))"""


_AB = ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(minhash_coefficients(HASHES)))
_MD5 = " + ".join(f"CAST('0x' || substr(md5(s), {8 * w + 1}, 8) AS BIGINT)" for w in range(4))
SIGNED = f"""{SETS}, ab(i, a, b) AS (VALUES {_AB}),
es AS (SELECT id, unnest(sh) AS s FROM sets), ds AS (SELECT s, CAST(({_MD5}) % {MINHASH_MODULUS} AS HUGEINT) AS x FROM (SELECT DISTINCT s FROM es)),
hs AS MATERIALIZED (SELECT s, i, CAST((a * x + b) % {MINHASH_MODULUS} AS BIGINT) AS h FROM ds, ab),
mn AS (SELECT id, i, min(h) AS h FROM es JOIN hs ON es.s = hs.s GROUP BY id, i),
sg AS MATERIALIZED (SELECT sets.id, CASE WHEN len(sh) = 0 THEN list_transform(range({HASHES}), lambda q: {MINHASH_EMPTY}::BIGINT) ELSE sig END AS sig FROM sets LEFT JOIN (SELECT id, list(h ORDER BY i) AS sig FROM mn GROUP BY id) m ON m.id = sets.id)"""
_ROWS = HASHES // BANDS
LSH = f"""{SIGNED}, mem AS (SELECT id, min(id) OVER (PARTITION BY sig) AS class_id, count(*) OVER (PARTITION BY sig) AS members FROM sg),
cl AS (SELECT sg.id, sig, members FROM sg JOIN mem ON mem.id = sg.id WHERE class_id = sg.id),
bd AS (SELECT id, members, band, list_slice(sig, band * {_ROWS} + 1, band * {_ROWS} + {_ROWS}) AS bucket FROM cl, range({BANDS}) AS r(band)),
ca AS MATERIALIZED (SELECT DISTINCT a.id AS id1, b.id AS id2 FROM bd a JOIN bd b ON a.band = b.band AND a.bucket = b.bucket AND a.id < b.id),
sp AS MATERIALIZED (SELECT id1, id2, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / {HASHES}.0 AS similarity, x.members AS n1, y.members AS n2 FROM ca JOIN cl x ON x.id = id1 JOIN cl y ON y.id = id2),
cc AS (SELECT mem.id, coalesce(other, 0) + members - 1 AS candidates FROM mem LEFT JOIN (SELECT id1, sum(members) AS other FROM (SELECT id1, id2 FROM ca UNION ALL SELECT id2, id1 FROM ca) JOIN cl ON cl.id = id2 GROUP BY id1) ON id1 = class_id),
pw AS (SELECT id1, n1, id2, n2, similarity FROM sp UNION ALL SELECT id, members, id, members, 1.0 FROM cl WHERE members > 1)"""
GROUPS = """WITH RECURSIVE {head}, eg AS (SELECT id1 AS a, id2 AS b FROM sp WHERE similarity >= 0.9 UNION SELECT id2, id1 FROM sp WHERE similarity >= 0.9),
rc AS (SELECT a AS v, a AS l FROM eg UNION SELECT eg.b, rc.l FROM rc JOIN eg ON eg.a = rc.v), co AS (SELECT v, min(l) AS component FROM rc GROUP BY v),
gr AS (SELECT mem.id, coalesce(component, class_id) AS component FROM mem LEFT JOIN co ON v = class_id WHERE component IS NOT NULL OR members > 1)"""
_JOBS = f"""WITH {DOCS}, {STATES},
jp AS (SELECT 'word_count' AS job, w AS key, '1' AS value FROM (SELECT unnest(list_concat({_split('lower(title)')}, list_slice({_split('lower(content)')}, 1, 50))) AS w FROM docs) WHERE length(w) > 3
  UNION ALL SELECT 'categories', category, CAST(length(content) AS VARCHAR) FROM docs UNION ALL SELECT 'transitions', from_state || ' → ' || to_state, '1' FROM st WHERE from_state IS NOT NULL),
ji AS (SELECT 'word_count' AS job, count(*) AS n FROM docs UNION ALL SELECT 'categories', count(*) FROM docs UNION ALL SELECT 'transitions', count(*) FROM st),
jk AS (SELECT job, key, count(*) AS n, sum(strlen(key) + strlen(value)) AS bytes, max(strlen(key) + strlen(value)) AS one FROM jp GROUP BY job, key),
jm AS (SELECT job, sum(n) AS m, count(*) AS u, sum(bytes) AS comm, sum(one) AS stor FROM jk GROUP BY job),
jc AS (SELECT ji.job, n AS input_size, CAST(m AS BIGINT) AS map_output_size, u AS unique_keys, u AS output_size, round(m / n, 6) AS expansion_factor, round(m / u, 6) AS avg_values_per_key, round(n / u, 6) AS compression_ratio,
  CAST(n + m + u AS BIGINT) AS computation_cost, CAST(comm AS BIGINT) AS communication_cost, CAST(stor AS BIGINT) AS storage_cost, round(greatest(0, least(1, 1 - m / (n * 10))), 6) AS map_selectivity, round(greatest(0, least(1, 1 - u / m)), 6) AS reduce_selectivity,
  0.0::DOUBLE AS total_time, 0.0::DOUBLE AS throughput, round(30 * greatest(0, least(1, 1 - m / (n * 10))) + 30 * greatest(0, least(1, 1 - u / m)), 6) AS score FROM ji JOIN jm ON ji.job = jm.job)"""
_SEARCHED = [w for w in "there that tion onthe".split() if w not in STOP_WORDS and len(w) > 2]
_Q = "[" + ", ".join(f"'{w}'" for w in _SEARCHED) + "]"
_RES = "sm AS (SELECT event_id, user_id, event_type AS query, k AS results_count FROM ev ORDER BY md5('42:' || event_id), event_id LIMIT {n})"
_STATIONARY = f"WITH {MATRIX}, v0 AS (SELECT s AS state, 1.0::DOUBLE / count(*) OVER () AS probability FROM ss)" + "".join(f", v{i + 1} AS MATERIALIZED (SELECT to_state AS state, sum(prob * probability) AS probability FROM tm JOIN v{i} ON from_state = state GROUP BY to_state)" for i in range(200))
_TOPLIST = "(SELECT string_agg(x || ':' || n, ',' ORDER BY n DESC, x) FROM (SELECT {c} AS x, count(*) AS n FROM sm GROUP BY 1 ORDER BY n DESC, x LIMIT 5))"

_POWER = f"WITH {MATRIX}, q1 AS (SELECT * FROM tm)" + "".join(f", q{2 * k} AS MATERIALIZED (SELECT a.from_state, b.to_state, sum(a.prob * b.prob) AS prob FROM q{k} a JOIN q{k} b ON a.to_state = b.from_state GROUP BY ALL)" for k in (1, 2, 4, 8, 16, 32))
_HITTING = f"WITH {MATRIX}, h0 AS (SELECT s AS state, 0.0::DOUBLE AS steps FROM ss)" + "".join(f", h{k + 1} AS MATERIALIZED (SELECT from_state AS state, CASE WHEN from_state = 'purchase' THEN 0.0 ELSE 1 + sum(prob * steps) END AS steps FROM tm JOIN h{k} ON to_state = state GROUP BY from_state)" for k in range(250))
_TRAJECTORY = f"""WITH {MATRIX}, up AS (SELECT *, sum(prob) OVER (PARTITION BY from_state ORDER BY to_state) AS upper FROM tm WHERE prob > 0), nx AS (SELECT from_state, list({{'u': upper, 't': to_state}} ORDER BY upper) AS l FROM up GROUP BY 1),
al AS (SELECT list_sort(list(s)) AS a FROM ss), t0 AS (SELECT w, a[{_draw('len(a)', "'42:start:' || w")} + 1] AS state FROM range(50) AS r(w), al)""" + "".join(
    f", t{k} AS MATERIALIZED (SELECT w, coalesce(list_filter(l, lambda x: x.u > {_draw('4294967296', f"'42:' || w || ':{k}'")} / 4294967296.0::DOUBLE)[1].t, l[-1].t) AS state FROM t{k - 1} JOIN nx ON from_state = state)" for k in range(1, 10)
)

ORACLE = {
    "search_topk": f"WITH {DOCS}, h AS (SELECT _id, ord, len(list_filter({_Q}, lambda q: list_contains(tok, q) OR list_contains({_tokens('title')}, q))) AS hits, len(list_filter({_Q}, lambda q: list_contains({_tokens('title')}, q))) AS th, len(list_filter({_Q}, lambda q: list_contains(list_slice(tok, 1, 3), q))) AS gh, list_position(list_transform({_Q}, lambda q: list_contains(tok, q) OR list_contains({_tokens('title')}, q)), true) AS fp FROM docs) SELECT _id, (hits + 3.0 * th + 2.0 * gh + {0.5 if len(_SEARCHED) > 1 else 0} * hits)::DOUBLE AS score FROM h WHERE hits > 0 ORDER BY score DESC, fp, ord LIMIT 10",
    "search_indexed": f"WITH {DOCS}, h AS (SELECT _id, ord, len(list_filter({_Q}, lambda q: list_contains(tok, q) OR list_contains({_tokens('title')}, q))) AS hits, len(list_filter({_Q}, lambda q: list_contains({_tokens('title')}, q))) AS th, len(list_filter({_Q}, lambda q: list_contains(list_slice(tok, 1, 3), q))) AS gh, list_position(list_transform({_Q}, lambda q: list_contains(tok, q) OR list_contains({_tokens('title')}, q)), true) AS fp FROM docs) SELECT _id, (hits + 3.0 * th + 2.0 * gh + {0.5 if len(_SEARCHED) > 1 else 0} * hits)::DOUBLE AS score FROM h WHERE hits > 0 ORDER BY score DESC, fp, ord LIMIT 10",
    "search_by_tag": f"WITH {DOCS} SELECT _id FROM docs WHERE list_contains(tok, 'that')",
    "filter_by_tag": f"WITH {DOCS} SELECT DISTINCT _id FROM tags WHERE tag = 'that'",
    "vocabulary_stats": f"WITH {DOCS} SELECT (SELECT count(*) FROM docs) AS num_documents, (SELECT count(DISTINCT w) FROM (SELECT unnest(list_concat(tok, {_tokens('title')})) AS w FROM docs)) AS vocabulary_size",
    "inverted_index_df": f"WITH {DOCS} SELECT word, count(*) AS documents, min(ord) AS first_ord FROM (SELECT DISTINCT _id, ord, unnest(list_concat(tok, {_tokens('title')})) AS word FROM docs) GROUP BY word",
    "hash_bucket_stats": f"WITH {DOCS}, c AS (SELECT list_sum(list_transform(string_split(_id, ''), lambda c: unicode(c))) % 2500 AS b, count(*) AS n FROM docs GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total_items, 2500::BIGINT AS table_size, round(sum(n) / 2500, 6) AS load_factor, 2500 - count(*) AS empty_buckets, max(n) AS max_chain_length, round(sum(n) / count(*), 2) AS avg_chain_length FROM c",
    "doc_lookup": f"WITH {DOCS} SELECT _id, title, category FROM docs WHERE _id = '7'",
    "doc_delete": f"WITH {DOCS} SELECT _id FROM docs WHERE _id <> '7'",
    "dedupe_insert": f"WITH {EVENTS} SELECT document_id AS _id, min(seq) AS ord, arg_min(user_id, seq) AS user_id FROM acc GROUP BY document_id",
    "recommend_by_tags": f"WITH {DOCS}, b AS (SELECT tag FROM tags WHERE _id = '1'), n AS (SELECT _id, count(*) AS n FROM tags GROUP BY _id), i AS (SELECT _id, count(*) AS i FROM tags WHERE tag IN (SELECT tag FROM b) AND _id <> '1' GROUP BY _id) SELECT i._id, round(i / (n + (SELECT count(*) FROM b) - i), 6) AS similarity FROM i JOIN n ON n._id = i._id ORDER BY i / (n + (SELECT count(*) FROM b) - i) DESC, i._id LIMIT 5",
    "recommend_popular": f"WITH {DOCS}, {EVENTS}, t AS (SELECT document_id, count(*) AS accesses FROM acc GROUP BY 1 ORDER BY accesses DESC, document_id LIMIT 100) SELECT document_id AS _id, accesses FROM t WHERE document_id IN (SELECT _id FROM docs) ORDER BY accesses DESC, _id LIMIT 5",
    "recommend_random": f"WITH {DOCS} SELECT _id FROM docs ORDER BY md5('42:' || _id), _id LIMIT 5",
    "recommend_hybrid": f"""WITH {DOCS}, {EVENTS}, b AS (SELECT tag FROM tags WHERE _id = '1'), n AS (SELECT _id, count(*) AS n FROM tags GROUP BY _id), i AS (SELECT _id, count(*) AS i FROM tags WHERE tag IN (SELECT tag FROM b) AND _id <> '1' GROUP BY _id),
s AS (SELECT i._id, i / (n + (SELECT count(*) FROM b) - i) AS score, 'similar' AS kind FROM i JOIN n ON n._id = i._id ORDER BY score DESC, i._id LIMIT 3),
t AS (SELECT document_id AS _id, count(*) AS accesses FROM acc GROUP BY 1 ORDER BY accesses DESC, document_id LIMIT 100),
p AS (SELECT _id, least(accesses / 100.0, 1.0) AS score, 'popular' AS kind FROM t WHERE _id IN (SELECT _id FROM docs) AND _id NOT IN (SELECT _id FROM s) ORDER BY accesses DESC, _id LIMIT (7 - (SELECT count(*) FROM s))),
e AS (SELECT _id, 0.5 AS score, 'exploration' AS kind FROM docs WHERE _id NOT IN (SELECT _id FROM s) AND _id NOT IN (SELECT _id FROM p) ORDER BY md5('42:' || _id), _id LIMIT 3)
SELECT _id, round(score, 6)::DOUBLE AS score, kind FROM (SELECT * FROM s UNION ALL SELECT * FROM p UNION ALL SELECT * FROM e) ORDER BY md5('42:shuffle:' || _id || ':' || kind), _id LIMIT 10""",
    "user_stats": f"WITH {DOCS}, {EVENTS}, t AS (SELECT user_id, tag, count(*) AS n FROM (SELECT DISTINCT user_id, document_id FROM acc) JOIN tags ON _id = document_id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tag) AS r FROM t), f AS (SELECT user_id, string_agg(tag || ':' || n, ',' ORDER BY r) AS l FROM r WHERE r <= 5 GROUP BY 1) SELECT a.user_id, total_accesses, unique_documents, coalesce(l, '') AS favorite_tags FROM (SELECT user_id, count(*) AS total_accesses, count(DISTINCT document_id) AS unique_documents FROM acc GROUP BY 1) a LEFT JOIN f ON f.user_id = a.user_id",
    "bloom_positions_of": f"WITH {DOCS} SELECT _id, {_bloom('_id', 10_000, 'i')} AS pos FROM docs, range(3) AS r(i)",
    "bloom_fill_stats": f"WITH {EVENTS}, b AS (SELECT DISTINCT {_bloom('document_id', 10_000, 'i')} AS pos FROM (SELECT DISTINCT document_id FROM acc), range(3) AS r(i)), n AS (SELECT count(document_id) AS n FROM acc) SELECT 10000::BIGINT AS size, 3::BIGINT AS num_hashes, n AS num_items, (SELECT count(*) FROM b) AS bits_set, round((SELECT count(*) FROM b) / 10000, 6) AS fill_ratio, round(pow(1 - exp(-3.0 * n / 10000), 3), 6) AS false_positive_rate FROM n",
    "bloom_membership": f"WITH {DOCS}, {EVENTS}, b AS (SELECT DISTINCT {_bloom('document_id', 1000, 'i')} AS pos FROM (SELECT DISTINCT document_id FROM acc), range(3) AS r(i)) SELECT _id AS item, count(*) = count(b.pos) AS contained FROM (SELECT _id, {_bloom('_id', 1000, 'i')} AS pos FROM docs, range(3) AS r(i)) p LEFT JOIN b ON b.pos = p.pos GROUP BY _id",
    "exact_membership": f"WITH {DOCS}, {EVENTS} SELECT _id FROM docs WHERE _id IN (SELECT document_id FROM acc)",
    "bloom_optimal_params": "SELECT n, p, m, greatest(1, CAST(trunc(m / n * ln(2)) AS BIGINT)) AS k FROM (SELECT n, p, CAST(trunc(-n * ln(p) / pow(ln(2), 2)) AS BIGINT) AS m FROM (VALUES (1000::BIGINT, 0.01::DOUBLE), (100000::BIGINT, 0.001::DOUBLE)) AS v(n, p))",
    "most_frequent": f"WITH {EVENTS} SELECT document_id AS item, count(*) AS f FROM acc GROUP BY 1 ORDER BY f DESC, item LIMIT 10",
    "stream_distinct": "SELECT DISTINCT user_id FROM events",
    "stream_user_tracker": f"WITH {EVENTS} SELECT user_id, count(DISTINCT document_id) AS distinct_documents, count(*) AS total_accesses, round(1 - count(DISTINCT document_id) / count(*), 6) AS revisit_rate FROM acc GROUP BY 1",
    "stream_sliding": "SELECT s AS start_s, count(*) AS n FROM (SELECT (CAST(floor(epoch(ts) / 900) AS BIGINT) - x) * 900 AS s FROM events, (VALUES (0), (1), (2), (3)) AS v(x)) GROUP BY 1 HAVING s + 3600 <= (SELECT max(epoch(ts)) - 600 FROM events)",
    "stream_sessions": "WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, t, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS start_us, count(*) AS n FROM s GROUP BY user_id, k HAVING max(t) + 1800000000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)",
    "jaccard_distance_pair": f"WITH {SETS} SELECT round(1 - len(list_intersect(a.sh, b.sh)) / (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh))), 6) AS distance FROM sets a, sets b WHERE a.id = '1' AND b.id = '2'",
    "minhash_pair": f"WITH {SIGNED} SELECT round(len(list_filter(list_zip(a.sig, b.sig), lambda z: z[1] = z[2])) / {HASHES}.0, 6)::DOUBLE AS similarity FROM sg a, sg b WHERE a.id = '1' AND b.id = '2'",
    "reservoir_bottomk": f"WITH {EVENTS}, {_RES.format(n=100)} SELECT event_id, user_id, query, CAST(results_count AS BIGINT) AS results_count FROM sm",
    "search_sample_summary": f"WITH {EVENTS}, {_RES.format(n=200)} SELECT count(*) AS total_sampled, count(DISTINCT query) AS unique_queries, count(DISTINCT user_id) AS unique_users, round(avg(results_count), 6) AS avg_results, count(*) FILTER (results_count = 0) AS queries_with_no_results, {_TOPLIST.format(c='query')} AS most_common_queries, {_TOPLIST.format(c='user_id')} AS most_active_users FROM sm",
    "query_suggestions": f"WITH {EVENTS}, {_RES.format(n=200)} SELECT query, count(*) AS n FROM sm GROUP BY 1 ORDER BY n DESC, query LIMIT 10",
    "stream_reservoir": f"WITH {EVENTS}, {_RES.format(n=100)} SELECT event_id FROM sm",
    "distinct_stats": f"WITH {EVENTS} SELECT count(document_id) AS total_count, count(DISTINCT document_id) AS distinct_count, round(1 - count(DISTINCT document_id) / count(document_id), 6) AS duplication_rate FROM acc",
    "user_distinct": f"WITH {EVENTS} SELECT user_id, count(DISTINCT document_id) AS distinct_documents, count(*) AS total_accesses, round(1 - count(DISTINCT document_id) / count(*), 6) AS revisit_rate FROM acc GROUP BY 1",
    "global_distinct": f"WITH {EVENTS} SELECT count(DISTINCT user_id) AS total_users, count(DISTINCT document_id) AS distinct_documents, count(*) AS total_accesses, round(count(DISTINCT (user_id, document_id)) / count(DISTINCT user_id), 6) AS avg_documents_per_user FROM acc",
    "top_users_distinct": f"WITH {EVENTS} SELECT user_id, count(DISTINCT document_id) AS n FROM acc GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "top_users_total": f"WITH {EVENTS} SELECT user_id, count(*) AS n FROM acc GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "frequency_moments": f"WITH {EVENTS}, c AS (SELECT document_id, count(*) AS f FROM acc GROUP BY 1), t AS (SELECT sum(f) AS f1 FROM c) SELECT count(*) AS f0, CAST(sum(f) AS BIGINT) AS f1_sum, CAST(sum(f * f) AS BIGINT) AS f2, sum(pow(f, 3)) AS f3, round(-sum(f / f1 * log2(f / f1)), 6) AS entropy, round((sum(f * f) - sum(f)) / (sum(f) * (count(*) - 1)), 6) AS gini_coefficient, round(sum(f) / count(*), 6) AS avg_frequency FROM c, t",
    "access_distribution": f"WITH {EVENTS}, c AS (SELECT document_id, count(*) AS f FROM acc GROUP BY 1), t AS (SELECT sum(f) AS f1 FROM c), m AS (SELECT count(*) AS f0, CAST(sum(f) AS BIGINT) AS f1, CAST(sum(f * f) AS BIGINT) AS f2, -sum(f / f1 * log2(f / f1)) AS e FROM c, t) SELECT f1 AS total_accesses, f0 AS unique_documents, round(f1 / f0, 6) AS avg_accesses_per_doc, round(e, 6) AS entropy, round(log2(f0), 6) AS max_entropy, round(e / log2(f0), 6) AS entropy_ratio, round((f2 - f1) / (f1 * (f0 - 1)), 6) AS gini_coefficient, CASE WHEN e / log2(f0) > 0.9 THEN 'Muy uniforme' WHEN e / log2(f0) > 0.7 THEN 'Relativamente uniforme' WHEN e / log2(f0) > 0.5 THEN 'Moderadamente concentrada' ELSE 'Muy concentrada' END AS distribution_type, f2 AS moment_2 FROM m",
    "popularity_report": f"WITH {EVENTS}, c AS (SELECT document_id AS item, count(*) AS f FROM acc GROUP BY 1), t AS (SELECT * FROM c ORDER BY f DESC, item LIMIT 10) SELECT item, f, round((SELECT sum(f) FROM t) / (SELECT sum(f) FROM c), 6) AS coverage FROM t",
    "sliding_exact_count": "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS BIGINT) AS exact FROM events",
    "dgim_full_window": "SELECT event_type AS key, n - l + l // 2 AS estimate, n AS ones FROM (SELECT event_type, count(*) AS n, CAST(pow(2, floor(log2(count(*) + 1)) - 1) AS BIGINT) AS l FROM events GROUP BY 1)",
    "transition_matrix": f"WITH {MATRIX} SELECT from_state, to_state, round(prob, 6) AS prob FROM tm",
    "stationary_fixed20": f"{_STATIONARY} SELECT state, round(probability, 6) AS probability FROM v20",
    "stationary": f"{_STATIONARY} SELECT state, round(probability, 6) AS probability FROM v200",
    "n_step": f"WITH {MATRIX}, t2 AS (SELECT a.from_state, b.to_state, sum(a.prob * b.prob) AS prob FROM tm a JOIN tm b ON a.to_state = b.from_state GROUP BY ALL) SELECT a.from_state, b.to_state, round(sum(a.prob * b.prob), 6) AS prob FROM t2 a JOIN tm b ON a.to_state = b.from_state GROUP BY ALL",
    "chain_flags": f"{_POWER} SELECT (SELECT count(*) FROM ss) AS num_states, (SELECT count(*) FROM q64 WHERE prob > 0) = (SELECT count(*) * count(*) FROM ss) AS is_irreducible, EXISTS (SELECT 1 FROM tm WHERE from_state = to_state AND prob > 0) AS is_aperiodic",
    "hitting_exact": f"{_HITTING} SELECT state, round(steps, 6) AS steps FROM h250",
    "chain_initial_distribution": "SELECT state, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS prob FROM (SELECT arg_min(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id) GROUP BY state",
    "markov_trajectories": f"{_TRAJECTORY} " + " UNION ALL ".join(f"SELECT w AS walk_id, {k}::BIGINT AS step, state FROM t{k}" for k in range(10)),
    "document_importance": f"WITH {_pagerank(12, TAG_GRAPH)} SELECT id, round(score, 6) AS score, title, coalesce(category, 'unknown') AS category FROM (SELECT id, score FROM pr ORDER BY score DESC, id LIMIT 10) JOIN docs ON _id = id",
    "pagerank_converged": f"WITH {_pagerank(60, GRAPH)} SELECT id, round(score, 6) AS score FROM pr",
    "tag_network": f"WITH {DOCS} SELECT DISTINCT a._id AS src, b._id AS dst FROM tags a JOIN tags b ON a.tag = b.tag AND a._id <> b._id",
    "pagerank_fixed20": f"WITH {PAGERANK} SELECT id, round(score, 6) AS score FROM pr",
    "pagerank_stats": f"WITH {PAGERANK} SELECT (SELECT count(*) FROM nd) AS num_nodes, (SELECT count(*) FROM ed) AS num_edges, round(avg(score), 6) AS avg_pagerank, round(max(score), 6) AS max_pagerank, round(min(score), 6) AS min_pagerank, round(stddev_pop(score), 6) AS std_pagerank, round((SELECT count(*) FROM ed) / (SELECT count(*) FROM nd), 6) AS avg_out_degree, round((SELECT count(*) / count(DISTINCT dst) FROM ed), 6) AS avg_in_degree FROM pr",
    "node_report": f"WITH {PAGERANK} SELECT id, round(score, 6) AS score, (SELECT count(DISTINCT src) FROM ed WHERE dst = id) AS referenced_by, (SELECT count(*) FROM ed WHERE src = id) AS references FROM pr",
    "neighbour_recs": f"WITH {PAGERANK} SELECT id, round(score, 6) AS score FROM pr WHERE id IN (SELECT dst FROM ed WHERE src = '007') ORDER BY pr.score DESC, id LIMIT 5",
    "graph_degrees": f"WITH {GRAPH}, d AS (SELECT id, (SELECT count(DISTINCT dst) FROM ed WHERE src = id) AS d FROM nd) SELECT count(*) AS num_nodes, CAST(sum(d) AS BIGINT) AS num_edges, round(avg(d), 6) AS avg_degree, max(d) AS max_degree, min(d) AS min_degree FROM d",
    "walk_paths": f"WITH {_walk(5, _NODE_STARTS)} SELECT walk_id, CAST(step AS BIGINT) AS step, node FROM wk",
    "walk_summary": f"WITH {_walk(5, _NODE_STARTS)} SELECT walk_id, count(*) AS length, count(DISTINCT node) AS unique_nodes, round(count(DISTINCT node) / (SELECT count(*) FROM nd), 6) AS coverage FROM wk GROUP BY 1",
    "navigation_coverage": f"WITH {_walk(30, _STUDY, 0.1)}, pw AS (SELECT walk_id, count(DISTINCT node) AS u FROM wk GROUP BY 1) SELECT count(*) AS sessions, round(avg(u / (SELECT count(*) FROM nd)), 6) AS mean_coverage, round(avg(u), 6) AS mean_unique_nodes FROM pw",
    "navigation_report": f"WITH {_walk(30, _STUDY, 0.1)} SELECT node, count(*) AS visits, round(count(*) / (SELECT count(*) FROM wk), 6) AS frequency FROM wk GROUP BY 1 ORDER BY visits DESC, node LIMIT 10",
    "walk_recs": f"WITH {_walk(10, "SELECT CAST(w AS VARCHAR) AS walk_id, '007' AS start, '007' AS node FROM range(100) AS r(w)")} SELECT node, count(*) AS visits FROM wk WHERE node <> '007' GROUP BY 1 ORDER BY visits DESC, node LIMIT 5",
    "word_count": f"WITH {DOCS} SELECT word, count(*) AS n FROM (SELECT unnest(list_concat({_split('lower(title)')}, list_slice({_split('lower(content)')}, 1, 50))) AS word FROM docs) WHERE length(word) > 3 GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
    "category_stats": f"WITH {DOCS} SELECT category, count(*) AS count, round(avg(length(content)), 6) AS avg_content_length, 0.0::DOUBLE AS avg_processing_time, round(avg(CASE WHEN len(tok) > 0 THEN 1 ELSE 0 END) * 100, 6) AS with_tags_percentage FROM docs GROUP BY 1",
    "tag_counts": f"WITH {DOCS} SELECT tag, count(*) AS n FROM tags GROUP BY 1 ORDER BY n DESC, tag LIMIT 10",
    "tag_pairs": f"WITH {DOCS} SELECT a.tag AS tag1, b.tag AS tag2, count(*) AS n FROM tags a JOIN tags b ON a._id = b._id AND a.tag < b.tag GROUP BY ALL ORDER BY n DESC, tag1, tag2 LIMIT 10",
    "transitions_top": f"WITH {STATES} SELECT coalesce(from_state, 'unknown') || ' → ' || to_state AS transition, count(*) AS n, round(count(*) / (SELECT count(*) FROM st) * 100, 6) AS percentage FROM st GROUP BY 1 ORDER BY n DESC, transition LIMIT 15",
    "efficiency_by_state": f"WITH {STATES} SELECT state, count(*) AS count, round(avg(coalesce(throughput, 0)), 6) AS avg_throughput, round(avg(coalesce(utilization, 0)), 6) AS avg_utilization, round(avg(coalesce(queue_length, 0)), 6) AS avg_queue_length, round(avg(bottleneck::INT) * 100, 6) AS bottleneck_rate FROM st GROUP BY 1",
    "system_health": f"WITH {STATES} SELECT round(avg(coalesce(throughput, 0)), 6) AS avg_throughput, round(avg(coalesce(utilization, 0)), 6) AS avg_utilization, round(avg(coalesce(queue_length, 0)), 6) AS avg_queue_length, round(least(avg(coalesce(utilization, 0)), 1), 6) AS health_score FROM st",
    "workflow_states": f"WITH {STATES}, t AS (SELECT state, avg(coalesce(time_in_state, 0)) AS a FROM st GROUP BY 1) SELECT state, round(a, 6) AS avg_time, row_number() OVER (ORDER BY a DESC, state) AS place, round((SELECT avg(bottleneck::INT) FROM st) * 100, 6) AS bottleneck_rate FROM t",
    "multi_key_stats": f"WITH {DOCS}, d AS (SELECT docs.*, CASE WHEN toxic IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'toxic' ELSE 'plain' END AS state FROM docs LEFT JOIN labels ON doc_id = ord), k AS (SELECT 'cat' AS kind, coalesce(category, 'unknown') AS key, length(content)::DOUBLE AS v FROM d UNION ALL SELECT 'state', state, 1.0 FROM d UNION ALL SELECT 'tag', tag, 1.0 FROM tags) SELECT kind, key, count(*) AS count, sum(v) AS total FROM k GROUP BY ALL",
    "first_of_category": "SELECT CAST(doc_id AS VARCHAR) AS _id, source AS category FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 100",
    "filtered_count": "SELECT count(*) AS n FROM documents WHERE source = 'src3'",
    "part_count": "SELECT p_type AS key, count(*) AS n FROM part GROUP BY 1",
    "part_avg": "SELECT p_type AS key, round(avg(p_size), 6) AS average FROM part GROUP BY 1",
    "part_stats": "SELECT p_type AS key, count(p_size) AS n, CAST(sum(p_size) AS BIGINT) AS total, round(avg(p_size), 6) AS average, CAST(min(p_size) AS BIGINT) AS minimum, CAST(max(p_size) AS BIGINT) AS maximum FROM part GROUP BY 1",
    "map_reduce_stats": "SELECT p_type AS key, round(avg(p_size), 6) AS result FROM part GROUP BY 1",
    "document_labels": "SELECT source AS category, count(*) AS labelled, round(avg(quality), 6) AS avg_quality, round(avg(toxic), 6) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "job_costs": f"{_JOBS} SELECT * FROM jc",
    "job_compare": f"{_JOBS} SELECT job, score, job = (SELECT arg_max(job, score) FROM jc) AS is_best, job = (SELECT arg_min(job, score) FROM jc) AS is_worst, array_to_string(list_filter([CASE WHEN map_selectivity < 0.3 THEN 'the map step makes many pairs: filter earlier' END, CASE WHEN reduce_selectivity < 0.3 THEN 'the reduce step shrinks little: check the aggregation' END, CASE WHEN communication_cost > computation_cost THEN 'much communication: use combiners' END, CASE WHEN score > 70 THEN 'well optimized' END], lambda x: x IS NOT NULL), '; ') AS advice FROM jc",
    "char_shingles": f"WITH {SETS} SELECT id, len(sh) AS n, list_min(sh) AS least FROM sets",
    "word_shingles": f"WITH {_words(2)} SELECT id, len(sh) AS n, list_min(sh) AS least FROM sets",
    "shingle_positions": f"WITH {DOCS}, p AS (SELECT t, unnest(range(0, length(t) - 2)) AS position FROM (SELECT lower(title || ' ' || content) AS t FROM docs) WHERE length(t) >= 3) SELECT substr(t, position + 1, 3) AS shingle, count(*) AS n, max(position) AS last FROM p GROUP BY 1",
    "shingle_stats": f"WITH {SETS} SELECT count(*) AS num_documents, round(avg(len(sh)), 6) AS avg_shingles_per_doc, min(len(sh)) AS min_shingles, max(len(sh)) AS max_shingles, (SELECT count(DISTINCT s) FROM (SELECT unnest(sh) AS s FROM sets)) AS total_unique_shingles FROM sets",
    "jaccard_pairs": f"WITH {_words(5)}, c AS (SELECT min(id) AS id, k FROM (SELECT id, list_sort(sh) AS k FROM sets) GROUP BY k), e AS (SELECT id, len(k) AS n, unnest(k) AS s FROM c), i AS (SELECT a.id AS id1, b.id AS id2, a.n AS n1, b.n AS n2, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.id < b.id GROUP BY ALL) SELECT id1, id2, round(c / (n1 + n2 - c), 6) AS similarity FROM i WHERE c / (n1 + n2 - c) >= 0.8",
    "jaccard_classes": f"WITH {_words(5)} SELECT id, min(id) OVER (PARTITION BY list_sort(sh)) AS class_id FROM sets",
    "jaccard_similar_to": f"WITH {SETS}, o AS (SELECT sh AS own FROM sets WHERE id = '1'), s AS (SELECT id, len(list_intersect(sh, own)) / (len(sh) + len(own) - len(list_intersect(sh, own))) AS j FROM sets, o WHERE id <> '1') SELECT id, round(j, 6) AS similarity FROM s WHERE j >= 0.3 ORDER BY j DESC, id LIMIT 10",
    "minhash_signature": f"WITH {SIGNED} SELECT id, array_to_string(sig, ',') AS signature FROM sg",
    "minhash_similar_to": f"WITH {SIGNED}, o AS (SELECT sig AS own FROM sg WHERE id = '1'), s AS (SELECT id, len(list_filter(list_zip(sig, own), lambda z: z[1] = z[2])) / {HASHES}.0 AS j FROM sg, o WHERE id <> '1') SELECT id, round(j, 6)::DOUBLE AS similarity FROM s WHERE j >= 0.5 ORDER BY j DESC, id LIMIT 10",
    "minhash_stats": f"WITH {SETS}, t AS (SELECT count(*) AS n, sum(len(sh)) AS s FROM sets) SELECT n AS num_documents, 100::BIGINT AS signature_size, round(n * 800 / 1024, 6) AS space_signatures_kb, round(s * 50 / 1024, 6) AS space_original_kb, round(s * 50 / (n * 800), 6) AS compression_ratio FROM t",
    "lsh_pairs": f"WITH {LSH} SELECT least(a.id, b.id) AS id1, greatest(a.id, b.id) AS id2, round(similarity, 6)::DOUBLE AS similarity FROM pw JOIN mem a ON a.class_id = id1 JOIN mem b ON b.class_id = id2 WHERE similarity >= 0.9 AND (id1 <> id2 OR a.id < b.id)",
    "lsh_members": f"WITH {LSH} SELECT id, class_id, members FROM mem",
    "lsh_stats": f"WITH {LSH}, b AS (SELECT band, bucket, sum(members) AS n FROM bd GROUP BY ALL) SELECT (SELECT count(*) FROM sg) AS num_documents, {BANDS}::BIGINT AS num_bands, {_ROWS}::BIGINT AS rows_per_band, count(*) AS total_buckets, round(avg(n), 6) AS avg_bucket_size, (SELECT round(avg(candidates), 6) FROM cc) AS avg_candidates_per_doc, round(pow(1.0 / {BANDS}, 1.0 / {_ROWS}), 6) AS theoretical_threshold FROM b",
    "lsh_savings": f"WITH {LSH}, t AS (SELECT count(*) AS n, sum(candidates)::DOUBLE AS e FROM cc) SELECT n * (n - 1) / 2 AS total_pairs, e AS estimated_comparisons, round((1 - e / (n * (n - 1) / 2)) * 100, 6) AS reduction_percent, round((n * (n - 1) / 2) / e, 6) AS speedup FROM t",
    "duplicate_groups": f"{GROUPS.format(head=LSH)} SELECT id, component FROM gr",
    "largest_duplicate_groups": f"{GROUPS.format(head=LSH)} SELECT component, count(*) AS size, (SELECT CAST(sum(CASE WHEN id1 = id2 THEN n1 * (n1 - 1) / 2 ELSE n1 * n2 END) AS BIGINT) FROM pw JOIN gr g2 ON g2.id = id1 WHERE similarity >= 0.9 AND g2.component = gr.component) AS pairs FROM gr GROUP BY 1 ORDER BY pairs DESC, component LIMIT 5",
    "jaccard_pair": f"WITH {SETS} SELECT round(len(list_intersect(a.sh, b.sh)) / (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh))), 6) AS similarity FROM sets a, sets b WHERE a.id = '1' AND b.id = '2'",
    "markov_simulated_time": f"{_TRAJECTORY}, al2 AS (" + " UNION ALL ".join(f"SELECT w, {k} AS step, state FROM t{k}" for k in range(10)) + "), f AS (SELECT w, min(step) AS s FROM al2 WHERE state = 'purchase' GROUP BY w) SELECT round(avg(s), 6) AS expected_time, count(*) AS reached FROM f",
    "similar_by_category": f"WITH {LSH}, c AS (SELECT class_id, category, count(*) AS n FROM mem JOIN docs ON _id = id GROUP BY ALL) SELECT x.category, id1 AS class1, id2 AS class2, round(similarity, 6)::DOUBLE AS similarity, x.n AS n1, y.n AS n2 FROM pw JOIN c x ON x.class_id = id1 JOIN c y ON y.class_id = id2 AND y.category = x.category WHERE similarity >= 0.7 AND (id1 <> id2 OR x.n > 1)",
    "similarity_distribution": f"WITH {LSH}, e AS (SELECT similarity::DOUBLE AS s, unnest(range(CASE WHEN id1 = id2 THEN n1 * (n1 - 1) ELSE 2 * n1 * n2 END)) FROM pw WHERE similarity >= 0.1) SELECT count(*) AS count, round(avg(s), 6) AS mean, round(coalesce(stddev_samp(s), 0), 6) AS stdev, min(s) AS min, max(s) AS max, round(median(s), 6) AS median FROM e",
    "system_stats": f"WITH {DOCS}, {EVENTS}, c AS (SELECT list_sum(list_transform(string_split(_id, ''), lambda c: unicode(c))) % 2500 AS b, count(*) AS n FROM docs GROUP BY 1) SELECT (SELECT count(*) FROM docs) AS num_documents, (SELECT count(DISTINCT w) FROM (SELECT unnest(list_concat(tok, {_tokens('title')})) AS w FROM docs)) AS vocabulary_size, (SELECT count(DISTINCT tag) FROM tags) AS unique_tags, (SELECT count(*) FROM acc) AS total_accesses, CAST(sum(n) AS BIGINT) AS total_items, 2500::BIGINT AS table_size, round(sum(n) / 2500, 6) AS load_factor, 2500 - count(*) AS empty_buckets, max(n) AS max_chain_length, round(sum(n) / count(*), 2) AS avg_chain_length FROM c",
    "stream_tumbling": "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL HAVING (CAST(floor(min(epoch(ts)) / 3600) AS BIGINT) + 1) * 3600 <= (SELECT max(epoch(ts)) - 600 FROM events)",
    "event_tumbling": "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL",
    "event_sliding": "SELECT s AS start_s, count(*) AS n FROM (SELECT (CAST(floor(epoch(ts) / 1800) AS BIGINT) - x) * 1800 AS s FROM events, (VALUES (0), (1)) AS v(x)) GROUP BY 1",
    "event_sessions": "WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, t, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS start_us, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_frequencies": "SELECT event_type AS item, count(*) AS f FROM events GROUP BY 1",
    "stream_bloom": f"SELECT DISTINCT {_bloom('CAST(user_id AS VARCHAR)', 1000, 'i')} AS pos FROM events, range(3) AS r(i)",
}
