"""DuckDB SQL for the registered queries of the mining operators, to check their results."""

from __future__ import annotations

from quarry.functions.hashing import FAMILY
from quarry.operators.recommend import GRAND_AVERAGE
from quarry.operators.sketch import BLOOM_BITS, BLOOM_HASHES, FM_GROUP, FM_GROUPS, FM_MODULUS, fm_coefficients
from quarry.operators.text import DELETED
from quarry.plans.queries import EDGE, PARTS, SMALL_BASKET, STOPWORDS, SUPPORT
from quarry.plans.views import SPLIT_DAY

RATINGS = """ratings AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS stars, o_orderdate AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RATED = RATINGS + ", rated AS (SELECT user_id, item_id, avg(stars) AS stars FROM ratings GROUP BY 1, 2)"
TRAIN = RATINGS + f""", train AS (SELECT user_id, item_id, stars FROM ratings WHERE day < TIMESTAMP '{SPLIT_DAY}'),
  test AS (SELECT DISTINCT user_id, item_id FROM ratings WHERE day >= TIMESTAMP '{SPLIT_DAY}'),
  truth AS (SELECT user_id, item_id, avg(stars) AS stars FROM ratings WHERE day >= TIMESTAMP '{SPLIT_DAY}' GROUP BY 1, 2),
  rated AS (SELECT user_id, item_id, avg(stars) AS stars FROM train GROUP BY 1, 2)"""
INTERACTIONS = RATINGS + ", interactions AS (SELECT DISTINCT user_id, item_id FROM ratings)"
BASKETS = f"""baskets AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL),
  bar AS (SELECT greatest(1, CAST(ceil({SUPPORT} * count(DISTINCT basket)) AS BIGINT)) AS s FROM baskets)"""


def similar(key: str, by: str) -> str:
    """A CTE sims(a, b, sim) of positive Pearson similarities over rated."""
    return f"""sums AS (SELECT x.{key} AS a, y.{key} AS b, count(*) AS n, sum(x.stars) AS sx, sum(y.stars) AS sy, sum(x.stars * x.stars) AS sxx,
    sum(y.stars * y.stars) AS syy, sum(x.stars * y.stars) AS sxy FROM rated x JOIN rated y ON x.{by} = y.{by} AND x.{key} < y.{key} GROUP BY 1, 2 HAVING count(*) >= 3),
  parts AS (SELECT a, b, sxy - sx * sy / n AS top, sqrt(greatest((sxx - sx * sx / n) * (syy - sy * sy / n), 0)) AS low FROM sums),
  sims AS (SELECT a, b, round(CASE WHEN abs(top) < 1e-9 OR low < 1e-9 THEN 0.0 ELSE top / low END, 6) AS sim FROM parts),
  model AS (SELECT * FROM sims WHERE sim > 0)"""


BOTH = "two AS (SELECT a AS x, b AS y, sim FROM model UNION ALL SELECT b, a, sim FROM model)"
BY_ITEMS = f"""{similar("item_id", "user_id")}, {BOTH},
  met AS (SELECT t.user_id, t.item_id, r.item_id AS y, r.stars, w.sim FROM test t JOIN rated r ON t.user_id = r.user_id JOIN two w ON w.x = t.item_id AND w.y = r.item_id),
  best AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY sim DESC, y) AS k FROM met),
  found AS (SELECT user_id, item_id, round(sum(stars * sim) / sum(sim), 6) AS stars FROM best WHERE k <= 9 GROUP BY 1, 2)"""

def levels(baskets: str, name: str = "sets", bar: str = "bar", by: str = "") -> str:
    """A CTE of all frequent itemsets (items, size, freq), whatever their size: each step joins the occurrences of frequent
    sets with the later items of their baskets. ``by``: a column that splits the baskets, with a bar for each value."""
    part, same = (f"{by}, ", f" AND bars.{by} = x.{by}") if by else ("", "")
    own = f"x.{by}, " if by else ""
    return f"""occ_{name} AS (SELECT {part}items, size, last, basket, freq FROM (SELECT {own}x.item AS items, 1 AS size, x.item AS last, x.basket, count(*) OVER (PARTITION BY {own}x.item) AS freq, bars.s
      FROM {baskets} x, {bar} bars WHERE TRUE{same}) WHERE freq >= s
    UNION ALL SELECT {part}items, size, last, basket, freq FROM (SELECT {own}x.items || ',' || g.item AS items, x.size + 1 AS size, g.item AS last, x.basket,
      count(*) OVER (PARTITION BY {own}x.items, g.item) AS freq, bars.s FROM occ_{name} x JOIN {baskets} g ON g.basket = x.basket AND g.item > x.last, {bar} bars WHERE TRUE{same}) WHERE freq >= s),
  {name} AS (SELECT {part}items, size, max(freq) AS freq FROM occ_{name} GROUP BY ALL)"""


SETS = f"WITH RECURSIVE {BASKETS}, {levels('baskets')} SELECT items, CAST(size AS BIGINT) AS size, freq FROM sets"
#: The same by parts of the baskets, each with the support scaled to its size.
SON = f"""WITH RECURSIVE {BASKETS}, p AS (SELECT *, basket % {PARTS} AS part FROM baskets), n AS (SELECT count(DISTINCT basket) AS total FROM p),
  bars AS (SELECT part, CAST(ceil(CAST(s * count(DISTINCT basket) AS DOUBLE) / total) AS BIGINT) AS s FROM p, bar, n GROUP BY part, s, total),
  {levels('p', 'sets', 'bars', 'part')} SELECT DISTINCT items, CAST(size AS BIGINT) AS size FROM sets"""


def signatures(key: str = "item_id", by: str = "user_id", n: int = 30) -> str:
    """CTEs: numbered members, and bands(id, band, value) of min-hash signatures over ``interactions``."""
    hashes = ", ".join(f"min(({a} * idx + {b}) % m) AS h{k}" for k, (a, b) in enumerate(FAMILY[:n]))
    names = ", ".join(f"h{k}" for k in range(n))
    return f"""ids AS (SELECT {by}, row_number() OVER (ORDER BY {by}) - 1 AS idx FROM (SELECT DISTINCT {by} FROM interactions)),
  m AS (SELECT 2 * count(*) AS m FROM ids), signs AS (SELECT {key} AS id, {hashes} FROM interactions JOIN ids USING ({by}), m GROUP BY 1),
  bands AS (SELECT id, CAST(unnest(range({n})) AS BIGINT) AS band, CAST(unnest([{names}]) AS BIGINT) AS value FROM signs),
  candidates AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.value = y.value AND x.id < y.id)"""


def jaccard(key: str = "item_id", by: str = "user_id") -> str:
    return f"""sizes AS (SELECT {key} AS id, count(*) AS n FROM interactions GROUP BY 1),
  common AS (SELECT x.{key} AS a, y.{key} AS b, count(*) AS common FROM interactions x JOIN interactions y ON x.{by} = y.{by} AND x.{key} < y.{key} GROUP BY 1, 2),
  jac AS (SELECT a, b, common, common / (p.n + q.n - common) AS sim FROM common JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b)"""


_deleted = DELETED.replace("'", "''")
_stop = ", ".join(f"'{w}'" for w in STOPWORDS)
WORDS = f"""reviews AS (SELECT doc_id % 50 AS user_id, source AS item_id, text FROM documents),
  words AS (SELECT item_id AS key, unnest(regexp_split_to_array(translate(lower(coalesce(text, '')), '{_deleted}', ''), '[\\x20\\x09-\\x0D]+')) AS word FROM reviews),
  kept AS (SELECT * FROM words WHERE regexp_full_match(word, '[a-z]+') AND word NOT IN ({_stop})),
  counts AS (SELECT key, word, count(*) AS n FROM kept GROUP BY 1, 2 HAVING count(*) >= 2),
  tf AS (SELECT key, word, n, n / max(n) OVER (PARTITION BY key) AS tf FROM counts),
  idf AS (SELECT word, count(*) AS df, ln((SELECT count(DISTINCT item_id) FROM reviews) / count(*)) AS idf FROM tf GROUP BY 1),
  scored AS (SELECT key, word, round(tf * idf, 9) AS score FROM tf JOIN idf USING (word)),
  items AS (SELECT key, word, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, word) AS r FROM scored) WHERE r <= 200),
  users AS (SELECT DISTINCT r.user_id, i.word FROM (SELECT DISTINCT user_id, item_id FROM reviews) r JOIN items i ON r.item_id = i.key)"""

EDGES = f"""{INTERACTIONS}, edges AS (SELECT x.user_id AS a, y.user_id AS b FROM interactions x JOIN interactions y ON x.item_id = y.item_id AND x.user_id < y.user_id
    GROUP BY 1, 2 HAVING count(*) >= {EDGE}),
  two AS (SELECT a AS src, b AS dst FROM edges UNION ALL SELECT b, a FROM edges), vertices AS (SELECT DISTINCT src AS v FROM two)"""
REACH = """reach AS (SELECT v AS v, v AS r FROM vertices UNION SELECT two.dst, reach.r FROM reach JOIN two ON two.src = reach.v), comps AS (SELECT v, min(r) AS component FROM reach GROUP BY 1)"""
LABELS = ", ".join(
    f"""l{k} AS (SELECT v, label FROM (SELECT v, label, row_number() OVER (PARTITION BY v ORDER BY n DESC, label) AS r FROM
    (SELECT src AS v, label, count(*) AS n FROM two JOIN l{k - 1} ON l{k - 1}.v = two.dst GROUP BY 1, 2)) WHERE r = 1)"""
    for k in range(1, 6)
)
#: Walks of each length with their counts; a pair's distance is its shortest walk, whose count is that of its paths.
BETWEEN = f"""WITH RECURSIVE {EDGES}, near AS (SELECT v AS s, v AS t, 0 AS d FROM vertices UNION SELECT near.s, two.dst, near.d + 1 FROM near JOIN two ON two.src = near.t WHERE near.d < 40),
  dist AS MATERIALIZED (SELECT s, t, min(d) AS d FROM near GROUP BY 1, 2),
  paths AS (SELECT v AS s, v AS t, 0 AS d, CAST(1 AS DOUBLE) AS n FROM vertices UNION ALL
    SELECT p.s, two.dst AS t, p.d + 1 AS d, sum(p.n) AS n FROM paths p JOIN two ON two.src = p.t JOIN dist q ON q.s = p.s AND q.t = two.dst AND q.d = p.d + 1 GROUP BY 1, 2, 3),
  sigma AS MATERIALIZED (SELECT s, t, d, n FROM paths),
  flows AS (SELECT e.a, e.b, x.s, y.t, x.n * y.n / z.n AS f FROM edges e JOIN sigma x ON x.t = e.a JOIN sigma y ON y.s = e.b JOIN sigma z ON z.s = x.s AND z.t = y.t AND z.d = x.d + 1 + y.d)
  SELECT a, b, round(sum(f), 6) AS score FROM flows GROUP BY 1, 2"""

POINTS = """dims AS (SELECT vec_id AS point_id, label, CAST(unnest(range(len(embedding))) AS BIGINT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  stats AS (SELECT label AS cluster, dim, count(*) AS n, sum(x) AS sum, sum(x * x) AS sumsq, sqrt(greatest(sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)), 0)) AS std FROM dims GROUP BY 1, 2)"""
NEAREST = """far AS (SELECT p.point_id, p.label, s.cluster, sqrt(sum((p.x - s.sum / s.n) * (p.x - s.sum / s.n))) AS d FROM dims p JOIN stats s ON s.dim = p.dim GROUP BY 1, 2, 3),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, cluster) AS r FROM far) WHERE r = 1)"""
FOLD = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(0, octet_length(encode({t}))), lambda i: CAST(('0x' || substr(hex(encode({t})), CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT))), lambda s, b: (s * 256 + b) % {m})"


def fm(by: str = "") -> str:
    """The Flajolet-Martin estimate over vals(by, v)."""
    keys = f"{by}, " if by else ""
    zeros = lambda h: f"CASE WHEN {h} = 0 THEN 32 ELSE bit_count(({h} & -{h}) - 1) END"
    r = ", ".join(f"max({zeros(f'((x * {a} + {b}) % {FM_MODULUS})')}) AS r{k}" for k, (a, b) in enumerate(fm_coefficients()))
    means = ", ".join("(" + " + ".join(f"r{g * FM_GROUP + k}" for k in range(FM_GROUP)) + f") / {FM_GROUP}.0::DOUBLE" for g in range(FM_GROUPS))
    return f"""xs AS (SELECT {keys}{FOLD.format(t="v", m=FM_MODULUS)} AS x FROM vals), rs AS (SELECT {keys}count(*) AS truth, {r} FROM xs {"GROUP BY " + by if by else ""}),
  ms AS (SELECT {keys}truth, list_sort([{means}]) AS m FROM rs) SELECT {keys}truth, round(CASE WHEN truth = 0 THEN 0.5 ELSE pow(2, (m[{FM_GROUPS // 2}] + m[{FM_GROUPS // 2 + 1}]) / 2) END, 6) AS estimate FROM ms"""


WINDOWS = "spread AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR * k AS window_start, user_id FROM events, (SELECT unnest([0, 1, 2]) AS k))"
_bits = ", ".join(f"({a} * x + {b}) % {BLOOM_BITS}" for a, b in FAMILY[:BLOOM_HASHES])
BLOOM = f"""names AS (SELECT DISTINCT n_name AS v FROM nation WHERE n_name <> ''), hashed AS (SELECT {FOLD.format(t="v", m=BLOOM_BITS)} AS x FROM names),
  bloom AS (SELECT DISTINCT CAST(unnest([{_bits}]) AS BIGINT) AS position FROM hashed)"""
STRANGE = "strange AS (SELECT user_id, item_id * 2 AS item_id FROM test UNION ALL SELECT user_id * 2, item_id * 2 FROM test)"
TRENDING = """SELECT tag, cnt FROM (SELECT *, dense_rank() OVER (ORDER BY cnt DESC) AS r FROM (SELECT event_type || ':' || json_extract_string(props, '$.k') AS tag, count(*) AS cnt FROM events GROUP BY 1)) WHERE r <= 3"""

HYBRID = f"""{similar("item_id", "user_id").replace("model AS", "plain AS")},
  model AS (SELECT a, b, sim FROM (SELECT a, b, round(sim * pow(abs(sim), 2.5), 6) AS sim FROM plain) WHERE sim > 0), {BOTH},
  known AS (SELECT * FROM test WHERE item_id IN (SELECT item_id FROM train)),
  met AS (SELECT t.user_id, t.item_id, r.item_id AS y, r.stars, coalesce(w.sim, 0.2) AS sim FROM known t JOIN rated r ON t.user_id = r.user_id LEFT JOIN two w ON w.x = t.item_id AND w.y = r.item_id),
  best AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY sim DESC, y) AS k FROM met),
  cf AS (SELECT user_id, item_id, sum(stars * sim) / sum(sim) AS cf FROM best WHERE k <= 9 GROUP BY 1, 2),
  um AS (SELECT user_id, avg(stars) AS um FROM train GROUP BY 1), im AS (SELECT item_id, avg(stars) AS im FROM train GROUP BY 1),
  mixed AS (SELECT user_id, item_id, cf, 0.625::DOUBLE * im + (1 - 0.625::DOUBLE) * um AS avg FROM cf JOIN um USING (user_id) JOIN im USING (item_id))
  SELECT user_id, item_id, round(CASE WHEN avg > 4.5 THEN 5.0 WHEN avg > 1.5 THEN avg ELSE round_even(round(0.6::DOUBLE * cf + 0.4::DOUBLE * avg, 9), 0) END, 6) AS stars FROM mixed"""

ORACLE_SQL: dict[str, str] = {
    "ratings_avg": f"WITH {RATED} SELECT user_id, item_id, round(stars, 6) AS stars FROM rated",
    "cf_item_similarity": f"WITH {RATED}, {similar('item_id', 'user_id')} SELECT * FROM model",
    "cf_item_amplified": f"WITH {RATED}, {similar('item_id', 'user_id')} SELECT a, b, round(sim * pow(abs(sim), 2.5), 6) AS sim FROM model",
    "cf_user_similarity": f"WITH {RATED}, {similar('user_id', 'item_id')} SELECT * FROM model",
    "cf_user_similarity_lsh": f"""WITH {RATED}, many AS (SELECT user_id FROM rated GROUP BY 1 HAVING count(*) >= 3),
  interactions AS (SELECT user_id, item_id FROM rated WHERE user_id IN (FROM many)), {signatures("user_id", "item_id", 50)}, {jaccard("user_id", "item_id")},
  {similar("user_id", "item_id")} SELECT model.* FROM model JOIN candidates USING (a, b) JOIN jac USING (a, b) WHERE jac.sim >= 0.01 AND common >= 3""",
    "cf_item_predict": f"WITH {TRAIN}, {BY_ITEMS} SELECT * FROM found",
    "cf_user_predict": f"""WITH {TRAIN}, {similar("user_id", "item_id")}, {BOTH}, means AS (SELECT user_id, avg(stars) AS mean FROM rated GROUP BY 1),
  met AS (SELECT t.user_id, t.item_id, r.user_id AS y, r.stars - m.mean AS o, w.sim FROM test t JOIN rated r ON t.item_id = r.item_id JOIN means m ON m.user_id = r.user_id
    JOIN two w ON w.x = t.user_id AND w.y = r.user_id), best AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY sim DESC, y) AS k FROM met),
  moved AS (SELECT user_id, item_id, sum(o * sim) / sum(sim) AS o FROM best WHERE k <= 9 GROUP BY 1, 2)
  SELECT user_id, item_id, round(least(greatest(mean + o, 0.0), 5.0), 6) AS stars FROM moved JOIN means USING (user_id)""",
    "user_avg": f"WITH {RATINGS} SELECT user_id, round(avg(stars), 6) AS mean FROM ratings GROUP BY 1",
    "business_avg": f"""WITH {TRAIN}, own AS (SELECT item_id, avg(stars) AS m FROM ratings GROUP BY 1), given AS (SELECT item_id, avg(stars) AS g FROM train GROUP BY 1)
  SELECT item_id, round(coalesce(g, m), 6) AS mean FROM own FULL JOIN given USING (item_id)""",
    "user_mean_of_means": f"WITH {RATED} SELECT user_id, round(avg(stars), 6) AS mean FROM rated GROUP BY 1",
    "hybrid_predict": f"WITH {TRAIN}, {HYBRID}",
    "hybrid_predict_all": f"""WITH {TRAIN.replace("  test AS (", "  tested AS (")}, strange AS (SELECT user_id, item_id * 2 AS item_id FROM tested UNION ALL SELECT user_id * 2, item_id * 2 FROM tested),
  test AS (SELECT * FROM tested UNION SELECT * FROM strange), {HYBRID}
  UNION ALL SELECT user_id, item_id, round({GRAND_AVERAGE}::DOUBLE, 6) FROM test WHERE user_id NOT IN (SELECT user_id FROM train) OR item_id NOT IN (SELECT item_id FROM train)""",
    "cold_start_or": f"WITH {TRAIN}, {STRANGE} SELECT user_id, item_id, round({GRAND_AVERAGE}::DOUBLE, 6) AS stars FROM strange WHERE user_id NOT IN (SELECT user_id FROM train) OR item_id NOT IN (SELECT item_id FROM train)",
    "cold_start_and": f"WITH {TRAIN}, {STRANGE} SELECT user_id, item_id, round({GRAND_AVERAGE}::DOUBLE, 6) AS stars FROM strange WHERE user_id NOT IN (SELECT user_id FROM train) AND item_id NOT IN (SELECT item_id FROM train)",
    "rmse": f"WITH {TRAIN}, {BY_ITEMS} SELECT count(*) AS n, round(sqrt(avg((f.stars - t.stars) * (f.stars - t.stars))), 6) AS rmse FROM found f JOIN truth t USING (user_id, item_id)",
    "basket_build": f"WITH {BASKETS} SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM baskets GROUP BY 1",
    "basket_build_by_item": f"WITH {BASKETS} SELECT item, count(*) AS n, string_agg(CAST(basket AS VARCHAR), ',' ORDER BY basket) AS baskets FROM baskets GROUP BY 1",
    "frequent_itemsets_by_item": f"""WITH RECURSIVE {INTERACTIONS}, customers AS (SELECT item_id AS basket, CAST(user_id AS VARCHAR) AS item FROM interactions), bar AS (SELECT {EDGE} AS s),
  {levels('customers')} SELECT items, CAST(size AS BIGINT) AS size, freq FROM sets""",
    "basket_size_filter": f"WITH {BASKETS} SELECT * FROM baskets WHERE basket IN (SELECT basket FROM baskets GROUP BY 1 HAVING count(*) > {SMALL_BASKET})",
    "frequent_itemsets": SETS,
    "frequent_itemsets_fpgrowth": SETS,
    "frequent_itemsets_son": SETS,
    "son_candidates": SON,
    "frequent_pairs_pcy": SETS + " WHERE size = 2",
    "itemset_overlap": f"""WITH RECURSIVE {BASKETS}, large AS (SELECT * FROM baskets WHERE basket IN (SELECT basket FROM baskets GROUP BY 1 HAVING count(*) > {SMALL_BASKET})),
  {levels('baskets')}, {levels('large', 'lsets')}
  SELECT 'first' AS name, count(*) AS n FROM lsets UNION ALL SELECT 'second', count(*) FROM sets UNION ALL SELECT 'both', count(*) FROM sets JOIN lsets USING (items)""",
    "minhash_signatures": f"WITH {INTERACTIONS}, {signatures()} SELECT id AS item_id, band, value FROM bands",
    "lsh_candidate_pairs": f"WITH {INTERACTIONS}, {signatures()} SELECT a, b FROM candidates",
    "lsh_jaccard_pairs": f"WITH {INTERACTIONS}, {signatures()}, {jaccard()} SELECT a, b, round(sim, 6) AS sim FROM jac JOIN candidates USING (a, b) WHERE sim >= 0.05",
    "exact_jaccard_pairs": f"WITH {INTERACTIONS}, {jaccard()} SELECT a, b, round(sim, 6) AS sim FROM jac WHERE sim >= 0.05",
    "tf": f"WITH {WORDS} SELECT key, word, n, round(tf, 6) AS tf FROM tf",
    "idf": f"WITH {WORDS} SELECT word, df, round(idf, 6) AS idf FROM idf",
    "tfidf_top200": f"WITH {WORDS} SELECT key, word, round(score, 6) AS score FROM items",
    "user_profile": f"WITH {WORDS} SELECT user_id, word FROM users",
    "content_predict": f"""WITH {WORDS}, nu AS (SELECT user_id, count(*) AS nu FROM users GROUP BY 1), ni AS (SELECT key AS item_id, count(*) AS ni FROM items GROUP BY 1),
  common AS (SELECT t.user_id, t.item_id, count(*) AS c FROM (SELECT DISTINCT user_id, item_id FROM reviews) t JOIN users u ON u.user_id = t.user_id
    JOIN items i ON i.key = t.item_id AND i.word = u.word GROUP BY 1, 2)
  SELECT user_id, item_id, round(c / (sqrt(nu::DOUBLE) * sqrt(ni::DOUBLE)), 6) AS sim FROM common JOIN nu USING (user_id) JOIN ni USING (item_id) WHERE c / (sqrt(nu::DOUBLE) * sqrt(ni::DOUBLE)) > 0.01""",
    "graph_edges": f"WITH {EDGES} SELECT a, b FROM edges",
    "graph_vertices": f"WITH {EDGES} SELECT v FROM vertices",
    "graph_degree": f"WITH {EDGES} SELECT src AS v, count(*) AS degree FROM two GROUP BY 1",
    "connected_components": f"WITH RECURSIVE {EDGES}, {REACH} SELECT v, component FROM comps",
    "modularity": f"""WITH RECURSIVE {EDGES}, {REACH}, m AS (SELECT count(*)::DOUBLE AS m FROM edges), d AS (SELECT component, count(*) AS d FROM two JOIN comps ON v = src GROUP BY 1),
  l AS (SELECT x.component, count(*) AS l FROM edges JOIN comps x ON x.v = a JOIN comps y ON y.v = b WHERE x.component = y.component GROUP BY 1)
  SELECT round(coalesce(sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m))), 0.0), 6) AS q FROM d LEFT JOIN l USING (component), m""",
    "label_propagation": f"WITH {EDGES}, l0 AS (SELECT v, v AS label FROM vertices), {LABELS} SELECT v, label FROM l5",
    "edge_betweenness": BETWEEN,
    "cluster_stats": f"WITH {POINTS} SELECT CAST(cluster AS BIGINT) AS cluster, dim, n, round(sum, 6) AS sum, round(sumsq, 6) AS sumsq, round(std, 6) AS std FROM stats",
    "nearest_centroid": f"WITH {POINTS}, {NEAREST} SELECT point_id, CAST(cluster AS BIGINT) AS cluster, round(d, 6) AS distance FROM best",
    "mahalanobis_assign": f"""WITH {POINTS}, far AS (SELECT p.point_id, s.cluster, sqrt(sum(pow((p.x - s.sum / s.n) / greatest(s.std, 1e-6), 2))) AS d, count(*) AS dims
    FROM dims p JOIN stats s ON s.dim = p.dim GROUP BY 1, 2), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, cluster) AS r FROM far) WHERE r = 1)
  SELECT point_id, CAST(CASE WHEN d <= 2 * sqrt(dims) THEN cluster ELSE -1 END AS BIGINT) AS cluster, round(d, 6) AS distance FROM best""",
    "nmi": f"""WITH {POINTS}, {NEAREST}, n AS (SELECT count(*)::DOUBLE AS n FROM best), xy AS (SELECT cluster AS x, label AS y, count(*) AS c FROM best GROUP BY 1, 2),
  hx AS (SELECT x, sum(c) AS cx FROM xy GROUP BY 1), hy AS (SELECT y, sum(c) AS cy FROM xy GROUP BY 1),
  i AS (SELECT sum(c / n * ln(c * n / (cx * cy))) AS i FROM xy JOIN hx USING (x) JOIN hy USING (y), n), ex AS (SELECT -sum(cx / n * ln(cx / n)) AS ex FROM hx, n), ey AS (SELECT -sum(cy / n * ln(cy / n)) AS ey FROM hy, n)
  SELECT round(CASE WHEN sqrt(ex * ey) < 1e-12 THEN 0.0 ELSE i / sqrt(ex * ey) END, 6) AS nmi FROM i, ex, ey""",
    "bloom_build": f"WITH {BLOOM} SELECT position FROM bloom",
    "bloom_probe": f"""WITH {BLOOM}, asked AS (SELECT n_name AS name FROM nation UNION ALL SELECT c_name FROM customer), xs AS (SELECT name, {FOLD.format(t="name", m=BLOOM_BITS)} AS x FROM asked),
  bits AS (SELECT list(position) AS bits FROM bloom) SELECT name, CAST(CASE WHEN name IS NULL OR name = '' THEN 0 WHEN list_has_all(bits, [{_bits}]) THEN 1 ELSE 0 END AS BIGINT) AS hit FROM xs, bits""",
    "fm_estimate": f"WITH vals AS (SELECT DISTINCT c_name AS v FROM customer WHERE c_name <> ''), {fm()}",
    "sliding_window_distinct": f"WITH {WINDOWS} SELECT window_start, count(DISTINCT user_id) AS truth FROM spread GROUP BY 1",
    "sliding_window_fm": f"WITH {WINDOWS}, vals AS (SELECT DISTINCT window_start, CAST(user_id AS VARCHAR) AS v FROM spread WHERE user_id IS NOT NULL), {fm('window_start')}",
    "reservoir_sample": "SELECT event_id, user_id, event_type FROM events ORDER BY (event_id * 48271 + 11) % 2147483647, event_id LIMIT 100",
    "trending_top3": TRENDING,
    "stream_reservoir": "SELECT event_id, user_id, event_type FROM events ORDER BY (event_id * 48271 + 11) % 2147483647, event_id LIMIT 100",
    "stream_bloom": f"""WITH names AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS v FROM customer WHERE c_mktsegment = 'BUILDING'), hashed AS (SELECT {FOLD.format(t="v", m=BLOOM_BITS)} AS x FROM names),
  bloom AS (SELECT DISTINCT CAST(unnest([{_bits}]) AS BIGINT) AS position FROM hashed), bits AS (SELECT list(position) AS bits FROM bloom),
  xs AS (SELECT event_id, user, {FOLD.format(t="user", m=BLOOM_BITS)} AS x FROM (SELECT event_id, coalesce(CAST(user_id AS VARCHAR), '') AS user FROM events))
  SELECT event_id, CAST(CASE WHEN user = '' THEN 0 WHEN list_has_all(bits, [{_bits}]) THEN 1 ELSE 0 END AS BIGINT) AS hit FROM xs, bits""",
    "stream_fm": f"WITH {WINDOWS}, vals AS (SELECT DISTINCT window_start, CAST(user_id AS VARCHAR) AS v FROM spread WHERE user_id IS NOT NULL), {fm('window_start')}",
    "stream_trending": TRENDING,
}
