"""DuckDB SQL for those queries of this subpackage that SQL can express, to check their results on small tables."""

from __future__ import annotations

from quarry.llm import decontam, jaccard, sharding, substring, url_filters

UPPER, LOWER = url_filters.UPPER, url_filters.LOWER


def _words(table: str, key: str, pattern: str, fold: bool) -> str:
    """Rows (key, w): the list of words of each row."""
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')" if fold else "coalesce(text, '')"
    return f"SELECT {key}, regexp_extract_all({text}, '{pattern}') AS w FROM {table}"


ASCII_WORD, BLANK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

_n = decontam.WIDTH
DECONTAMINATION = f"""WITH b AS ({_words("benchmark", "item_id", ASCII_WORD, True)}), d AS ({_words("documents", "doc_id", ASCII_WORD, True)}),
  starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - {_n} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0),
  phrases AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, w[i : i + {_n} - 1] AS p FROM starts),
  places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT len(p) AS n FROM phrases) WHERE len(w) >= n),
  found AS (SELECT doc_id, i, n, item FROM places JOIN phrases ON w[i : i + n - 1] = p),
  hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY 1),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

_k = substring.WINDOW
SUBSTRINGS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, w FROM ({_words("documents", "doc_id", BLANK_WORD, False)})),
  windows AS (SELECT r, doc_id, i, array_to_string(w[i : i + {_k} - 1], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {_k} + 2)) AS i FROM d WHERE len(w) >= {_k})),
  first AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY 1),
  gone AS (SELECT DISTINCT r, unnest(range(i, i + {_k})) AS k FROM windows JOIN first USING (s) WHERE m < doc_id),
  counts AS (SELECT r, count(*) AS n FROM gone GROUP BY 1),
  split AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
  kept AS (SELECT r, string_agg(x, ' ' ORDER BY k) AS s FROM split ANTI JOIN gone USING (r, k) GROUP BY 1)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)"""

#: The base columns of the quality rules; the verdict hangs on hashes that DuckDB does not have, so tests use this alone.
QUALITY_BASE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS w FROM documents),
  windows AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
  twice AS (SELECT r, i FROM windows JOIN (SELECT r, s FROM windows GROUP BY 1, 2 HAVING count(*) > 1) USING (r, s)),
  hit AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY 1),
  lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{BLANK_WORD}')) AS l FROM d)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
  FROM d JOIN lines USING (r) LEFT JOIN hit USING (r)"""

_w = jaccard.SHINGLE
NEAR_COPIES = f"""WITH RECURSIVE d AS ({_words("documents", "doc_id", BLANK_WORD, True)}),
  shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {_w} - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {_w} + 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
  common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {jaccard.PERCENT} * (p.n + q.n - c)),
  reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id),
  least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN sizes USING (doc_id)"""


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by the reflected polynomial."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ 0xEDB88320 * (b & 1)
        out.append(b)
    return out


_p, _s = sharding.PRIME, sharding.SLOTS
_h = f"((coalesce(doc_id, -1) % {_p}) + {_p}) % {_p}"
for _f in sharding.FACTORS:
    _h = f"(((({_h}) + 1) * {_f}) % {_p})"
    _h = f"(xor({_h}, {_h} >> 13) % {_p})"
_byte = "CAST(('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT)"
SHARDS = f"""WITH t AS (SELECT [{", ".join(map(str, _crc_table()))}]::BIGINT[] AS t, {sharding.slot_map(16)}::BIGINT[] AS o, {sharding.slot_map(17)}::BIGINT[] AS g),
  d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, {_h} % {_s} AS slot FROM documents),
  c AS (SELECT doc_id, size, slot, o[slot + 1] AS shard, g[slot + 1] AS grown_shard, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(0, size - 1), lambda i: {_byte})), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32 FROM d, t)
  SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY slot, doc_id, text_crc32, size) - 1 AS slot,
    CAST(grown_shard AS INTEGER) AS grown_shard, CAST(slot AS INTEGER) AS virtual_slot FROM c"""


def _fits(rule: str) -> str:
    name, _, start = rule.partition("/")
    return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(CASE WHEN path = '' THEN '/' ELSE path END, '/{start}')"


_longest = sorted(url_filters.RULES, key=lambda r: (-len(r[1]), r[1]))
URLS = f"""WITH RECURSIVE rest AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS r FROM pages),
  parts AS (SELECT page_id, translate(regexp_extract(r, '(?s)^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rest),
  ruled AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _longest)} END AS rule, CASE {" ".join(f"WHEN {_fits(r)} THEN '{v}'" for v, r in _longest)} END AS said,
    list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
      list_transform(list_filter(regexp_split_to_array(path, '[^0-9A-Za-z]+'), lambda x: x <> ''), lambda x: 'p:' || x))) AS tokens FROM parts),
  known AS (SELECT row_number() OVER () AS id, tokens, said FROM ruled WHERE said IS NOT NULL), total AS (SELECT count(*) AS n, CAST(ceil(0.01::DOUBLE * count(*)) AS BIGINT) AS least FROM known),
  sets AS (SELECT id, said, tokens, [] :: VARCHAR[] AS s, '' AS last FROM known UNION ALL SELECT id, said, tokens, list_append(s, t), t FROM (SELECT *, unnest(tokens) AS t FROM sets) WHERE t > last),
  counts AS (SELECT s, said, count(*) AS c, sum(count(*)) OVER (PARTITION BY s) AS whole FROM sets WHERE len(s) > 0 GROUP BY 1, 2),
  rules AS (SELECT s, said, c / whole AS confidence, c / n AS support FROM counts, total WHERE c >= least AND c / whole >= 0.9::DOUBLE),
  fired AS (SELECT page_id, said AS mined, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, support DESC, (said = 'block') DESC) AS k
    FROM (SELECT page_id, tokens FROM ruled WHERE said IS NULL) q JOIN rules ON list_has_all(tokens, s))
  SELECT page_id, host, path, rule, coalesce(r.said, mined, 'allow') AS verdict, CASE WHEN r.said IS NOT NULL THEN 'rule' WHEN mined IS NOT NULL THEN 'mined' ELSE 'default' END AS by
  FROM ruled r LEFT JOIN (SELECT * FROM fired WHERE k = 1) f USING (page_id)"""

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": DECONTAMINATION,
    "op4_substring_dedup": SUBSTRINGS,
    "op5_ngram_jaccard": NEAR_COPIES,
    "op7_sharding": SHARDS,
    "op8_url_filters": URLS,
}
