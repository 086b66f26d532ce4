"""The same results as plain SQL over the test tables, for checking (DuckDB dialect)."""

from __future__ import annotations

from siftwatch.plans import fixtures as fx
from siftwatch.sources import keywords as kw

T = 0.85
KEYWORD_LIST = ", ".join(f"'{k}'" for k in fx.KEYWORDS)

THREATS = """
threats AS (
  SELECT d.doc_id AS row_id, CAST(d.doc_id AS VARCHAR) AS id, substr(d.text, 1, 60) AS name, d.text AS description,
         concat_ws(', ', d.lang, d.source, CASE WHEN l.toxic = 1 THEN 'toxic' END,
                   CASE WHEN l.quality = 0 THEN 'junk' END) AS tags,
         strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS created_date, e.ts AS created_ts, d.source, d.lang, d.n_chars, e.value,
         l.quality, l.toxic
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

INCIDENTS = """
incidents AS (
  SELECT CAST(item_id AS INTEGER) AS idx, 'INC-' || item_id AS id, substr(text, 1, 30) AS name, text AS description
  FROM benchmark)"""


def found(keywords: str, text: str = "description") -> str:
    return f"list_filter([{keywords}], lambda k: contains(lower({text}), k))"


def points(n: str) -> str:
    return f"least(CAST({n} AS DOUBLE) * CAST(0.15 AS DOUBLE), CAST(1 AS DOUBLE))"


def weighted(ws: str, wk: str, wn: str) -> str:
    return (
        f"CAST({ws} AS DOUBLE) * similarity_score + CAST({wk} AS DOUBLE) * keyword_score "
        f"+ CAST({wn} AS DOUBLE) * novelty_score"
    )


DEFAULT = weighted("0.33", "0.33", "0.34")
NEW = weighted("0.5", "0.4", "0.1")

SCORED = f"""{THREATS},
parts AS (
  SELECT row_id, id, name, description, tags, created_date, created_ts, source, coalesce(toxic = 1, false) AS is_toxic,
         CAST(n_chars * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS similarity_score,
         least(value / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) AS novelty_score,
         CAST(n_chars % 45 AS INTEGER) AS most_similar_idx, {found(KEYWORD_LIST)} AS found,
         CAST(substr(source, 4) AS INTEGER) AS cluster
  FROM threats),
kwd AS (
  SELECT *, array_to_string(found, ', ') AS matched_keywords, CAST(len(found) AS INTEGER) AS num_keywords_matched,
         {points("len(found)")} AS keyword_score FROM parts),
rated AS (SELECT *, {NEW} AS risk_score FROM kwd),
scored AS (
  SELECT *, CASE WHEN risk_score > 0.6::DOUBLE THEN 'High' WHEN risk_score > 0.4::DOUBLE THEN 'Medium' ELSE 'Low' END
              AS risk_category,
         similarity_score > 0.55::DOUBLE OR num_keywords_matched >= 3 AS is_critical FROM rated)"""

PULSES = """
raw AS (
  SELECT doc_id, doc_id // 50 AS page, doc_id % 50 AS pos, CAST(doc_id AS VARCHAR) AS id, text,
         '  ' || substr(text, 1, 40) || chr(32) || chr(10) AS name0, source, lang,
         [upper(lang[1]) || lower(lang[2:]), source, CASE WHEN n_chars % 3 = 0 THEN 'Supply' ELSE 'Exploit kit' END,
          'CHAIN'] AS tags,
         CASE WHEN doc_id % 2 = 0 THEN source END AS username FROM documents),
pulses AS (
  SELECT page, pos, id, regexp_replace(regexp_replace(name0, '^\\s+', ''), '\\s+$', '') AS name,
         regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS description,
         lower(array_to_string(tags, ', ')) AS tags, lower(array_to_string(tags, ' ')) AS tag_text,
         '2024-01-01' AS created_date, source || ', ' || lang AS refs, coalesce(username, 'Unknown') AS author,
         username, text, array_to_string(tags, '|') AS raw_tags, length(text) AS n_chars
  FROM raw)"""
RELEVANT = " OR ".join(
    f"contains(tag_text, '{t}')"
    for t in (
        "malware", "ransomware", "phishing", "apt", "trojan", "backdoor", "exploit", "vulnerability", "botnet",
        "supply chain", "zero-day", "threat actor",
    )
)
KEPT = f"(length(description) >= 100 AND ({RELEVANT}) AND name <> '')"


def tfidf(width: int | None) -> str:
    """Unit TF-IDF cells ``unit(id, b, w)`` of the documents and ``ref(idx, b, w)`` of the incidents; ``b`` is the
    token's md5 bucket, or with no width the token itself."""
    bucket = f"('0x' || substr(md5(t), 1, 8))::BIGINT % {width}" if width else "t"

    def cells(table: str, key: str) -> str:
        return f"""SELECT {key} AS id, {bucket} AS b, count(*) AS n
  FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS t FROM {table})
  WHERE t <> '' GROUP BY ALL"""

    return f"""
tf AS ({cells("documents", "doc_id")}),
idf AS (SELECT b, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)::DOUBLE) AS i FROM tf GROUP BY b),
unit AS (
  SELECT id, b, w / (sqrt(sum(w * w) OVER (PARTITION BY id)) + 1e-8::DOUBLE) AS w
  FROM (SELECT id, b, n * i AS w FROM tf JOIN idf USING (b))),
rtf AS ({cells("benchmark", "item_id")}),
ref AS (
  SELECT id AS idx, b, w / (sqrt(sum(w * w) OVER (PARTITION BY id)) + 1e-8::DOUBLE) AS w
  FROM (SELECT id, b, n * coalesce(i, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE)) AS w
        FROM rtf LEFT JOIN idf USING (b)))"""


TEXT_PAIRS = f"""{tfidf(None)},
pairs AS MATERIALIZED (
  SELECT x.id AS i, y.id AS j, sum(x.w * y.w) AS sim FROM unit x JOIN unit y ON x.b = y.b AND x.id < y.id
  GROUP BY ALL HAVING sum(x.w * y.w) >= {T}::DOUBLE)"""

VEC = """
v AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS e, label AS cluster FROM embeddings),
u AS (
  SELECT row_id, cluster, e, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-8::DOUBLE)) AS unit
  FROM v)"""
VEC_PAIRS = f"""{VEC},
pairs AS MATERIALIZED (
  SELECT x.row_id AS i, y.row_id AS j, list_dot_product(x.unit, y.unit) AS sim
  FROM u x JOIN u y ON x.row_id < y.row_id
  WHERE list_dot_product(x.unit, y.unit) >= {fx.VECTOR_THRESHOLD}::DOUBLE)"""


def greedy(rows: str) -> str:
    """First-wins in row order as a fold: ``survivors(row_id)``. Only rows with a smaller match need a step."""
    return f"""
near AS MATERIALIZED (SELECT j, list(i) AS nb FROM pairs GROUP BY j),
steps AS MATERIALIZED (SELECT row_number() OVER (ORDER BY j) AS k, j, nb FROM near),
fold AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS gone
  UNION ALL
  SELECT s.k, CASE WHEN len(list_filter(s.nb, lambda x: NOT list_contains(f.gone, x))) > 0
                   THEN list_append(f.gone, s.j) ELSE f.gone END
  FROM fold f JOIN steps s ON s.k = f.k + 1),
removed AS MATERIALIZED (SELECT unnest(gone) AS row_id FROM (SELECT gone FROM fold ORDER BY k DESC LIMIT 1)),
survivors AS (SELECT row_id FROM ({rows}) r WHERE row_id NOT IN (SELECT row_id FROM removed))"""


REPORT = f"""{TEXT_PAIRS}, {greedy("SELECT doc_id AS row_id FROM documents")},
report AS (
  SELECT p.i AS original_idx, p.j AS duplicate_idx, round(p.sim, 6) AS similarity,
         substr(a.text, 1, 50) AS original_name, substr(b.text, 1, 50) AS duplicate_name
  FROM pairs p JOIN survivors s ON s.row_id = p.i JOIN documents a ON a.doc_id = p.i JOIN documents b ON b.doc_id = p.j)"""


def centers(vec: str = "v", dim: int = 64) -> str:
    return f"""
cell AS (SELECT cluster, generate_subscripts(e, 1) AS p, unnest(e) AS x FROM {vec}),
mean AS (SELECT cluster, p, avg(x) AS x FROM cell GROUP BY ALL),
center AS (SELECT cluster, list(x ORDER BY p) AS c FROM mean GROUP BY cluster),
dist AS (
  SELECT v.row_id, v.cluster, sqrt(list_sum(list_transform(list_zip(v.e, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))
         AS distance
  FROM {vec} v JOIN center c USING (cluster)),
spread AS (SELECT cluster, stddev_pop(distance) AS s, count(*) AS n FROM dist GROUP BY cluster)"""


NOVELTY_Z = "CASE WHEN s < 1e-6::DOUBLE THEN 0::DOUBLE ELSE (distance - 2 * s) / (2 * s) END"


def checksum(v: str) -> str:
    return f"""round(list_sum({v}), 6) AS total, round(list_dot_product({v}, {v}), 6) AS square,
  round(list_sum(list_transform({v}, lambda x, i: x * i)), 6) AS weighted"""


def recall(method: str, sample: str) -> str:
    return f"""SELECT '{method}' AS method, coalesce(sum(hit), 0)::BIGINT AS n_found, (SELECT t FROM tot) AS total_critical,
  coalesce(sum(hit), 0)::DOUBLE / nullif((SELECT t FROM tot), 0) AS recall FROM ({sample})"""


LABELLED = f"""{SCORED},
lab AS (SELECT *, CAST(is_toxic AS BIGINT) AS hit FROM scored),
tot AS (SELECT sum(hit)::BIGINT AS t FROM lab),
base AS (
  {recall("random", "SELECT hit FROM lab ORDER BY md5('42' || id), id LIMIT 50")}
  UNION ALL {recall("recency", "SELECT hit FROM lab ORDER BY created_date DESC, row_id LIMIT 50")}
  UNION ALL {recall("ranked", "SELECT hit FROM lab ORDER BY risk_score DESC, row_id LIMIT 50")})"""

TAGS = """
tag0 AS (SELECT cluster, row_id, unnest(string_split(tags, ',')) AS tag, generate_subscripts(string_split(tags, ','), 1) AS pos
         FROM scored),
tagc AS (SELECT cluster, {tag} AS tag, count(*) AS n_rows, min(row_id * 100 + pos) AS first_seen FROM tag0 GROUP BY ALL),
tagr AS (SELECT cluster, tag, n_rows, CAST(row_number() OVER (PARTITION BY cluster ORDER BY n_rows DESC, first_seen) AS INTEGER)
           AS rank FROM tagc QUALIFY rank <= 5),
namr AS (SELECT cluster, substr(name, 1, 40) || '...' AS sample,
           CAST(row_number() OVER (PARTITION BY cluster ORDER BY row_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 3),
tagj AS (SELECT cluster, string_agg(tag, ', ' ORDER BY rank) AS top_tags FROM tagr GROUP BY cluster),
namj AS (SELECT cluster, string_agg(sample, ' | ' ORDER BY rank) AS sample_threats FROM namr GROUP BY cluster)"""

PROFILE = f"""{SCORED}, {TAGS.format(tag="trim(tag)")},
prof AS (
  SELECT CAST(k.range AS INTEGER) AS cluster_id, coalesce(c.n, 0) AS size,
         round(coalesce(c.n, 0)::DOUBLE / (SELECT count(*) FROM scored) * 100, 6) AS percentage,
         coalesce(top_tags, 'N/A') AS top_tags, coalesce(sample_threats, '') AS sample_threats,
         round(coalesce(c.s, 0), 6) AS std_dev
  FROM range({fx.N_CLUSTERS}) k
  LEFT JOIN (SELECT cluster, count(*) AS n, stddev_pop(novelty_score) AS s FROM scored GROUP BY cluster) c ON c.cluster = k.range
  LEFT JOIN tagj t ON t.cluster = k.range LEFT JOIN namj m ON m.cluster = k.range)"""

SIZES = f"""
sizes AS (SELECT k.range AS cluster_id, count(s.row_id) AS size FROM range({fx.N_CLUSTERS}) k
          LEFT JOIN scored s ON s.cluster = k.range GROUP BY k.range)"""


def dim_values(lists) -> str:
    flat = [(c, w) for c, words in lists.items() for w in words]
    return ", ".join(f"({i}, '{c}', '{w}', '{kw.SEVERITY[c]}')" for i, (c, w) in enumerate(flat))


SCORE4 = ", ".join(f"round({c}, 6) AS {c}" for c in ("risk_score", "similarity_score", "keyword_score", "novelty_score"))

NEAREST = f"""{THREATS}, {tfidf(384)},
un AS (SELECT id, sqrt(sum(w * w)) + 1e-8::DOUBLE AS n FROM unit GROUP BY id),
rn AS (SELECT idx, sqrt(sum(w * w)) + 1e-8::DOUBLE AS n FROM ref GROUP BY idx),
sims AS (
  SELECT d.doc_id AS row_id, r.item_id AS idx, coalesce(s.sim / (un.n * rn.n), 0) AS sim
  FROM documents d CROSS JOIN benchmark r LEFT JOIN un ON un.id = d.doc_id LEFT JOIN rn ON rn.idx = r.item_id
  LEFT JOIN (SELECT u.id, f.idx, sum(u.w * f.w) AS sim FROM unit u JOIN ref f USING (b) GROUP BY ALL) s
    ON s.id = d.doc_id AND s.idx = r.item_id),
best AS (
  SELECT row_id, sim AS similarity_score, CAST(idx AS INTEGER) AS most_similar_idx FROM sims
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(sim, 12) DESC, idx) = 1)"""

DENSE = """
v AS (
  SELECT d.doc_id AS row_id, list(coalesce(u.w, 0::DOUBLE) ORDER BY k.range) AS e, CAST(substr(d.source, 4) AS INTEGER) AS cluster
  FROM documents d CROSS JOIN range(384) k LEFT JOIN unit u ON u.id = d.doc_id AND u.b = k.range GROUP BY ALL)"""

FULL_SCORE = f"""{NEAREST}, {DENSE}, {centers("v")},
nov AS (SELECT row_id, cluster, {NOVELTY_Z} AS z FROM dist JOIN spread USING (cluster)),
kwd AS (SELECT row_id, {found(KEYWORD_LIST)} AS found FROM threats),
comp AS (
  SELECT row_id, similarity_score, most_similar_idx, least(greatest(z, 0), 1)::DOUBLE AS novelty_score, cluster,
         array_to_string(found, ', ') AS matched_keywords, CAST(len(found) AS INTEGER) AS num_keywords_matched,
         {points("len(found)")} AS keyword_score
  FROM best JOIN nov USING (row_id) JOIN kwd USING (row_id))"""

ORACLE: dict[str, str] = {
    "scan_threats": f"WITH {THREATS} SELECT row_id, id, name, description, tags, created_date FROM threats",
    "scan_scored": f"""WITH {SCORED} SELECT row_id, id, name, created_date, description, tags, matched_keywords, {SCORE4}, num_keywords_matched, cluster,
  risk_category, strptime(created_date, '%Y-%m-%d %H:%M:%S') AS created_ts FROM scored""",
    "scan_cluster_stats": f"""WITH {PROFILE} SELECT cluster_id, size, percentage, nullif(top_tags, 'N/A') AS top_tags,
  nullif(sample_threats, '') AS sample_threats, std_dev FROM prof""",
    "flatten_pulse_pages": f"""WITH {PULSES} SELECT page, pos, id, text AS description, raw_tags AS tags, username
  FROM pulses""",
    "normalise_pulses": f"""WITH {PULSES} SELECT id, name, description, tags, tag_text, created_date,
  refs AS "references", 'feed' AS source, author FROM pulses""",
    "quality_filter": f"""WITH {PULSES} SELECT id, name, description, tags, created_date, refs AS "references", 'feed' AS source, author
  FROM pulses WHERE {KEPT}""",
    "collection_summary": f"""WITH {PULSES} SELECT count(*) AS raw, count(*) FILTER ({KEPT}) AS kept,
  round((1 - count(*) FILTER ({KEPT})::DOUBLE / count(*)) * 100, 6) AS filter_rate,
  min(created_date) FILTER ({KEPT}) AS min_created, max(created_date) FILTER ({KEPT}) AS max_created FROM pulses""",
    "incidents": f"WITH {INCIDENTS} SELECT * FROM incidents",
    "incident_lookup": f"WITH {INCIDENTS} SELECT * FROM incidents WHERE id = 'INC-7'",
    "incident_texts": f"WITH {INCIDENTS} SELECT idx, description FROM incidents",
    "incident_text_length": f"""WITH {INCIDENTS} SELECT count(*) AS n_incidents,
  round(avg(length(description)), 6) AS mean_description_length FROM incidents""",
    "keyword_dim": f"""WITH dim(pos, category, keyword, severity) AS (VALUES {dim_values(kw.LISTS)}),
hits AS (SELECT k.keyword, count(*) AS n FROM (SELECT DISTINCT keyword FROM dim) k
         JOIN documents d ON contains(lower(d.text), k.keyword) GROUP BY 1)
SELECT pos, category, keyword, severity, coalesce(n, 0) AS n_rows FROM dim LEFT JOIN hits USING (keyword)""",
    "keyword_list_counts": f"""WITH dim(pos, category, keyword, severity) AS (VALUES {dim_values(fx.LISTS)})
SELECT category, count(*) AS n_keywords,
  count(*) FILTER (EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), keyword))) AS n_found
FROM dim GROUP BY category""",
    "keyword_severity": f"""WITH {THREATS}, dim(pos, category, keyword, severity) AS (VALUES {dim_values(fx.LISTS)}),
best AS (SELECT keyword, arg_min(severity, pos) AS severity FROM dim GROUP BY keyword),
words AS (SELECT word, count(*) AS n_rows FROM
  (SELECT unnest(regexp_split_to_array(description, '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM threats)
  WHERE word <> '' GROUP BY word)
SELECT word, n_rows, coalesce(severity, 'low') AS severity FROM words LEFT JOIN best ON lower(word) = keyword""",
    "run_metrics": f"""WITH RECURSIVE {SCORED}, {TEXT_PAIRS}, {greedy("SELECT doc_id AS row_id FROM documents")}, {SIZES},
m AS (
  SELECT (SELECT count(*) FROM scored)::DOUBLE AS raw_threat_count, (SELECT count(*) FROM removed)::DOUBLE AS duplicates_removed,
    (SELECT count(*) FROM sizes WHERE size > 0)::DOUBLE AS num_clusters, 0::DOUBLE AS noise_points,
    (SELECT avg(size) FROM sizes)::DOUBLE AS avg_cluster_size, (SELECT max(size) FROM sizes)::DOUBLE AS max_cluster_size,
    (SELECT min(size) FROM sizes)::DOUBLE AS min_cluster_size, avg(risk_score) AS mean_risk_score,
    median(risk_score) AS median_risk_score, stddev_samp(risk_score) AS std_risk_score, min(risk_score) AS min_risk_score,
    max(risk_score) AS max_risk_score, count(*) FILTER (risk_category = 'High')::DOUBLE AS high_risk_threats,
    count(*) FILTER (risk_category = 'Medium')::DOUBLE AS medium_risk_threats,
    count(*) FILTER (risk_category = 'Low')::DOUBLE AS low_risk_threats FROM scored),
n AS (SELECT *, raw_threat_count - duplicates_removed AS deduplicated_threat_count,
        duplicates_removed / raw_threat_count * 100 AS deduplication_rate_percent FROM m)
SELECT 'run' AS run_id, key, round(value, 6) AS value FROM (UNPIVOT n ON COLUMNS(*) INTO NAME key VALUE value)""",
    "risk_band": f"WITH {SCORED} SELECT row_id, risk_category FROM scored",
    "critical_flag": f"WITH {SCORED} SELECT row_id, is_critical FROM scored",
    "parse_dates": """SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts)::TIMESTAMP END AS created_ts
  FROM events""",
    "facet_filter": f"""WITH {SCORED} SELECT row_id, risk_category, cluster FROM scored
  WHERE risk_category IN ('High', 'Medium') AND cluster IN (0, 1, 2, 3, 5, 8, 13)""",
    "date_range_filter": """SELECT event_id, ts FROM events
  WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-11 00:00:00'""",
    "text_search": f"""WITH {SCORED} SELECT row_id, name, tags FROM scored
  WHERE regexp_matches(name || chr(10) || description || chr(10) || tags, 'apache|nicht +für|license', 'i')""",
    "drill_down": f"""WITH {SCORED}, {INCIDENTS}
SELECT row_id, risk_category, substr(s.name, 1, 80) || '...' AS title,
  CASE WHEN length(s.description) > 500 THEN substr(s.description, 1, 500) || '...' ELSE s.description END AS description,
  substr(tags, 1, 100) AS tags, matched_keywords, {SCORE4}, cluster,
  coalesce(strftime(created_ts, '%Y-%m-%d'), 'N/A') AS date, source, i.name AS incident_name
FROM scored s LEFT JOIN incidents i ON i.idx = s.most_similar_idx""",
    "incident_enrich": f"""WITH {SCORED}, {INCIDENTS} SELECT row_id, most_similar_idx, i.name AS incident_name
  FROM scored s LEFT JOIN incidents i ON i.idx = s.most_similar_idx""",
    "embed_text": f"WITH {tfidf(384)}, {DENSE} SELECT row_id, {checksum('e')} FROM v",
    "embed_encoder": f"""WITH {THREATS}, v AS (SELECT row_id, [{", ".join(
        f"(length(description) - length(replace(description, '{c}', '')))::DOUBLE" for c in "aeiou")}] AS e FROM threats)
SELECT row_id, {checksum('e')} FROM v""",
    "blank_zero_vector": f"""WITH {VEC}, z AS (
  SELECT row_id, list_transform(e, lambda x: CASE WHEN quality IS NULL THEN 0::DOUBLE ELSE x END) AS e
  FROM v LEFT JOIN labels ON doc_id = row_id)
SELECT row_id, {checksum('e')} FROM z""",
    "l2_normalise": f"""WITH {VEC}, s AS (SELECT row_id, list_transform(e, lambda x: x * (cluster + 2)) AS e FROM v),
n AS (SELECT row_id, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-8::DOUBLE)) AS e FROM s)
SELECT row_id, {checksum('e')} FROM n""",
    "cosine_pair": f"""WITH {VEC} SELECT a.row_id, round(list_dot_product(a.unit, b.unit), 6) AS sim
  FROM u a JOIN u b ON b.row_id = a.row_id + 1""",
    "similarity_pairs": f"""WITH {VEC}, pairs AS MATERIALIZED (
  SELECT x.row_id AS i, y.row_id AS j, list_dot_product(x.unit, y.unit) AS sim FROM u x JOIN u y ON x.row_id < y.row_id)
SELECT i, j, round(sim, 6) AS sim FROM (
  SELECT i, j, sim FROM pairs UNION ALL SELECT j, i, sim FROM pairs
  UNION ALL SELECT row_id, row_id, list_dot_product(unit, unit) FROM u)""",
    "near_dup_pairs": f"WITH {VEC_PAIRS} SELECT i, j, round(sim, 6) AS sim FROM pairs",
    "text_near_dup_pairs": f"WITH {TEXT_PAIRS} SELECT i, j, round(sim, 6) AS sim FROM pairs",
    "greedy_dedup": f"WITH RECURSIVE {VEC_PAIRS}, {greedy('SELECT vec_id AS row_id FROM embeddings')} SELECT row_id FROM survivors",
    "clean_threats": f"""WITH RECURSIVE {REPORT}
SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, CAST(row_id AS VARCHAR) AS id, substr(text, 1, 60) AS name
FROM survivors JOIN documents ON doc_id = row_id""",
    "duplicate_report": f"WITH RECURSIVE {REPORT} SELECT * FROM report",
    "duplicate_samples": f"WITH RECURSIVE {REPORT} SELECT * FROM report ORDER BY original_idx, duplicate_idx LIMIT 3",
    "dedup_summary": f"""WITH RECURSIVE {VEC_PAIRS}, {greedy('SELECT vec_id AS row_id FROM embeddings')},
c AS (SELECT (SELECT count(*) FROM v) AS o, (SELECT count(*) FROM survivors) AS s)
SELECT o AS original, o - s AS removed, s AS unique_rows, round((o - s)::DOUBLE / o * 100, 6) AS rate_percent FROM c""",
    "collect_threats": f"""WITH {PULSES} SELECT row_number() OVER (ORDER BY page, pos) - 1 AS row_id, id, name, description,
  tags, created_date, refs AS "references", 'feed' AS source, author FROM pulses WHERE {KEPT}""",
    "kmeans_fit": f"""WITH {VEC}, {centers()},
named AS (SELECT cluster, min(row_id) AS first_row, count(*) AS size, round(sum(distance * distance), 6) AS inertia
          FROM dist GROUP BY cluster)
SELECT row_id, first_row, size, inertia FROM dist JOIN named USING (cluster)""",
    "triage_pipeline": f"""WITH s AS (WITH RECURSIVE {REPORT} SELECT row_id FROM survivors),
b AS (WITH {NEAREST} SELECT * FROM best),
t AS (WITH {THREATS} SELECT row_id, name, {found(KEYWORD_LIST)} AS found FROM threats)
SELECT row_id, name, round(similarity_score, 6) AS similarity_score, most_similar_idx,
  array_to_string(found, ', ') AS matched_keywords, CAST(len(found) AS INTEGER) AS num_keywords_matched,
  round({points("len(found)")}, 6) AS keyword_score, true AS novelty_in_range, true AS cluster_known,
  true AS risk_is_weighted
FROM s JOIN b USING (row_id) JOIN t USING (row_id)""",
    "cluster_centers": f"""WITH {VEC}, {centers()} SELECT cluster AS cluster_id, n AS size, {checksum('c')}
  FROM center JOIN spread USING (cluster)""",
    "assign_clusters": f"""WITH {VEC}, {centers()},
near AS (SELECT v.row_id, c.cluster, sqrt(list_sum(list_transform(list_zip(v.e, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
         FROM v CROSS JOIN center c)
SELECT row_id, cluster, round(d, 6) AS distance FROM near QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, cluster) = 1""",
    "cluster_spread": f"""WITH {VEC}, {centers()} SELECT CAST(range AS INTEGER) AS cluster_id, round(coalesce(s, 0), 6) AS std_dev,
  coalesce(n, 0) AS size FROM range(12) LEFT JOIN spread ON cluster = range""",
    "inertia": f"WITH {VEC}, {centers()} SELECT round(sum(distance * distance), 6) AS inertia FROM dist",
    "novelty": f"""WITH {VEC}, {centers()}, nov AS (SELECT row_id, cluster, {NOVELTY_Z} AS z FROM dist JOIN spread USING (cluster))
SELECT row_id, CASE WHEN row_id % 10 <> 3 THEN cluster END AS cluster,
  CASE WHEN row_id % 10 <> 3 THEN round(z, 6) ELSE 0 END AS novelty_z,
  CASE WHEN row_id % 10 <> 3 THEN round(least(greatest(z, 0), 1)::DOUBLE, 6) ELSE 0 END AS novelty_score FROM nov""",
    "nearest_incident": f"WITH {NEAREST} SELECT row_id, round(similarity_score, 6) AS similarity_score, most_similar_idx FROM best",
    "similarity_score": f"WITH {NEAREST} SELECT row_id, round(similarity_score, 6) AS similarity_score FROM best",
    "keyword_match": f"WITH {SCORED} SELECT row_id, matched_keywords FROM scored",
    "keyword_score": f"""WITH {SCORED} SELECT row_id, num_keywords_matched, round(keyword_score, 6) AS keyword_score
  FROM scored""",
    "risk_score": f"""WITH {SCORED} SELECT row_id, round({DEFAULT}, 6) AS risk_score,
  round(similarity_score, 6) AS similarity_score, round(keyword_score, 6) AS keyword_score,
  round(novelty_score, 6) AS novelty_score FROM scored""",
    "score_threats": f"""WITH {FULL_SCORE}, s AS (SELECT *, {DEFAULT} AS risk_score FROM comp)
SELECT row_id, {SCORE4}, most_similar_idx, matched_keywords, num_keywords_matched, cluster FROM s""",
    "rescore": f"""WITH {SCORED} SELECT row_id, round({NEW}, 6) AS risk_score, round({NEW}, 6) AS risk_score_new,
  round({DEFAULT}, 6) AS risk_score_old FROM scored""",
    "rescore_comparison": f"""WITH {SCORED} SELECT round(avg({DEFAULT}), 6) AS old_mean, round(avg({NEW}), 6) AS new_mean,
  round(max({DEFAULT}), 6) AS old_max, round(max({NEW}), 6) AS new_max FROM scored""",
    "cluster_profile": f"WITH {PROFILE} SELECT * FROM prof",
    "top_tags": f"WITH {SCORED}, {TAGS.format(tag='trim(tag)')} SELECT cluster, tag, n_rows, rank FROM tagr",
    "sample_names": f"WITH {SCORED}, {TAGS.format(tag='trim(tag)')} SELECT cluster, sample, rank FROM namr",
    "cluster_summary": f"""WITH {SCORED}, {TAGS.format(tag='tag')}
SELECT cluster, n_rows, top_tags, sample_threats FROM (SELECT cluster, count(*) AS n_rows FROM scored GROUP BY cluster)
  JOIN tagj USING (cluster) JOIN namj USING (cluster)""",
    "cluster_size_summary": f"""WITH {SCORED}, {SIZES} SELECT count(*) FILTER (size > 0) AS num_clusters, 0::BIGINT AS noise_points,
  round(avg(size), 6) AS avg_cluster_size, max(size) AS max_cluster_size, min(size) AS min_cluster_size FROM sizes""",
    "score_distribution": f"""WITH {SCORED} SELECT round(avg(risk_score), 6) AS mean_score, round(median(risk_score), 6) AS median_score,
  round(stddev_samp(risk_score), 6) AS std_score, round(min(risk_score), 6) AS min_score, round(max(risk_score), 6) AS max_score
  FROM scored""",
    "band_counts": f"""WITH {SCORED} SELECT b AS risk_category, count(s.row_id) AS n_rows,
  round(count(s.row_id)::DOUBLE / (SELECT count(*) FROM scored) * 100, 6) AS percent
  FROM (VALUES ('High'), ('Medium'), ('Low')) x(b) LEFT JOIN scored s ON s.risk_category = b GROUP BY b""",
    "kpis": f"""WITH {SCORED} SELECT count(*) AS total_threats, count(*) FILTER (risk_category = 'High') AS high_risk,
  round(count(*) FILTER (risk_category = 'High')::DOUBLE / nullif(count(*), 0) * 100, 6) AS high_risk_percent,
  round(avg(risk_score), 6) AS avg_risk, count(DISTINCT cluster) AS n_clusters,
  round(avg(num_keywords_matched), 6) AS avg_keywords FROM scored WHERE risk_category IN ('High', 'Medium')""",
    "score_histogram": f"""WITH {SCORED}, box AS (SELECT min(risk_score) AS lo, max(risk_score) AS hi FROM scored)
SELECT CAST(least(floor((risk_score - lo) / (hi - lo) * 30), 29) + 1 AS INTEGER) AS bin, risk_category, count(*) AS n_rows
FROM scored, box GROUP BY ALL""",
    "cluster_counts": f"WITH {SCORED} SELECT cluster, count(*) AS n_rows FROM scored GROUP BY cluster",
    "timeline_monthly": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_rows FROM orders GROUP BY 1",
    "precision_recall_at_k": f"""WITH {LABELLED},
r AS (SELECT hit, row_number() OVER (ORDER BY risk_score DESC, row_id) AS rank FROM lab),
k AS (SELECT CAST(unnest([10, 20, 30, 50, 75, 100, 150, 200]) AS INTEGER) AS k),
f AS (SELECT k, sum(hit)::BIGINT AS n_found FROM k JOIN r ON rank <= k WHERE k <= (SELECT count(*) FROM lab) GROUP BY k),
p AS (SELECT k, n_found, t AS total_critical, n_found::DOUBLE / k AS p, n_found::DOUBLE / nullif(t, 0) AS r FROM f, tot)
SELECT k, n_found, total_critical, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p""",
    "baseline_random": f"""WITH {LABELLED} SELECT method, n_found, total_critical, round(recall, 6) AS recall FROM base
  WHERE method = 'random'""",
    "baseline_recency": f"""WITH {LABELLED} SELECT method, n_found, total_critical, round(recall, 6) AS recall FROM base
  WHERE method = 'recency'""",
    "baseline_comparison": f"""WITH {LABELLED}, one AS (SELECT max(recall) FILTER (method = 'recency') AS a,
  max(recall) FILTER (method = 'ranked') AS b FROM base)
SELECT method, n_found, total_critical, round(recall, 6) AS recall,
  round((b - a) / greatest(a, 0.01::DOUBLE) * 100, 6) AS improvement_percent FROM base, one""",
    "rank_threats": f"WITH {SCORED} SELECT row_id, round(risk_score, 6) AS risk_score FROM scored",
    "top_n": f"""WITH {SCORED}, r AS (
  SELECT row_id, row_number() OVER (ORDER BY risk_score DESC, row_id) AS a, row_number() OVER (ORDER BY created_ts DESC, row_id) AS b,
    row_number() OVER (ORDER BY num_keywords_matched DESC, row_id) AS c FROM scored)
SELECT 'risk' AS order_by, CAST(a AS INTEGER) AS rank, row_id FROM r WHERE a <= 50
UNION ALL SELECT 'date', CAST(b AS INTEGER), row_id FROM r WHERE b <= 50
UNION ALL SELECT 'keywords', CAST(c AS INTEGER), row_id FROM r WHERE c <= 50""",
    "top10_report": f"""WITH {SCORED} SELECT CAST(row_number() OVER (ORDER BY {NEW} DESC, row_id) AS INTEGER) AS rank, row_id, is_critical,
  round({DEFAULT}, 6) AS risk_score_old, round({NEW}, 6) AS risk_score, substr(name, 1, 55) AS name
  FROM scored ORDER BY {NEW} DESC, row_id LIMIT 10""",
    "component_profile": f"""WITH {SCORED} SELECT CAST(row_number() OVER (ORDER BY risk_score DESC, row_id) AS INTEGER) AS rank, row_id,
  round(similarity_score, 6) AS similarity_score, round(keyword_score, 6) AS keyword_score,
  round(novelty_score, 6) AS novelty_score FROM scored ORDER BY risk_score DESC, row_id LIMIT 50""",
    "score_proximity": f"""WITH {SCORED}, top AS (
  SELECT row_id, risk_score, CASE WHEN length(name) > 40 THEN substr(name, 1, 40) || '...' ELSE name END AS label
  FROM scored ORDER BY risk_score DESC, row_id LIMIT 20)
SELECT a.row_id AS row_a, b.row_id AS row_b, a.label AS label_a, b.label AS label_b,
  round(1 - abs(a.risk_score - b.risk_score), 6) AS proximity FROM top a, top b""",
}

ORACLE["score_with_saved"] = ORACLE["score_threats"]
