"""More named queries in the words of ``catalog``: constraints, reconciliation, selection, safety,
retrieval and statistical language operators, evaluation, ledgers. Everything runs over whole tables."""

from __future__ import annotations

_WORDS = "SELECT DISTINCT conv_id, turn, w FROM conversations, @unnest(@tok(text)) AS t(w)"
_TYPES = "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type"
_LAST = "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) z WHERE rn = 1"
_RANKED = f"SELECT t.user_id, t.event_type, row_number() OVER (PARTITION BY t.user_id ORDER BY t.n DESC, t.event_type) AS place FROM ({_TYPES}) t"
_JUDGED = "SELECT l.doc_id, d.source, d.lang, l.quality AS y, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS g, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id"
_PART_PAIRS = "SELECT p_partkey, s, t FROM (SELECT p_partkey, s, p_brand, p_type FROM part, @unnest(@tok(concat('null ', p_name))) AS x(s)) a, @unnest(@pair2(p_brand, p_type)) AS y(t)"
_OUTCOMES = "SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END ORDER BY ts, event_id) AS k, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS done FROM events WHERE event_type IN ('click', 'purchase', 'error')"

SQL: dict[str, str] = {
    # projections, filters, constraints
    "project_blind": "SELECT d.doc_id, d.lang, d.n_chars, CASE WHEN @fold5(CAST(d.doc_id AS STRING)) = 0 THEN NULL ELSE l.quality END AS visible_quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
    "project_redacted": "SELECT doc_id, source, n_chars, @sha(text) AS text_sha256, CASE WHEN @re(text, '[A-Za-z0-9._]+[@][A-Za-z0-9.]+') THEN 1 ELSE 0 END AS has_address FROM documents",
    "schema_violations": "SELECT 'documents' AS tab, doc_id AS id, '$.n_chars' AS path, 'equals length of text' AS rule_ FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'documents', doc_id, '$.lang', 'enum' FROM documents WHERE lang NOT IN ('en', 'fr', 'de') UNION ALL SELECT 'documents', doc_id, '$.text', 'minLength 40' FROM documents WHERE length(text) < 40 UNION ALL SELECT 'documents', doc_id, '$.source', 'pattern' FROM documents WHERE NOT @re(source, '^src[0-9]$') UNION ALL SELECT 'pages', page_id, '$.url', 'pattern' FROM pages WHERE NOT @re(url, '^https://') UNION ALL SELECT 'labels', doc_id, '$.toxic', 'const 0' FROM labels WHERE toxic <> 0",
    "fk_reciprocal": "SELECT 'label without document' AS rule_, l.doc_id AS k FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) UNION ALL SELECT 'document without label', d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT 'nation without supplier', CAST(n_nationkey AS BIGINT) FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)",
    "population_equality": "SELECT count(d.doc_id) AS declared, count(l.doc_id) AS found, count(CASE WHEN l.doc_id IS NULL THEN 1 END) AS missing, count(CASE WHEN d.doc_id IS NULL THEN 1 END) AS extra FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id",
    "denominator_partition": "SELECT source, docs, good, bad, open_, CASE WHEN docs = good + bad + open_ THEN 1 ELSE 0 END AS adds_up FROM (SELECT d.source, count(*) AS docs, count(CASE WHEN l.quality = 1 THEN 1 END) AS good, count(CASE WHEN l.quality = 0 THEN 1 END) AS bad, count(CASE WHEN l.quality IS NULL THEN 1 END) AS open_ FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source) t",
    "url_rules": "SELECT page_id, CASE WHEN @re(url, '^https?://[a-z0-9.-]+(/.*)?$') THEN 1 ELSE 0 END AS absolute, CASE WHEN @re(url, '^https?://[^/]*[@]') THEN 1 ELSE 0 END AS has_user, CASE WHEN @re(url, '[?]') THEN 1 ELSE 0 END AS has_query, @rx(url, '^https?://([^/:]+)', 1) AS host FROM pages",
    "placeholder_evidence": "SELECT 'conversations' AS tab, count(*) AS n, count(CASE WHEN trim(text) = '' OR @re(lower(text), '^(todo|tbd|n/a|none|unknown|placeholder)[.]?$') THEN 1 END) AS hollow FROM conversations UNION ALL SELECT 'documents', count(*), count(CASE WHEN trim(text) = '' OR length(text) < 20 OR @re(lower(text), 'lorem ipsum|todo|tbd') THEN 1 END) FROM documents",
    "key_filter": "SELECT p_partkey, p_brand FROM part WHERE @re(p_brand, '^Brand#[1-9]$')",
    "glob_scope": "SELECT page_id, url FROM pages WHERE @re(url, '^https?://[^/]*[.]example[.]com/(fr|en|de|es)/[^/]*$')",
    "state_transitions": "SELECT before, role, count(*) AS n, max(CASE WHEN before = 'start' AND role IN ('system', 'user') OR before = 'system' AND role = 'user' OR before = 'user' AND role = 'assistant' OR before = 'assistant' AND role = 'user' THEN 1 ELSE 0 END) AS allowed FROM (SELECT role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'start') AS before FROM conversations) t GROUP BY before, role",
    "snapshot_consistency": "SELECT l_returnflag, count(*) AS n, count(CASE WHEN abs(l_extendedprice - l_quantity * p_retailprice) < 0.01 THEN 1 END) AS same, count(CASE WHEN l_shipdate < o_orderdate THEN 1 END) AS before_order FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY l_returnflag",
    "interval_sanity": "SELECT user_id, n, CASE WHEN m - 1.96 * sd / sqrt(n) <= med AND med <= m + 1.96 * sd / sqrt(n) THEN 1 ELSE 0 END AS holds_median, CASE WHEN m - 1.96 * sd / sqrt(n) >= 0 THEN 1 ELSE 0 END AS above_zero FROM (SELECT user_id, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS med FROM events GROUP BY user_id) t WHERE n > 1",
    "point_lookup": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42",
    "field_lookup": "SELECT event_id, CAST(@json(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase'",
    "eligibility_reason": "SELECT d.doc_id, CASE WHEN trim(d.text) = '' THEN 'no text' WHEN d.n_chars < 100 THEN 'short' WHEN l.doc_id IS NULL THEN 'no label' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'low quality' ELSE 'eligible' END AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    # joins
    "join_strict_lookup": "SELECT o_orderkey, coalesce(c_name, @raise('order without customer')) AS c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "reconcile_three": "SELECT c_custkey, coalesce(o.n, 0) AS orders_, coalesce(l.n, 0) AS lines, CASE WHEN o.n IS NULL AND l.n IS NOT NULL THEN 'lines without order' WHEN o.n IS NULL THEN 'no order' WHEN l.n IS NULL THEN 'no lines' WHEN l.n < o.n THEN 'fewer lines than orders' ELSE 'ok' END AS verdict FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey) l ON l.o_custkey = c_custkey",
    "others_outside_group": "SELECT p_partkey, count(*) OVER (PARTITION BY p_name) - count(*) OVER (PARTITION BY p_name, p_brand) AS others FROM part",
    "word_boundary_join": "SELECT term, count(*) AS parts FROM part JOIN (SELECT * FROM (VALUES ('ring'), ('red'), ('widget'), ('small')) AS t(term)) q ON @re(p_name, concat('(^| )', term, '( |$)')) GROUP BY term",
    "self_pairs": "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "parent_pointer": "SELECT c_custkey, n_name AS parent, r_name AS grandparent FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    "lookup_fallback": "SELECT d.doc_id, coalesce(l.quality, s.q, 0) AS quality, CASE WHEN l.quality IS NOT NULL THEN 'own' WHEN s.q IS NOT NULL THEN 'source' ELSE 'default' END AS level FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT source, CASE WHEN 2 * sum(quality) > count(*) THEN 1 ELSE 0 END AS q FROM documents x JOIN labels y ON y.doc_id = x.doc_id GROUP BY source) s ON s.source = d.source",
    # aggregation
    "agg_grouping_id": "SELECT o_orderstatus, o_orderpriority, CAST(@gid(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())",
    "support_by_group": "SELECT w, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents, @unnest(@tok(text)) AS t(w) GROUP BY w HAVING count(DISTINCT source) > 1",
    "collect_sorted": "SELECT c_nationkey, @set(c_mktsegment) AS segments, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY c_nationkey",
    "macro_f1": f"SELECT round(avg(f1), 8) AS macro_f1 FROM (SELECT k, 2e0 * count(CASE WHEN y = k AND g = k THEN 1 END) / (2 * count(CASE WHEN y = k AND g = k THEN 1 END) + count(CASE WHEN y <> k AND g = k THEN 1 END) + count(CASE WHEN y = k AND g <> k THEN 1 END)) AS f1 FROM ({_JUDGED}) p CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) s GROUP BY k) c",
    "balanced_accuracy": f"SELECT round(avg(recall), 8) AS balanced, round(sum(hit) * 1e0 / sum(n), 8) AS accuracy FROM (SELECT y, avg(CASE WHEN g = y THEN 1e0 ELSE 0e0 END) AS recall, count(CASE WHEN g = y THEN 1 END) AS hit, count(*) AS n FROM ({_JUDGED}) p GROUP BY y) c",
    "label_accuracy": f"SELECT lang, y, count(*) AS n, round(avg(CASE WHEN g = y THEN 1e0 ELSE 0e0 END), 8) AS accuracy FROM ({_JUDGED}) p GROUP BY lang, y",
    "weighted_sum_exact": "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(12, 2)) * CAST(l_extendedprice AS DECIMAL(12, 2))) AS STRING) AS weighted FROM lineitem GROUP BY l_returnflag",
    "histogram": "SELECT CAST(floor(p_retailprice / 100) AS BIGINT) AS bin, count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY CAST(floor(p_retailprice / 100) AS BIGINT)",
    "agreement_rate": f"SELECT source, count(*) AS pairs, round(avg(CASE WHEN y = g THEN 1e0 ELSE 0e0 END), 8) AS agreement FROM ({_JUDGED}) p GROUP BY source",
    "dataset_summary": "SELECT 'documents' AS tab, count(*) AS n, count(DISTINCT source) AS groups_, CAST(min(n_chars) AS DOUBLE) AS least, CAST(max(n_chars) AS DOUBLE) AS most FROM documents UNION ALL SELECT 'events', count(*), count(DISTINCT user_id), min(value), max(value) FROM events UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey), min(l_quantity), max(l_quantity) FROM lineitem UNION ALL SELECT 'conversations', count(*), count(DISTINCT conv_id), CAST(min(turn) AS DOUBLE), CAST(max(turn) AS DOUBLE) FROM conversations",
    # ranking, selection, sets
    "partition_by_hash_rank": "SELECT doc_id, lang, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.7) + floor(n * 0.14) THEN 'dev' ELSE 'test' END AS part FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY @sha(concat('part|', CAST(doc_id AS STRING))), doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) t",
    "donor_dev_split": "SELECT doc_id, source, CASE WHEN i <= ceil(n * 0.1) THEN 'dev' ELSE 'fit' END AS part FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY @sha(concat('dev|', CAST(doc_id AS STRING))), doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE @fold5(CAST(doc_id AS STRING)) <> 0) t",
    "first_per_two_keys": "SELECT lang, source, doc_id, CAST(i AS BIGINT) AS place FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS i FROM documents) t WHERE i <= 2",
    "alternatives_and_rest": f"SELECT user_id, max(CASE WHEN place = 1 THEN event_type END) AS first_, max(CASE WHEN place = 2 THEN event_type END) AS second_, CAST(sum(CASE WHEN place > 2 THEN 1 ELSE 0 END) AS BIGINT) AS remaining FROM ({_RANKED}) r GROUP BY user_id",
    "grid_argmax": f"SELECT theta, round(acc, 8) AS accuracy FROM (SELECT theta, acc, row_number() OVER (ORDER BY acc DESC, theta DESC) AS rn FROM (SELECT theta, avg(CASE WHEN (n_chars > theta) = (y = 1) THEN 1e0 ELSE 0e0 END) AS acc FROM ({_JUDGED}) p CROSS JOIN (SELECT * FROM (VALUES (100), (250), (500), (1000), (2000), (4000)) AS v(theta)) g GROUP BY theta) a) b WHERE rn = 1",
    "adjacent_gaps": "SELECT user_id, count(gap) AS gaps, CAST(min(gap) AS BIGINT) AS least, CAST(max(gap) AS BIGINT) AS most, round(avg(gap), 6) AS mean FROM (SELECT user_id, @epoch(ts) - lag(@epoch(ts)) OVER (PARTITION BY user_id ORDER BY @epoch(ts), event_id) AS gap FROM events) t GROUP BY user_id",
    "true_neighbours": "SELECT l_orderkey, l_linenumber, before, CASE WHEN before = l_linenumber - 1 THEN 1 ELSE 0 END AS adjacent FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM lineitem) t WHERE before IS NOT NULL",
    "otsu_threshold": "SELECT bin, round(between_, 4) AS between_ FROM (SELECT bin, between_, row_number() OVER (ORDER BY between_ DESC, bin) AS rn FROM (SELECT bin, w0, w - w0 AS w1, CASE WHEN w0 > 0 AND w > w0 THEN (w0 * 1e0 / w) * ((w - w0) * 1e0 / w) * (s0 * 1e0 / w0 - (s - s0) * 1e0 / (w - w0)) * (s0 * 1e0 / w0 - (s - s0) * 1e0 / (w - w0)) ELSE 0e0 END AS between_ FROM (SELECT bin, sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w0, sum(n * bin) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s0, sum(n) OVER () AS w, sum(n * bin) OVER () AS s FROM (SELECT least(CAST(floor(n_chars / 64) AS BIGINT), 255) AS bin, count(*) AS n FROM documents GROUP BY least(CAST(floor(n_chars / 64) AS BIGINT), 255)) h) c) v) r WHERE rn = 1",
    "state_replay": "SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance FROM events",
    "latest_in_order": "SELECT event_id, event_type, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS place FROM (SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20) t",
    "set_symmetric_difference": "SELECT k, count(*) AS sides, max(side) AS side FROM (SELECT DISTINCT l_orderkey AS k, 'A' AS side FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT DISTINCT l_orderkey, 'R' FROM lineitem WHERE l_returnflag = 'R') t GROUP BY k HAVING count(*) = 1",
    "partition_sets_equal": "SELECT langs, count(*) AS sources FROM (SELECT source, @set(lang) AS langs FROM documents GROUP BY source) t GROUP BY langs",
    # graphs, components, safety
    "component_digest": "SELECT substr(@sha(@ids(doc_id)), 1, 16) AS component, count(*) AS members, min(doc_id) AS first_id FROM documents GROUP BY @sha(@join(@tok(text)))",
    "component_flags": "SELECT d.doc_id, max(coalesce(l.toxic, 0)) OVER (PARTITION BY @sha(@join(@tok(d.text)))) AS any_toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "unmet_dependencies": "SELECT a.l_orderkey, a.l_linenumber, a.l_linenumber - 1 AS missing FROM lineitem a WHERE a.l_linenumber > 1 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber - 1)",
    "near_dup_queue": "SELECT a.doc_id AS left_id, b.doc_id AS right_id, 'equal normalised text' AS method FROM (SELECT doc_id, text, norm, min(doc_id) OVER (PARTITION BY norm) AS first_id FROM (SELECT doc_id, text, @sha(@join(@tok(text))) AS norm FROM documents) x) b JOIN documents a ON a.doc_id = b.first_id AND b.doc_id <> b.first_id",
    "pairs_crossing_parts": "SELECT part, other, count(*) AS pairs_ FROM (SELECT CASE WHEN @fold5(CAST(first_id AS STRING)) = 0 THEN 'test' ELSE 'train' END AS part, CASE WHEN @fold5(CAST(doc_id AS STRING)) = 0 THEN 'test' ELSE 'train' END AS other FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY @sha(text)) AS first_id FROM documents) x WHERE doc_id <> first_id) y GROUP BY part, other",
    "identity_leakage": "SELECT identity, count(DISTINCT part) AS parts, count(*) AS docs FROM (SELECT CASE WHEN @fold5(CAST(doc_id AS STRING)) = 0 THEN 'test' ELSE 'train' END AS part, identity FROM documents, @unnest(@pair2(source, concat(source, '/', lang))) AS t(identity)) x GROUP BY identity HAVING count(DISTINCT part) > 1",
    "physical_keys": "SELECT page_id, @rx(url, '^https?://([^/]+)', 1) AS host, @rx(url, '/([0-9]+)([?].*)?$', 1) AS number_, lower(@rx(url, '^https?://[^/]+/([a-z]+)/', 1)) AS section FROM pages",
    "literal_id_overlap": "SELECT doc_id AS id, 'documents' AS in_ FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "split_manifest": "SELECT part, count(*) AS docs, @sha(@ids(doc_id)) AS digest FROM (SELECT doc_id, CASE WHEN @fold5(source) = 0 THEN 'test' WHEN @fold5(source) = 1 THEN 'dev' ELSE 'train' END AS part FROM documents) t GROUP BY part",
    "split_replay_check": "SELECT lang, count(*) AS docs, count(CASE WHEN kept = again THEN 1 END) AS same FROM (SELECT doc_id, lang, @fold5(CAST(doc_id AS STRING)) AS kept, @boot(CAST(doc_id AS STRING)) % 5 AS again FROM documents) t GROUP BY lang",
    "train_test_exact": "SELECT t.doc_id, count(*) AS copies FROM documents t JOIN documents s ON @sha(s.text) = @sha(t.text) AND @fold5(CAST(s.doc_id AS STRING)) <> 0 WHERE @fold5(CAST(t.doc_id AS STRING)) = 0 GROUP BY t.doc_id",
    "copied_lines": "SELECT t.doc_id, count(*) AS lines FROM (SELECT DISTINCT doc_id, @sha(line) AS h FROM documents, @unnest(@lines(text)) AS x(line) WHERE length(line) >= 20 AND @fold5(CAST(doc_id AS STRING)) = 0) t JOIN (SELECT DISTINCT @sha(line) AS h FROM documents, @unnest(@lines(text)) AS x(line) WHERE length(line) >= 20 AND @fold5(CAST(doc_id AS STRING)) <> 0) s ON s.h = t.h GROUP BY t.doc_id",
    "admission_matrix": "SELECT lang, decision, count(*) AS n FROM (SELECT d.lang, CASE WHEN l.doc_id IS NULL THEN 'review' WHEN l.toxic = 1 THEN 'deny' WHEN l.quality = 1 THEN 'admit' ELSE 'metadata only' END AS decision FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) t GROUP BY lang, decision",
    "readiness_gates": "SELECT d.doc_id, concat(CASE WHEN l.doc_id IS NULL THEN 'label;' ELSE '' END, CASE WHEN d.n_chars < 100 THEN 'length;' ELSE '' END, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'toxicity;' ELSE '' END, CASE WHEN d.lang <> 'en' THEN 'translation;' ELSE '' END) AS open_gates FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    # text
    "token_sets": "SELECT conv_id, turn, CAST(@len(@tok(text)) AS BIGINT) AS tokens, CAST(@len(@uniq(@tok(text))) AS BIGINT) AS types FROM conversations",
    "label_by_patterns": "SELECT conv_id, turn, coalesce(@nonempty(@rx(lower(text), '(license|lizenz|licence)', 1)), @nonempty(@rx(text, '([A-Z][a-z]+[.!?])', 1)), 'none') AS label FROM conversations",
    "claim_classes": "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN @re(lower(text), '(^|[^a-z])(not|no|never|pas|nicht|kein)([^a-z]|$)') AND @re(lower(text), '(^|[^a-z])(yes|is|are|est|ist)([^a-z]|$)') THEN 'mixed' WHEN @re(lower(text), '(^|[^a-z])(not|no|never|pas|nicht|kein)([^a-z]|$)') THEN 'negative' WHEN @re(lower(text), '(^|[^a-z])(yes|is|are|est|ist)([^a-z]|$)') THEN 'affirmative' WHEN trim(text) = '' THEN 'abstains' ELSE 'descriptive' END AS kind FROM conversations) t GROUP BY kind",
    "unique_phrase": "SELECT conv_id, turn, CAST(instr(text, 'the ') AS BIGINT) AS at FROM conversations WHERE length(text) - length(replace(text, 'the ', '')) = 4",
    "section_headings": "SELECT doc_id, @rx(text, '^([^.]{1,80})[.]', 1) AS heading, CAST(length(text) AS BIGINT) AS n FROM documents",
    "markup_flatten": "SELECT page_id, CAST(length(html) AS BIGINT) AS raw, @sha(@sub(@sub(html, '<[^>]*>', ' '), '[ ]+', ' ')) AS flat_sha256 FROM pages",
    # retrieval and statistical language
    "gloss_vote": "WITH v AS (SELECT DISTINCT w, lang, source FROM documents, @unnest(@tok(text)) AS t(w)), n AS (SELECT w, lang, count(*) AS sources FROM v GROUP BY w, lang), o AS (SELECT DISTINCT w, source FROM v), c AS (SELECT o.w, o.source, n.lang, n.sources - CASE WHEN v.w IS NULL THEN 0 ELSE 1 END AS support FROM o JOIN n ON n.w = o.w LEFT JOIN v ON v.w = o.w AND v.source = o.source AND v.lang = n.lang), r AS (SELECT w, source, lang, support, row_number() OVER (PARTITION BY w, source ORDER BY support DESC, lang) AS rn FROM c) SELECT w, source, CASE WHEN support > 0 THEN lang ELSE '[?]' END AS gloss, support FROM r WHERE rn = 1",
    "parallel_retrieval": "SELECT doc_id, norm, sources - 1 AS other_sources FROM (SELECT d.doc_id, d.norm, s.sources FROM (SELECT doc_id, @sha(@join(@tok(text))) AS norm FROM documents) d JOIN (SELECT norm, count(DISTINCT source) AS sources FROM (SELECT source, @sha(@join(@tok(text))) AS norm FROM documents) x GROUP BY norm) s ON s.norm = d.norm) t WHERE sources > 1",
    "tfidf_neighbour": f"WITH f AS ({_WORDS}), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT conv_id, turn FROM f) x), i AS (SELECT w, power(ln(1 + (n + 1) * 1e0 / (1 + df)), 2) AS g FROM (SELECT w, count(*) AS df FROM f GROUP BY w) d CROSS JOIN n), g AS (SELECT f.conv_id, f.turn, f.w, i.g FROM f JOIN i ON i.w = f.w), s AS (SELECT conv_id, turn, sqrt(sum(g * g)) AS norm, sum(g) AS mass, count(*) AS forms FROM g GROUP BY conv_id, turn), p AS (SELECT a.conv_id AS qc, a.turn AS qt, b.conv_id AS c, b.turn AS t, sum(a.g * b.g) AS dot, sum(a.g) AS mass, count(*) AS shared FROM g a JOIN g b ON b.w = a.w AND b.conv_id <> a.conv_id GROUP BY a.conv_id, a.turn, b.conv_id, b.turn), k AS (SELECT p.qc, p.qt, p.c, p.t, p.shared, round(p.dot / (x.norm * y.norm) * least(x.forms, y.forms) / greatest(x.forms, y.forms), 8) AS score FROM p JOIN s x ON x.conv_id = p.qc AND x.turn = p.qt JOIN s y ON y.conv_id = p.c AND y.turn = p.t WHERE (p.shared >= 2 OR x.forms = 1) AND p.mass >= 0.25 * x.mass), r AS (SELECT *, row_number() OVER (PARTITION BY qc, qt ORDER BY score DESC, shared DESC, c, t) AS rn FROM k) SELECT qc, qt, c, t, shared, score, CASE WHEN score >= 0.3 THEN 'retrieved' ELSE 'gloss' END AS route FROM r WHERE rn = 1",
    "fold_thresholds": f"SELECT fold, theta, round(acc, 8) AS dev_accuracy FROM (SELECT fold, theta, acc, row_number() OVER (PARTITION BY fold ORDER BY acc DESC, theta DESC) AS rn FROM (SELECT fold, theta, avg(CASE WHEN (n_chars > theta) = (y = 1) THEN 1e0 ELSE 0e0 END) AS acc FROM (SELECT y, n_chars, @fold5(source) AS own FROM ({_JUDGED}) j) p CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) AS a(fold)) f CROSS JOIN (SELECT * FROM (VALUES (100), (500), (1000), (2000), (4000)) AS b(theta)) g WHERE own <> fold GROUP BY fold, theta) a) b WHERE rn = 1",
    "context_backoff": "WITH e AS (SELECT event_id, user_id, event_type AS x, lag(event_type) OVER w AS l, lead(event_type) OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), v AS (SELECT 3 AS level, concat(l, '|', r) AS k, x, count(DISTINCT user_id) AS n FROM e WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY concat(l, '|', r), x UNION ALL SELECT 2, l, x, count(DISTINCT user_id) FROM e WHERE l IS NOT NULL GROUP BY l, x UNION ALL SELECT 1, r, x, count(DISTINCT user_id) FROM e WHERE r IS NOT NULL GROUP BY r, x UNION ALL SELECT 0, '', x, count(DISTINCT user_id) FROM e GROUP BY x), b AS (SELECT level, k, x FROM (SELECT level, k, x, row_number() OVER (PARTITION BY level, k ORDER BY n DESC, x) AS rn FROM v WHERE n >= 2) t WHERE rn = 1) SELECT e.event_id, coalesce(b3.x, b2.x, b1.x, b0.x) AS predicted, CASE WHEN b3.x IS NOT NULL THEN 3 WHEN b2.x IS NOT NULL THEN 2 WHEN b1.x IS NOT NULL THEN 1 ELSE 0 END AS level FROM e LEFT JOIN b b3 ON b3.level = 3 AND b3.k = concat(e.l, '|', e.r) LEFT JOIN b b2 ON b2.level = 2 AND b2.k = e.l LEFT JOIN b b1 ON b1.level = 1 AND b1.k = e.r LEFT JOIN b b0 ON b0.level = 0",
    "swap_votes": "WITH b AS (SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) t WHERE b IS NOT NULL AND a <> b GROUP BY a, b) SELECT x.a, x.b, x.n AS normal, coalesce(y.n, 0) AS inverted, CASE WHEN coalesce(y.n, 0) >= 2 AND coalesce(y.n, 0) > 2 * x.n THEN 1 ELSE 0 END AS swaps FROM b x LEFT JOIN b y ON y.a = x.b AND y.b = x.a",
    "ibm1_em": f"WITH c AS ({_PART_PAIRS}), u AS (SELECT s, 1e0 / count(DISTINCT t) AS p FROM c GROUP BY s), e1 AS (SELECT c.s, c.t, sum(u.p / z.z) AS n FROM c JOIN u ON u.s = c.s JOIN (SELECT c.p_partkey, c.t, sum(u.p) AS z FROM c JOIN u ON u.s = c.s GROUP BY c.p_partkey, c.t) z ON z.p_partkey = c.p_partkey AND z.t = c.t GROUP BY c.s, c.t), m1 AS (SELECT e.s, e.t, e.n / g.n AS p FROM e1 e JOIN (SELECT s, sum(n) AS n FROM e1 GROUP BY s) g ON g.s = e.s), e2 AS (SELECT c.s, c.t, sum(m.p / z.z) AS n FROM c JOIN m1 m ON m.s = c.s AND m.t = c.t JOIN (SELECT c.p_partkey, c.t, sum(m.p) AS z FROM c JOIN m1 m ON m.s = c.s AND m.t = c.t GROUP BY c.p_partkey, c.t) z ON z.p_partkey = c.p_partkey AND z.t = c.t GROUP BY c.s, c.t) SELECT e.s, e.t, round(e.n / g.n, 6) AS p FROM e2 e JOIN (SELECT s, sum(n) AS n FROM e2 GROUP BY s) g ON g.s = e.s",
    "phrase_weights": f"SELECT s, t, n, round(n * 1e0 / sum(n) OVER (PARTITION BY s) * n, 6) AS weight FROM (SELECT s, t, count(*) AS n FROM ({_PART_PAIRS}) c WHERE s <> 'null' GROUP BY s, t) x",
    "suffix_tagger": "WITH v AS (SELECT w, lang, doc_id FROM documents, @unnest(@tok(text)) AS t(w)), f AS (SELECT w, lang, count(*) AS n FROM v WHERE @fold5(CAST(doc_id AS STRING)) <> 0 GROUP BY w, lang), k AS (SELECT 4 AS level, w AS k, lang, sum(n) AS n FROM f GROUP BY w, lang UNION ALL SELECT 3, right(w, 3), lang, sum(n) FROM f WHERE length(w) >= 3 GROUP BY right(w, 3), lang UNION ALL SELECT 2, right(w, 2), lang, sum(n) FROM f WHERE length(w) >= 2 GROUP BY right(w, 2), lang UNION ALL SELECT 1, right(w, 1), lang, sum(n) FROM f GROUP BY right(w, 1), lang UNION ALL SELECT 0, '', lang, sum(n) FROM f GROUP BY lang), m AS (SELECT level, k, lang FROM (SELECT level, k, lang, sum(n) OVER (PARTITION BY level, k) AS total, row_number() OVER (PARTITION BY level, k ORDER BY n DESC, lang) AS rn FROM k) t WHERE rn = 1 AND (level IN (0, 4) OR level = 3 AND total >= 3 OR level = 2 AND total >= 5 OR level = 1 AND total >= 8)), q AS (SELECT DISTINCT w FROM v WHERE @fold5(CAST(doc_id AS STRING)) = 0) SELECT q.w, coalesce(m4.lang, m3.lang, m2.lang, m1.lang, m0.lang) AS tag, CASE WHEN m4.lang IS NOT NULL THEN 4 WHEN m3.lang IS NOT NULL THEN 3 WHEN m2.lang IS NOT NULL THEN 2 WHEN m1.lang IS NOT NULL THEN 1 ELSE 0 END AS level FROM q LEFT JOIN m m4 ON m4.level = 4 AND m4.k = q.w LEFT JOIN m m3 ON m3.level = 3 AND m3.k = right(q.w, 3) AND length(q.w) >= 3 LEFT JOIN m m2 ON m2.level = 2 AND m2.k = right(q.w, 2) AND length(q.w) >= 2 LEFT JOIN m m1 ON m1.level = 1 AND m1.k = right(q.w, 1) LEFT JOIN m m0 ON m0.level = 0",
    "head_scores": "SELECT role, count(*) AS n, round(avg(CASE WHEN guess = gold THEN 1e0 ELSE 0e0 END), 8) AS uas, round(avg(CASE WHEN guess = gold AND rel = 'user' THEN 1e0 ELSE 0e0 END), 8) AS las FROM (SELECT role, turn - 1 AS guess, max(CASE WHEN role <> 'system' THEN turn END) OVER w AS gold, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS rel, turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) t WHERE turn > 0 GROUP BY role",
    "recall_from_others": "WITH v AS (SELECT DISTINCT source, w FROM documents, @unnest(@tok(text)) AS t(w)), n AS (SELECT w, count(*) AS sources FROM v GROUP BY w) SELECT v.source, count(*) AS types, count(CASE WHEN n.sources > 1 THEN 1 END) AS found, round(count(CASE WHEN n.sources > 1 THEN 1 END) * 1e0 / count(*), 8) AS recall FROM v JOIN n ON n.w = v.w GROUP BY v.source",
    "lexical_outcomes": "SELECT outcome, count(*) AS types FROM (SELECT t.w, CASE WHEN l.w IS NULL THEN 'unattested' WHEN l.langs = 1 THEN 'interpreted' ELSE 'ambiguous' END AS outcome FROM (SELECT DISTINCT w FROM conversations, @unnest(@tok(text)) AS x(w)) t LEFT JOIN (SELECT w, count(DISTINCT lang) AS langs FROM documents, @unnest(@tok(text)) AS y(w) GROUP BY w) l ON l.w = t.w) o GROUP BY outcome",
    "layered_gloss": "SELECT w, @set(lang) AS candidates, CASE WHEN count(DISTINCT lang) = 1 THEN 'single' ELSE 'several' END AS status FROM documents, @unnest(@tok(text)) AS t(w) GROUP BY w",
    "transfer_coverage": "WITH v AS (SELECT conv_id, w FROM conversations, @unnest(@tok(text)) AS t(w)), k AS (SELECT DISTINCT w FROM documents, @unnest(@tok(text)) AS t(w)) SELECT v.conv_id, count(*) AS tokens, count(k.w) AS attested, round(count(k.w) * 1e0 / count(*), 8) AS coverage FROM v LEFT JOIN k ON k.w = v.w GROUP BY v.conv_id",
    # evaluation
    "score_report": f"SELECT lang, count(*) AS items, count(CASE WHEN n_chars >= 100 THEN 1 END) AS valid, round(avg(CASE WHEN n_chars >= 100 AND g = y THEN 1e0 ELSE 0e0 END), 8) AS intent_to_treat, round(avg(CASE WHEN n_chars >= 100 THEN CASE WHEN g = y THEN 1e0 ELSE 0e0 END END), 8) AS conditional FROM ({_JUDGED}) p GROUP BY lang",
    "paired_strict": f"SELECT count(*) AS users, count(CASE WHEN a.user_id IS NULL OR b.user_id IS NULL THEN 1 END) AS unmatched, CAST(sum(coalesce(a.n, 0) - coalesce(b.n, 0)) AS BIGINT) AS delta FROM (SELECT user_id, n FROM ({_TYPES}) x WHERE event_type = 'click') a FULL JOIN (SELECT user_id, n FROM ({_TYPES}) y WHERE event_type = 'purchase') b ON b.user_id = a.user_id",
    "attempt_audit": "SELECT u.c_custkey AS item, CASE WHEN o.n IS NULL THEN 'missing' WHEN o.n > 20 THEN 'too many' ELSE 'ok' END AS verdict FROM customer u LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = u.c_custkey",
    "capture_integrity": "SELECT l_orderkey, CAST(max(l_linenumber) AS BIGINT) AS expected, count(DISTINCT l_linenumber) AS found, count(*) - count(DISTINCT l_linenumber) AS repeated FROM lineitem GROUP BY l_orderkey",
    "aggregate_replay": "SELECT a.l_returnflag, CASE WHEN abs(a.m - b.s / b.n) < 0.0000001 THEN 1 ELSE 0 END AS same FROM (SELECT l_returnflag, avg(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag) a JOIN (SELECT l_returnflag, sum(p) AS s, sum(n) AS n FROM (SELECT l_returnflag, l_linestatus, sum(l_extendedprice) AS p, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus) x GROUP BY l_returnflag) b ON b.l_returnflag = a.l_returnflag",
    "error_taxonomy": f"SELECT kind, lang, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT lang, source, CASE WHEN g = 1 AND y = 0 THEN 'false positive' WHEN g = 0 AND y = 1 THEN 'false negative' END AS kind FROM ({_JUDGED}) j WHERE g <> y) p GROUP BY kind, lang",
    "paired_divergence": "WITH c AS (SELECT DISTINCT user_id, event_type, CASE WHEN @epoch(ts) % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM events), p AS (SELECT user_id, event_type, count(*) AS sides FROM c GROUP BY user_id, event_type) SELECT user_id, round(count(CASE WHEN sides = 2 THEN 1 END) * 1e0 / count(*), 8) AS jaccard, CASE WHEN count(CASE WHEN sides = 2 THEN 1 END) = count(*) THEN 1 ELSE 0 END AS identical FROM p GROUP BY user_id",
    "support_counts": "SELECT user_id, count(CASE WHEN event_type = 'view' THEN 1 END) AS views, count(CASE WHEN event_type = 'signup' THEN 1 END) AS signups, count(DISTINCT @day(ts)) AS days FROM events GROUP BY user_id",
    "priming_flags": "SELECT user_id, bool_or(event_type = 'error' AND value > 90) AND NOT bool_or(event_type = 'error' AND value < 1) AS primed, bool_and(value >= 0) AS valid FROM events WHERE value IS NOT NULL GROUP BY user_id",
    "progress_rollup": "SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 8) AS earned, CASE WHEN count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) = 0 THEN 'done' WHEN count(CASE WHEN o_orderstatus = 'F' THEN 1 END) = 0 THEN 'open' ELSE 'running' END AS state FROM orders GROUP BY o_orderpriority",
    "topk_recall": f"SELECT k, round(avg(CASE WHEN r.place <= k THEN 1e0 ELSE 0e0 END), 8) AS recall FROM ({_LAST}) l JOIN ({_RANKED}) r ON r.user_id = l.user_id AND r.event_type = l.event_type CROSS JOIN (SELECT * FROM (VALUES (1), (3), (5)) AS v(k)) k GROUP BY k",
    "mrr": f"SELECT round(avg(1e0 / r.place), 8) AS mrr, count(*) AS queries_ FROM ({_LAST}) l JOIN ({_RANKED}) r ON r.user_id = l.user_id AND r.event_type = l.event_type",
    "negative_log_likelihood": f"SELECT round(avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)), 8) AS nll FROM (SELECT y, least(greatest(n_chars / 4000e0, 0.01e0), 0.99e0) AS q FROM ({_JUDGED}) j) p",
    "selective_risk": f"SELECT count(*) AS n, count(CASE WHEN n_chars >= 500 THEN 1 END) AS answered, round(1 - avg(CASE WHEN n_chars >= 500 THEN CASE WHEN g = y THEN 1e0 ELSE 0e0 END END), 8) AS risk FROM ({_JUDGED}) p",
    "relative_drop": f"SELECT round((max(a) - min(a)) / max(a), 8) AS drop_, count(*) AS groups_ FROM (SELECT source, avg(CASE WHEN g = y THEN 1e0 ELSE 0e0 END) AS a, count(*) AS n FROM ({_JUDGED}) p GROUP BY source HAVING count(*) >= 5) t",
    "alternatives_size": f"SELECT round(avg(CASE WHEN hit = 1 THEN 1e0 ELSE 0e0 END), 8) AS coverage, round(avg(size_), 8) AS mean_size FROM (SELECT l.user_id, max(CASE WHEN t.event_type = l.event_type AND t.n >= 10 THEN 1 ELSE 0 END) AS hit, count(CASE WHEN t.n >= 10 THEN 1 END) AS size_ FROM ({_LAST}) l JOIN ({_TYPES}) t ON t.user_id = l.user_id GROUP BY l.user_id) x",
    "order_pair_accuracy": "SELECT user_id, round(avg(CASE WHEN value >= before THEN 1e0 ELSE 0e0 END), 8) AS in_order, count(*) AS pairs_ FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) t WHERE before IS NOT NULL AND value IS NOT NULL GROUP BY user_id",
    "exact_match_rate": "SELECT lang, count(*) AS n, round(avg(CASE WHEN copies > 1 THEN 1e0 ELSE 0e0 END), 8) AS exact_ FROM (SELECT lang, count(*) OVER (PARTITION BY @sha(text)) AS copies FROM documents) t GROUP BY lang",
    "average_precision": "SELECT lang, round(sum(CASE WHEN y = 1 THEN hits * 1e0 / place ELSE 0e0 END) / sum(y), 8) AS ap FROM (SELECT lang, y, row_number() OVER w AS place, sum(y) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM (" + _JUDGED + ") j WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id)) t GROUP BY lang HAVING sum(y) > 0",
    # ledger
    "ledger_pairs": f"WITH o AS ({_OUTCOMES}) SELECT d.event_id AS dispatch, c.event_id AS completion, c.event_type AS outcome FROM o d JOIN o c ON c.user_id = d.user_id AND c.k = d.k AND c.done = 1 WHERE d.done = 0",
    "ledger_interrupted": "WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'purchase')) SELECT d.event_id, d.user_id, 'interrupted' AS outcome FROM o d LEFT JOIN o c ON c.user_id = d.user_id AND c.k = d.k AND c.event_type = 'purchase' WHERE d.event_type = 'click' AND c.event_id IS NULL",
    "ledger_skips": "SELECT user_id, count(CASE WHEN event_type = 'view' THEN 1 END) AS skipped, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS dispatched, CASE WHEN count(CASE WHEN event_type = 'view' THEN 1 END) > 0 AND count(CASE WHEN event_type = 'click' THEN 1 END) > 0 THEN 1 ELSE 0 END AS both_ FROM events GROUP BY user_id",
    "ledger_resume": "SELECT user_id, event_type, min(event_id) AS kept, count(*) - 1 AS repeats FROM events GROUP BY user_id, event_type",
    "ledger_invariant": f"WITH o AS ({_OUTCOMES}) SELECT d.user_id, count(*) AS planned, count(CASE WHEN c.event_type = 'purchase' THEN 1 END) AS succeeded, count(CASE WHEN c.event_type = 'error' THEN 1 END) AS failed, count(CASE WHEN c.event_id IS NULL THEN 1 END) AS interrupted, CASE WHEN count(*) = count(CASE WHEN c.event_type = 'purchase' THEN 1 END) + count(CASE WHEN c.event_type = 'error' THEN 1 END) + count(CASE WHEN c.event_id IS NULL THEN 1 END) THEN 1 ELSE 0 END AS adds_up FROM o d LEFT JOIN o c ON c.user_id = d.user_id AND c.k = d.k AND c.done = 1 WHERE d.done = 0 GROUP BY d.user_id",
    "ledger_integrity": "SELECT user_id, count(*) AS n, count(DISTINCT event_id) AS ids, count(CASE WHEN before > event_id THEN 1 END) AS out_of_order, count(CASE WHEN @json(props, '$.k') IS NULL THEN 1 END) AS without_key FROM (SELECT user_id, event_id, props, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) t GROUP BY user_id",
    "evidence_manifest": "SELECT user_id, count(*) AS n, @sha(@ids(event_id)) AS digest FROM events GROUP BY user_id",
    # nested sources, small definitions
    "tree_leaves": "SELECT event_id, '$.k' AS path, 'number' AS kind, @json(props, '$.k') AS leaf FROM events WHERE props IS NOT NULL",
    "link_candidates": "SELECT DISTINCT @rx(url, '^(https?://[^/]+)', 1) AS origin, @rx(url, '[.]([a-z]+)/', 1) AS zone FROM pages",
    "license_lines": "SELECT doc_id, count(*) AS lines FROM documents, @unnest(@lines(text)) AS t(line) WHERE @re(lower(line), 'licen[sc]e|copyright|lizenz') GROUP BY doc_id",
    "alias_match": "SELECT p_partkey, p_type, p_name FROM part WHERE instr(@sub(lower(p_name), '[^a-z0-9]', ''), 'redring') > 0",
    "report_consistency": "SELECT o_orderkey, declared, found, CASE WHEN declared = found THEN 1 ELSE 0 END AS consistent FROM (SELECT o_orderkey, coalesce(max(l_linenumber), 0) AS declared, count(l_linenumber) AS found FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) t",
    "support_same_part": "SELECT source, count(DISTINCT CASE WHEN @fold5(source) = 0 THEN 'test' ELSE 'train' END) AS parts, count(*) AS docs FROM documents GROUP BY source",
    "candidate_rows": "SELECT 'document' AS kind, doc_id AS id, source AS origin, CAST(n_chars AS DOUBLE) AS size_ FROM documents UNION ALL SELECT 'page', page_id, @rx(url, '^https?://([^/]+)', 1), CAST(length(html) AS DOUBLE) FROM pages UNION ALL SELECT 'benchmark', item_id, 'benchmark', CAST(length(text) AS DOUBLE) FROM benchmark UNION ALL SELECT 'turn', conv_id * 1000 + turn, role, CAST(length(text) AS DOUBLE) FROM conversations",
    "taxonomy_check": "SELECT p_type, count(DISTINCT p_brand) AS codes, count(*) - count(DISTINCT p_partkey) AS repeated FROM part GROUP BY p_type",
    "suite_hashes": "SELECT conv_id, @sha(concat(coalesce(max(CASE WHEN role = 'system' THEN text END), ''), chr(10), coalesce(max(CASE WHEN turn = 1 THEN text END), ''))) AS prompt_sha256 FROM conversations GROUP BY conv_id",
    "demonstration_leak": "SELECT DISTINCT d.doc_id FROM (SELECT doc_id, @sha(trim(line)) AS h FROM documents, @unnest(@lines(text)) AS t(line)) d WHERE EXISTS (SELECT 1 FROM (SELECT @sha(trim(line)) AS h FROM benchmark, @unnest(@lines(text)) AS u(line)) b WHERE b.h = d.h)",
    "run_lock": "SELECT event_type, count(*) AS found, count(DISTINCT user_id) AS users, count(DISTINCT user_id) * 10 AS planned, CASE WHEN count(*) >= count(DISTINCT user_id) * 10 THEN 1 ELSE 0 END AS complete FROM events GROUP BY event_type",
    "corpus_census": "SELECT lang, count(*) AS docs, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT @sha(text)) AS texts FROM documents GROUP BY lang",
    "form_index": "SELECT w, @set(lang) AS langs, count(*) AS n FROM (SELECT DISTINCT w, lang, doc_id FROM documents, @unnest(@tok(text)) AS t(w)) x GROUP BY w",
    "identity_fingerprint": "SELECT doc_id, @sha(concat(CAST(doc_id AS STRING), '|', source, '|', lang)) AS fingerprint FROM documents",
    "alignment_rules": "SELECT conv_id, count(*) AS turns, CAST(max(turn) AS BIGINT) AS last_turn, CASE WHEN count(*) = max(turn) + 1 AND count(DISTINCT turn) = count(*) THEN 1 ELSE 0 END AS covered FROM conversations GROUP BY conv_id",
    "request_rules": "SELECT item_id, count(*) OVER (PARTITION BY @sha(text)) AS same_text, CASE WHEN length(trim(text)) = length(text) THEN 1 ELSE 0 END AS trimmed FROM benchmark",
    "release_sources": "SELECT d.doc_id, concat(CASE WHEN l.doc_id IS NULL THEN 'label;' ELSE '' END, CASE WHEN p.page_id IS NULL THEN 'page;' ELSE '' END, CASE WHEN c.conv_id IS NULL THEN 'conversation;' ELSE '' END, CASE WHEN v.vec_id IS NULL THEN 'vector;' ELSE '' END) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = d.doc_id LEFT JOIN embeddings v ON v.vec_id = d.doc_id",
    "source_census": "SELECT source, count(*) AS docs, count(DISTINCT @sha(text)) AS texts, max(n_chars) AS longest, count(CASE WHEN lang = 'en' THEN 1 END) AS english FROM documents GROUP BY source",
}
