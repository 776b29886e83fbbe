"""Named queries: SQL that both engines read, in which a few words stand for what they spell apart.

``@unnest(x)``: rows of an array; ``@tok(x)``: folded words; ``@sha(x)``: sha256 in hex; ``@fold(x, n)``:
hash fold; ``@day(x)``: date of a timestamp as text. Everything computed is named, rounded where sums
of doubles could differ, and cast where the engines' types do."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import rules
from lodestar.sources.tables import TABLES, views

_SPARK = {
    "unnest": "LATERAL explode($)",
    "tok": r"regexp_extract_all(replace(lower($), 'ß', 'ss'), '([\\p{L}\\p{N}]+)', 1)",
    "sha": "sha2($, 256)",
    "fold5": "CAST(conv(substr(sha2($, 256), 1, 12), 16, 10) AS BIGINT) % 5",
    "boot": "CAST(conv(substr(sha2($, 256), 1, 12), 16, 10) AS BIGINT)",
    "day": "date_format($, 'yyyy-MM-dd')",
    "epoch": "CAST(floor(unix_micros(CAST($ AS TIMESTAMP)) / 1000000) AS BIGINT)",
    "len": "size($)",
    "join": "array_join($, ' ')",
    "two": "array($, $ - 1)",
    "last": "last_value($) IGNORE NULLS",
    "digits": "regexp_replace($, '[0-9]+', '#')",
    "re": "regexp_like($)",
    "rx": "regexp_extract($)",
    "sub": "regexp_replace($)",
    "json": "get_json_object($)",
    "raise": "CAST(raise_error($) AS STRING)",
    "gid": "grouping_id($)",
    "set": "array_join(sort_array(collect_set($)), ',')",
    "ids": "array_join(transform(sort_array(collect_list($)), x -> CAST(x AS STRING)), ',')",
    "pair2": "array($)",
    "lines": "split($, chr(10))",
    "uniq": "array_distinct($)",
    "nonempty": "nullif($, '')",
    "longer": "filter($, x -> length(x) > 5)",
    "grams": "transform(sequence(1, greatest(size($) - 4, 1)), i -> array_join(slice($, i, 5), ' '))",
}
_DUCK = {
    "unnest": "unnest($)",
    "tok": r"regexp_extract_all(replace(lower($), 'ß', 'ss'), '[\p{L}\p{N}]+')",
    "sha": "sha256($)",
    "fold5": "CAST(('0x' || substr(sha256($), 1, 12)) AS BIGINT) % 5",
    "boot": "CAST(('0x' || substr(sha256($), 1, 12)) AS BIGINT)",
    "day": "strftime($, '%Y-%m-%d')",
    "epoch": "CAST(floor(epoch($)) AS BIGINT)",
    "len": "len($)",
    "join": "array_to_string($, ' ')",
    "two": "[$, $ - 1]",
    "last": "last_value($ IGNORE NULLS)",
    "digits": "regexp_replace($, '[0-9]+', '#', 'g')",
    "re": "regexp_matches($)",
    "rx": "regexp_extract($)",
    "sub": "regexp_replace($, 'g')",
    "json": "json_extract_string($)",
    "raise": "error($)",
    "gid": "grouping($)",
    "set": "array_to_string(list_sort(list(DISTINCT $)), ',')",
    "ids": "array_to_string(list_sort(list($)), ',')",
    "pair2": "[$]",
    "lines": "string_split($, chr(10))",
    "uniq": "list_distinct($)",
    "nonempty": "nullif($, '')",
    "longer": "[x FOR x IN $ IF length(x) > 5]",
    "grams": "[array_to_string(($)[i : i + 4], ' ') FOR i IN generate_series(1, greatest(len($) - 4, 1))]",
}


def _written(sql: str, words: dict[str, str]) -> str:
    """sql with each @word(x) spelled out, innermost first."""
    while m := re.search(r"@(\w+)\(", sql):
        m = [*re.finditer(r"@(\w+)\(", sql)][-1]
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[: m.start()] + words[m[1]].replace("$", sql[m.end() : end - 1]) + sql[end:]
    return sql


REV = "l_extendedprice * (1 - l_discount)"
SQL: dict[str, str] = {
    # joins
    "join_inner_orders_customer": "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000",
    "join_left_labels": "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "join_right_nation": "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "join_full_keys": "SELECT c.c_nationkey AS customer_nation, s.s_nationkey AS supplier_nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) s ON c.c_nationkey = s.s_nationkey",
    "join_semi_customers_with_orders": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_anti_customers_without_orders": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "join_cross_region_segment": "SELECT r_name, s.c_mktsegment FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s",
    "join_theta_price_band": "SELECT b.band, count(*) AS parts FROM part JOIN (SELECT * FROM (VALUES ('low', 0, 1000), ('mid', 1000, 1500), ('high', 1500, 1000000)) AS t(band, lo, hi)) b ON p_retailprice >= b.lo AND p_retailprice < b.hi GROUP BY b.band",
    "join_range_ship_window": "SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL '30' DAY GROUP BY o_orderkey",
    "join_broadcast_dim": "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "join_asof_last_event": "SELECT event_id, prev_id, prev_value FROM (SELECT event_id, event_type, @last(CASE WHEN event_type = 'click' THEN event_id END) OVER w AS prev_id, @last(CASE WHEN event_type = 'click' THEN value END) OVER w AS prev_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) t WHERE event_type = 'purchase'",
    "join_self_turns": "SELECT a.conv_id, a.turn, b.role AS next_role FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1",
    # aggregation
    "agg_revenue_by_flag": f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({REV}), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_distinct_parts": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": "SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "agg_filter_clause": "SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS longer FROM documents GROUP BY lang",
    "agg_percentile": "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90 FROM events GROUP BY event_type",
    "agg_stddev_regr": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_tax), 8) AS var, round(corr(l_quantity, l_extendedprice), 6) AS cor, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag",
    "agg_min_max_by": "SELECT o_custkey, max_by(o_orderkey, round(o_totalprice * 100) * 10000000 + o_orderkey) AS dearest, min_by(o_orderkey, round(o_totalprice * 100) * 10000000 + o_orderkey) AS cheapest FROM orders GROUP BY o_custkey",
    # windows and order
    "win_row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders",
    "win_rank_dense": "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dr FROM part",
    "win_ntile": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quartile FROM customer",
    "win_lag_lead": "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "win_first_last": "SELECT event_id, first_value(event_type) OVER w AS first_type, last_value(event_type) OVER w AS last_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_running_sum_rows": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "win_moving_avg_rows": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving FROM events",
    "win_range_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY @epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day FROM events",
    "win_percent_rank": "SELECT s_suppkey, round(percent_rank() OVER (ORDER BY s_acctbal, s_suppkey), 6) AS pr, round(cume_dist() OVER (ORDER BY s_acctbal, s_suppkey), 6) AS cd FROM supplier",
    "topk_customers": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25",
    "topk_per_group": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3",
    # set operations and reshaping
    "set_union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "set_union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'",
    "set_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48",
    "pivot_status": "SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM orders GROUP BY o_orderpriority",
    "unpivot_amounts": "SELECT l_orderkey, l_linenumber, 'discount' AS kind, l_discount AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem",
    "subquery_scalar": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.5 FROM customer)",
    "subquery_in": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%')",
    "cte_multi": f"WITH r AS (SELECT l_suppkey, sum({REV}) AS rev FROM lineitem GROUP BY l_suppkey), m AS (SELECT max(rev) AS top FROM r) SELECT l_suppkey, round(rev, 2) AS revenue FROM r CROSS JOIN m WHERE rev >= 0.9 * top",
    # scalar functions
    "fn_string": "SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS BIGINT) AS n, substr(p_type, 1, 5) AS head, replace(p_brand, 'Brand', 'B') AS brand, concat(p_brand, '/', p_type) AS both_ FROM part",
    "fn_regex": "SELECT page_id, @digits(url) AS shape, CASE WHEN url LIKE 'https%' THEN 1 ELSE 0 END AS secure FROM pages",
    "fn_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, @day(o_orderdate) AS d FROM orders",
    "fn_math": "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS root, round(ln(l_extendedprice), 6) AS log_price, CAST(floor(l_extendedprice) AS BIGINT) AS low, abs(l_discount - l_tax) AS gap FROM lineitem",
    "fn_array_hof": "SELECT doc_id, CAST(@len(@longer(@tok(text))) AS BIGINT) AS long_words, CAST(@len(@uniq(@tok(text))) AS BIGINT) AS types FROM documents",
    "fn_json": "SELECT event_id, CAST(@json(props, '$.k') AS BIGINT) AS k, CASE WHEN @json(props, '$.none') IS NULL THEN 1 ELSE 0 END AS absent FROM events WHERE props IS NOT NULL",
    # text
    "word_counts": "SELECT w, count(*) AS n FROM documents, @unnest(@tok(text)) AS t(w) GROUP BY w",
    "vocab_by_lang": "SELECT lang, count(*) AS tokens, count(DISTINCT w) AS types FROM documents, @unnest(@tok(text)) AS t(w) GROUP BY lang",
    "normalize_compare": "SELECT doc_id, @sha(@join(@tok(text))) AS norm FROM documents",
    "normalization_collisions": "SELECT norm, count(DISTINCT line) AS forms, min(line) AS first_form FROM (SELECT line, @sha(@join(@tok(line))) AS norm FROM documents, @unnest(@lines(text)) AS t(line)) x GROUP BY norm HAVING count(DISTINCT line) > 1",
    "abstention_flags": "SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' OR lower(trim(text)) IN ('n/a', 'unknown', '[?]', 'none') THEN 1 ELSE 0 END AS abstains FROM conversations",
    "repetition_flags": "SELECT doc_id, max(n) AS most, count(*) AS types, sum(n) AS tokens FROM (SELECT doc_id, w, CAST(count(*) AS BIGINT) AS n FROM documents, @unnest(@tok(text)) AS t(w) GROUP BY doc_id, w) x GROUP BY doc_id".replace("sum(n)", "CAST(sum(n) AS BIGINT)"),
    "word_multiset_f1_turns": "WITH c AS (SELECT conv_id, turn, w, count(*) AS n FROM conversations, @unnest(@tok(text)) AS t(w) GROUP BY conv_id, turn, w), s AS (SELECT conv_id, turn, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY conv_id, turn), o AS (SELECT a.conv_id, a.turn, CAST(sum(least(a.n, b.n)) AS BIGINT) AS common FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.w = a.w GROUP BY a.conv_id, a.turn) SELECT x.conv_id, x.turn, coalesce(o.common, 0) AS common, round(2e0 * coalesce(o.common, 0) / (x.total + y.total), 8) AS f1 FROM s x JOIN s y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 LEFT JOIN o ON o.conv_id = x.conv_id AND o.turn = x.turn",
    "jaccard_tokens_turns": "WITH c AS (SELECT DISTINCT conv_id, turn, w FROM conversations, @unnest(@tok(text)) AS t(w)), s AS (SELECT conv_id, turn, count(*) AS n FROM c GROUP BY conv_id, turn), o AS (SELECT a.conv_id, a.turn, count(*) AS k FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.w = a.w GROUP BY a.conv_id, a.turn) SELECT x.conv_id, x.turn, round(coalesce(o.k, 0) * 1e0 / (x.n + y.n - coalesce(o.k, 0)), 8) AS jaccard FROM s x JOIN s y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 LEFT JOIN o ON o.conv_id = x.conv_id AND o.turn = x.turn",
    "suffix_backoff_votes": "SELECT suffix, lang, n FROM (SELECT suffix, lang, n, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, lang) AS rn FROM (SELECT right(w, 3) AS suffix, lang, count(*) AS n FROM documents, @unnest(@tok(text)) AS t(w) WHERE length(w) >= 3 GROUP BY right(w, 3), lang) a) b WHERE rn = 1",
    "tfidf_document_frequency": "SELECT w, df, round(ln((SELECT count(*) FROM documents) * 1e0 / df), 8) AS idf FROM (SELECT w, count(DISTINCT doc_id) AS df FROM documents, @unnest(@tok(text)) AS t(w) GROUP BY w) x",
    # splits and safety
    "hash_fold": "SELECT doc_id, @fold5(CAST(doc_id AS STRING)) AS fold FROM documents",
    "hash_rank_cohort": "SELECT source, doc_id, rn FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY @sha(concat('cohort|', CAST(doc_id AS STRING))), doc_id) AS BIGINT) AS rn FROM documents) t WHERE rn <= 5",
    "holdout_by_source": "SELECT doc_id, CASE WHEN source IN ('src3', 'src7') THEN 'test' WHEN @fold5(source) = 0 THEN 'dev' ELSE 'train' END AS part FROM documents",
    "round_robin_select": "SELECT doc_id, turn FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY rn, source, doc_id) AS BIGINT) AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) t) u WHERE turn <= 100",
    "exact_dedup": "SELECT min(doc_id) AS keeper, count(*) AS copies FROM documents GROUP BY @sha(text) HAVING count(*) > 1",
    "benchmark_ngram_overlap": "WITH d AS (SELECT DISTINCT doc_id, @sha(g) AS g FROM (SELECT doc_id, @tok(text) AS words_ FROM documents) x, @unnest(@grams(words_)) AS t(g)), b AS (SELECT DISTINCT item_id, @sha(g) AS g FROM (SELECT item_id, @tok(text) AS words_ FROM benchmark) y, @unnest(@grams(words_)) AS t(g)), n AS (SELECT item_id, count(*) AS grams FROM b GROUP BY item_id) SELECT d.doc_id, b.item_id, count(*) AS shared, max(n.grams) AS grams FROM d JOIN b ON b.g = d.g JOIN n ON n.item_id = b.item_id GROUP BY d.doc_id, b.item_id",
    "split_random_contamination": "SELECT count(*) AS texts, count(CASE WHEN parts > 1 THEN 1 END) AS contaminated FROM (SELECT @sha(text) AS h, count(DISTINCT CASE WHEN @fold5(CAST(doc_id AS STRING)) = 0 THEN 1 ELSE 0 END) AS parts FROM documents GROUP BY @sha(text)) t",
    # evaluation
    "macro_vs_micro": "SELECT round(avg(f), 8) AS macro, round(sum(hit) * 1e0 / sum(n), 8) AS micro FROM (SELECT source, avg(CAST(toxic AS DOUBLE)) AS f, sum(toxic) AS hit, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source) t",
    "confusion": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic",
    "class_macro_f1": "WITH p AS (SELECT l.quality AS y, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS g FROM labels l JOIN documents d ON d.doc_id = l.doc_id), c AS (SELECT k, count(CASE WHEN y = k AND g = k THEN 1 END) AS tp, count(CASE WHEN y <> k AND g = k THEN 1 END) AS fp, count(CASE WHEN y = k AND g <> k THEN 1 END) AS fn FROM p CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) s GROUP BY k) SELECT k, tp, fp, fn, round(2e0 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c",
    "two_level_mean": "SELECT event_type, round(avg(m), 8) AS score, count(*) AS users FROM (SELECT event_type, user_id, avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY event_type, user_id) t GROUP BY event_type",
    "coverage_rates": "SELECT d.source, count(*) AS docs, count(l.doc_id) AS labelled, round(count(l.doc_id) * 1e0 / count(*), 8) AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source",
    "worst_group": "SELECT source, rate FROM (SELECT d.source, round(avg(CAST(l.quality AS DOUBLE)), 8) AS rate FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source) t ORDER BY rate, source LIMIT 1",
    "brier_ece": "WITH p AS (SELECT l.quality AS y, least(d.n_chars / 4000.0, 1.0) AS q FROM labels l JOIN documents d ON d.doc_id = l.doc_id), b AS (SELECT least(CAST(floor(q * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(CAST(y AS DOUBLE)) AS acc, avg(CAST(q AS DOUBLE)) AS conf FROM p GROUP BY least(CAST(floor(q * 10) AS BIGINT), 9)) SELECT (SELECT round(avg(CAST((q - y) * (q - y) AS DOUBLE)), 6) FROM p) AS brier, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b",
    "risk_coverage": "SELECT doc_id, CAST(row_number() OVER w AS BIGINT) AS taken, round(avg(CAST(1 - quality AS DOUBLE)) OVER (ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS risk FROM (SELECT l.doc_id, l.quality, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id) t WINDOW w AS (ORDER BY n_chars DESC, doc_id)",
    "paired_delta": "SELECT a.event_type AS type, count(*) AS users, round(avg(a.m - b.m), 8) AS delta FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY event_type, user_id) a JOIN (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id) b ON a.user_id = b.user_id GROUP BY a.event_type",
    "ratio_bootstrap": "WITH g AS (SELECT c_nationkey AS g, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS a, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS b, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey), c AS (SELECT a, b, n, CAST(row_number() OVER (ORDER BY g) AS BIGINT) - 1 AS i, count(*) OVER () AS k FROM g), r AS (SELECT t.b AS rep, @boot(concat(CAST(t.b AS STRING), ',', CAST(c.i AS STRING))) % c.k AS pick FROM c CROSS JOIN (SELECT * FROM @replicates) t), s AS (SELECT r.rep, CAST(sum(c.a) - sum(c.b) AS DOUBLE) / sum(c.n) AS diff FROM r JOIN c ON c.i = r.pick GROUP BY r.rep), o AS (SELECT diff, row_number() OVER (ORDER BY diff) AS rn FROM s) SELECT round((SELECT CAST(sum(a) - sum(b) AS DOUBLE) / sum(n) FROM g), 8) AS estimate, round(min(CASE WHEN rn = 50 THEN diff END), 8) AS lo, round(min(CASE WHEN rn = 1950 THEN diff END), 8) AS hi FROM o",
    "bootstrap_ci": "WITH c AS (SELECT user_id, avg(value) AS m, CAST(row_number() OVER (ORDER BY user_id) AS BIGINT) - 1 AS i, count(*) OVER () AS k FROM events GROUP BY user_id), r AS (SELECT b.b, c.k, @boot(concat(CAST(b.b AS STRING), ',', CAST(c.i AS STRING))) % c.k AS pick FROM c CROSS JOIN (SELECT * FROM @range) b), s AS (SELECT r.b, avg(c.m) AS mean FROM r JOIN c ON c.i = r.pick GROUP BY r.b), o AS (SELECT mean, row_number() OVER (ORDER BY mean) AS rn FROM s) SELECT round(min(CASE WHEN rn = 6 THEN mean END), 6) AS lo, round(min(CASE WHEN rn = 195 THEN mean END), 6) AS hi FROM o",
    # events
    "tumbling": "SELECT @day(ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY @day(ts), event_type",
    "sessionize": "SELECT user_id, session, count(*) AS n, min(s) AS began, max(s) AS ended FROM (SELECT user_id, s, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM (SELECT user_id, event_id, @epoch(ts) AS s, CASE WHEN @epoch(ts) - lag(@epoch(ts)) OVER (PARTITION BY user_id ORDER BY @epoch(ts), event_id) <= 14400 THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, session".replace("sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)"),
    "sliding": "SELECT CAST(h AS BIGINT) AS hour_block, count(*) AS n FROM (SELECT CAST(floor(@epoch(ts) / 43200.0) AS BIGINT) AS k FROM events) e, @unnest(@two(k)) AS t(h) GROUP BY h",
    "ledger_accounting": "SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS planned, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS succeeded, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed FROM events GROUP BY user_id",
    "ledger_orphans": "SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, count(CASE WHEN event_type = 'click' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM events) t WHERE event_type = 'purchase' AND seen = 0",
    # quality
    "dq_violations": "SELECT 'documents' AS tab, 'n_chars' AS rule, count(*) AS rows_ FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'lineitem', 'discount', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1 UNION ALL SELECT 'events', 'value', count(*) FROM events WHERE value IS NULL OR value < 0 UNION ALL SELECT 'labels', 'binary', count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)",
    "fk_anti": "SELECT 'labels' AS child, count(*) AS missing FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) UNION ALL SELECT 'orders', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)",
    "pk_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "monotone_ts": "SELECT count(*) AS backward FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) t WHERE ts < before",
}
SQL |= rules.SQL


def spark_sql(name: str) -> str:
    return _written(SQL[name].replace("@range", "(SELECT id AS b FROM range(0, 200))").replace("@replicates", "(SELECT id AS b FROM range(0, 2000))"), _SPARK)


def duck_sql(name: str) -> str:
    sql = SQL[name].replace("@range", "(SELECT range AS b FROM range(0, 200))").replace("@replicates", "(SELECT range AS b FROM range(0, 2000))").replace("AS STRING)", "AS VARCHAR)")
    return _written(sql, _DUCK)


def _run(name: str, spark: SparkSession, root: str) -> DataFrame:
    sql = spark_sql(name)
    views(spark, root, [t for t in TABLES if re.search(rf"\b{t}\b", sql)])
    return spark.sql(sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, name) for name in SQL}


def oracle_sql() -> dict[str, str]:
    return {name: duck_sql(name) for name in SQL}
