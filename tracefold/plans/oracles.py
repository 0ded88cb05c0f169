"""The registered queries in plain SQL over the same tables, for an independent engine."""

from __future__ import annotations

from tracefold.plans.fold_sql import fold_sql

ORDERS = """SELECT CAST(o_custkey AS VARCHAR) case_id, o_orderstatus activity, o_orderdate event_time, o_orderkey arrival_seq FROM orders"""
USERS = """SELECT CAST(user_id AS VARCHAR) case_id, event_type activity, ts event_time, event_id arrival_seq FROM events"""
DAYS = """SELECT CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d') case_id, event_type activity, ts event_time, event_id arrival_seq FROM events"""


def _log(sql: str) -> str:
    return f"log AS ({sql})"


def _model(sql: str) -> str:
    return f"""
mlog AS ({sql}),
tr AS (SELECT case_id, min(arrival_seq) trace_id, list(activity ORDER BY event_time, arrival_seq) t, count(*) n FROM mlog GROUP BY case_id),
pre AS (SELECT case_id, trace_id, n, l AS level, t[:l] AS prefix, t[:l-1] AS parent, t[l] AS symbol
        FROM tr, unnest(range(1, n + 1)) u(l)),
nodes AS (SELECT prefix, any_value(parent) parent, any_value(level) AS level, any_value(symbol) symbol, min(trace_id) first_trace,
          count(*) n_traces, count(*) FILTER (level = n) n_ends, min(trace_id) FILTER (level = n) first_end,
          bool_or(level = n) is_end, min(n - level) min_to_end, max(n - level) max_to_end FROM pre GROUP BY prefix),
rooted AS (SELECT prefix, level, first_trace, is_end, min_to_end FROM nodes
           UNION ALL SELECT []::VARCHAR[], 0, min(trace_id), false, min(n) FROM tr),
ends AS (SELECT prefix, level, first_end FROM nodes WHERE is_end)"""


def _stream(sql: str, order: str = "event_time, arrival_seq") -> str:
    return f"""
log AS ({sql}),
st AS (SELECT case_id, list(activity ORDER BY {order}) t, list(arrival_seq ORDER BY {order}) s, count(*) n FROM log GROUP BY case_id),
spre AS (SELECT case_id, n, t, l AS level, t[:l] AS prefix, t[:l-1] AS parent, t[l] AS activity, s[l] AS arrival_seq FROM st, unnest(range(1, n + 1)) u(l))"""


PUBLISHED = """SELECT 'swap_{s}_' || case_id AS case_id, activity, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') || '+0000' AS time_text,
  'log_freqrandom__3_0.3' AS run_label, arrival_seq FROM log WHERE case_id <> 'test' AND length(activity) > 0"""

NODES = "SELECT first_trace, level, symbol, level - 1 AS p_level, n_traces, n_ends, first_end, is_end, min_to_end, max_to_end FROM nodes"

STATS = """SELECT v.leaf_visits, v.avg_len, m.* FROM
  (SELECT count(*) leaf_visits, CAST(floor(sum(p.level) / count(*)) AS BIGINT) avg_len FROM pre p JOIN ends e USING (prefix) WHERE p.trace_id >= e.first_end) v,
  (SELECT max(level) FILTER (is_end) max_len, min(level) FILTER (is_end) min_len, count(*) n_nodes, CAST(sum(n_traces) AS BIGINT) n_events,
   arg_min(first_end, level * 1000000000 + first_end) FILTER (is_end) shortest_trace FROM nodes) m"""

STRICT = """SELECT s.case_id, count(*) n_events, max(s.level) FILTER (d.prefix IS NOT NULL) matched,
  arg_max(d.first_trace, s.level) FILTER (d.prefix IS NOT NULL) first_trace, arg_max(d.is_end, s.level) FILTER (d.prefix IS NOT NULL) at_end
  FROM spre s LEFT JOIN nodes d ON s.prefix = d.prefix GROUP BY s.case_id"""

GRAMS = """grams AS (SELECT t[i:i+k-1] pattern, count(*) freq FROM tr, unnest(range(2, {k} + 1)) a(k), unnest(range(1, n + 1)) b(i)
  WHERE i + k - 1 <= n GROUP BY 1)"""

VARIANTS = "SELECT min(trace_id) first_trace, n AS level, count(*) n_traces FROM tr GROUP BY t, n"

# deterministic draws, as in the swap operator
DRAW = "((((({x} + {s}) % 2147483647 * 48271 + 11) % 2147483647) * ((({x} + {s}) % 2147483647 * 48271 + 11) % 2147483647)" \
       " + ((({x} + {s}) % 2147483647 * 48271 + 11) % 2147483647)) % 2147483647 * 16807 + {s}) % 2147483647"


def _draw(i: int) -> str:
    return DRAW.format(x="arrival_seq", s=f"(salt + {i})")


SWAPS = f"""
log AS ({USERS}),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY arrival_seq) idx FROM log),
kinds(setting, ppm, dist, salt) AS (VALUES ('01', 10000, 1, 1000), ('05', 50000, 5, 1010), ('10', 100000, 7, 1020),
  ('20', 200000, 10, 1030), ('50', 500000, 20, 1040), ('99', 990000, 99, 1050)),
asks0 AS (SELECT setting, case_id, idx i, arrival_seq i_seq, {_draw(4)} draw,
  idx + CASE WHEN {_draw(2)} % 2 = 0 THEN -(1 + {_draw(1)} % dist) ELSE 1 + {_draw(1)} % dist END AS j
  FROM rows_, kinds WHERE {_draw(3)} % 1000000 < ppm),
asks AS (SELECT a.*, r.arrival_seq j_seq, row_number() OVER (PARTITION BY setting ORDER BY draw, i_seq) rk
  FROM asks0 a JOIN rows_ r ON a.case_id = r.case_id AND a.j = r.idx),
touch AS (SELECT setting, i_seq seq, rk FROM asks UNION ALL SELECT setting, j_seq, rk FROM asks),
best AS (SELECT setting, seq, min(rk) rk FROM touch GROUP BY ALL),
won AS (SELECT a.* FROM asks a JOIN best x ON a.setting = x.setting AND a.i_seq = x.seq AND a.rk = x.rk
        JOIN best y ON a.setting = y.setting AND a.j_seq = y.seq AND a.rk = y.rk),
moves AS (SELECT setting, i_seq a, j_seq b FROM won UNION ALL SELECT setting, j_seq, i_seq FROM won),
swapped AS (SELECT k.setting, r.case_id, r.activity, r.event_time, coalesce(m.b, r.arrival_seq) arrival_seq
  FROM rows_ r CROSS JOIN kinds k LEFT JOIN moves m ON m.setting = k.setting AND m.a = r.arrival_seq)"""

SEEN = """seen AS (SELECT *, max((epoch_us(event_time) // 1000)) OVER (PARTITION BY case_id ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) seen_ms FROM log)"""

WRITTEN = "w AS (SELECT o_orderkey, o_orderstatus a, o_orderpriority b, substr(o_orderpriority, 1, 1) c FROM orders)"

RESULTS = """res AS (SELECT CAST(o_custkey AS VARCHAR) case_id, o_orderkey, CAST(floor(o_totalprice % 10) AS INTEGER) AS cost,
  CAST(floor(o_totalprice % 7) AS BIGINT) time_ms, epoch_ms(o_orderdate) t,
  (['ngrams','greedy','adaptive','non_adaptive','non_aware'])[o_custkey % 5 + 1] algo, (['00','01','05','10','20','50','99'])[o_custkey % 7 + 1] swap FROM orders),
named AS (SELECT *, 'output/orig/bpi2012__algo_' || algo || '__swap_' || swap || '_3_0.3_20240101_120000' filename FROM res),
cases AS (SELECT case_id, filename, 'bpi2012' dataset, algo, swap, CAST(sum(time_ms) AS BIGINT) total_time_ms, arg_max(cost, (t, o_orderkey)) AS cost, count(*) event_count
  FROM named GROUP BY case_id, filename, algo, swap),
lasts AS (SELECT n.* EXCLUDE (cost), c.cost AS last_cost FROM named n JOIN cases c USING (filename, case_id))"""


def _with(*parts: str) -> str:
    *ctes, body = parts
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


SQL: dict[str, str] = {
    "event_log_orders": _with(_log(ORDERS), PUBLISHED.format(s="00")),
    "event_log_events": _with(_log(DAYS), PUBLISHED.format(s="10")),
    "event_log_lineitem": """SELECT CAST(l_orderkey AS VARCHAR) case_id, count(*) n_events, count(DISTINCT l_returnflag || l_linestatus) n_activities,
  min(l_shipdate) first_time, max(l_shipdate) last_time FROM lineitem GROUP BY 1""",
    "parse_messages": _with(_log(USERS), "SELECT case_id, activity, (epoch_us(event_time) // 1000) event_ms, arrival_seq FROM log"),
    "alphabet_encode": _with(
        _log(DAYS),
        "dim AS (SELECT activity, 64 + row_number() OVER (ORDER BY min(arrival_seq)) symbol FROM log GROUP BY activity)",
        "SELECT case_id, arrival_seq, activity, symbol FROM log JOIN dim USING (activity)",
    ),
    "alphabet_decode": _with(
        _log(DAYS),
        "dim AS (SELECT activity, 64 + row_number() OVER (ORDER BY min(arrival_seq)) symbol FROM log GROUP BY activity)",
        "SELECT arrival_seq, symbol, activity AS label FROM log JOIN dim USING (activity)",
    ),
    "alphabet_list": _with(_log(ORDERS), "SELECT activity, 64 + row_number() OVER (ORDER BY min(arrival_seq)) symbol FROM log GROUP BY activity"),
    "unseen_activities": _with(
        _log(ORDERS), "SELECT case_id, activity, arrival_seq FROM log WHERE activity NOT IN (SELECT DISTINCT l_linestatus FROM lineitem)"
    ),
    "traces": _with(
        _model(ORDERS),
        "ix AS (SELECT case_id, row_number() OVER (ORDER BY trace_id) trace_idx FROM tr)",
        "SELECT case_id, trace_idx, level, symbol AS activity, n AS trace_len FROM pre JOIN ix USING (case_id)",
    ),
    "trace_text": _with(_model(USERS), "SELECT trace_id, case_id, array_to_string(t, '') trace FROM tr"),
    "variants_orders": _with(_model(ORDERS), VARIANTS),
    "variants_user_days": _with(_model(DAYS), VARIANTS),
    "model_nodes_orders": _with(_model(ORDERS), NODES),
    "model_nodes_users": _with(_model(USERS), NODES),
    "node_children": _with(
        _model(ORDERS),
        "SELECT r.first_trace, r.level, count(*) n_children, string_agg(k.symbol, ',' ORDER BY k.symbol) labels"
        " FROM nodes k JOIN rooted r ON k.parent = r.prefix GROUP BY 1, 2",
    ),
    "node_prefix_text": _with(_model(ORDERS), "SELECT first_trace, level, array_to_string(prefix, '->') prefix FROM nodes"),
    "linked_traces": _with(
        _model(ORDERS),
        "SELECT d.first_trace, p.level, p.trace_id FROM pre p JOIN nodes d USING (prefix) UNION ALL SELECT NULL, 0, trace_id FROM tr",
    ),
    "leaf_visits": _with(_model(ORDERS), "SELECT p.trace_id, p.level FROM pre p JOIN ends e USING (prefix) WHERE p.trace_id >= e.first_end"),
    "model_stats_orders": _with(_model(ORDERS), STATS),
    "model_stats_users": _with(_model(USERS), STATS),
    "ngram_counts": _with(_model(USERS), GRAMS.format(k=5), "SELECT array_to_string(pattern, ',') pattern, freq FROM grams"),
    "pattern_rank": _with(
        _model(ORDERS), GRAMS.format(k=10), "SELECT array_to_string(pattern, ',') pattern, len(pattern) n, freq FROM grams ORDER BY freq DESC, pattern"
    ),
    "leaves_below": _with(
        _model(USERS),
        "anc AS (SELECT e.first_end, e.level leaf_level, e.prefix[:l] prefix FROM ends e, unnest(range(1, e.level)) u(l))",
        "SELECT d.first_trace, d.level, count(*) n_leaves, min(a.leaf_level) nearest, min(a.first_end) first_leaf"
        " FROM anc a JOIN nodes d USING (prefix) WHERE a.leaf_level <= d.level + 40 GROUP BY 1, 2",
    ),
    "strict_replay": _with(_model(USERS), _stream(DAYS), STRICT),
    "strict_replay_arrival": _with(_model(ORDERS), _stream(ORDERS, "arrival_seq"), STRICT),
    "child_lookup": _with(
        _model(USERS), _stream(DAYS),
        "SELECT s.arrival_seq, s.level - 1 AS level, s.activity, d.first_trace child_trace, d.level child_level FROM spre s LEFT JOIN nodes d"
        " ON s.parent = d.parent AND s.activity = d.symbol",
    ),
    "complete_match": _with(
        _model(USERS), _stream(DAYS),
        "SELECT s.arrival_seq, s.level, array_to_string(s.t[s.level+1:s.level+3], ',') seq, len(s.t[:s.level+3]) m_level, m.first_trace match_trace"
        " FROM spre s JOIN nodes d ON s.prefix = d.prefix LEFT JOIN nodes m ON m.prefix = s.t[:s.level+3]",
    ),
    "match_in_hops": _with(
        _model(USERS),
        "SELECT s.first_trace, s.level, s.symbol evt, CAST(h AS INTEGER) hop, n.first_trace hit_trace, n.level hit_level"
        " FROM nodes n, unnest(range(1, 4)) u(h), nodes s WHERE n.level > h AND s.prefix = n.prefix[:n.level-h] AND n.symbol = s.symbol",
    ),
    "shortest_next": _with(
        _model(ORDERS),
        "kid AS (SELECT parent, arg_min({'s': symbol, 'e': is_end, 'm': min_to_end}, CASE WHEN is_end THEN '0' ELSE '1' END || printf('%09d', min_to_end) || symbol) k FROM nodes GROUP BY parent)",
        "SELECT r.first_trace, r.level, CASE WHEN k.e OR k.m < r.min_to_end THEN k.s END next_symbol FROM rooted r LEFT JOIN kid ON r.prefix = kid.parent",
    ),
    "closest_child": _with(
        _model(ORDERS),
        "SELECT r.first_trace, r.level, arg_min(k.symbol, printf('%09d', abs(k.min_to_end - 5)) || k.symbol) symbol, min(abs(k.min_to_end - 5)) gap"
        " FROM nodes k JOIN rooted r ON k.parent = r.prefix GROUP BY 1, 2",
    ),
    "tie_groups": _with(
        _log(ORDERS),
        "SELECT case_id, ts_ms, activity, arrival_seq, n_tied FROM (SELECT *, (epoch_us(event_time) // 1000) ts_ms,"
        " count(*) OVER (PARTITION BY case_id, (epoch_us(event_time) // 1000)) n_tied FROM log) WHERE n_tied > 1",
    ),
    "tie_order_ngrams": _with(
        _model(ORDERS), GRAMS.format(k=10),
        "bags AS (SELECT list_sort(pattern) bag, freq, pattern, row_number() OVER (PARTITION BY list_sort(pattern) ORDER BY freq DESC, pattern) r FROM grams)",
        "grp AS (SELECT case_id, (epoch_us(event_time) // 1000) ts_ms, count(*) n_tied, list(activity ORDER BY arrival_seq) g FROM mlog GROUP BY 1, 2 HAVING count(*) > 1)",
        "SELECT case_id, ts_ms, n_tied, array_to_string(g, ',') delivered, array_to_string(coalesce(b.pattern, g), ',') ordered, b.freq"
        " FROM grp LEFT JOIN bags b ON list_sort(g) = b.bag AND b.r = 1",
    ),
    "match_any_order": _with(
        _model(ORDERS), _stream(ORDERS),
        "grp AS (SELECT case_id, (epoch_us(event_time) // 1000) ts_ms, count(*) n, list_sort(list(activity)) bag, min(event_time) event_time FROM log GROUP BY 1, 2 HAVING count(*) > 1)",
        "plc AS (SELECT g.*, (SELECT count(*) FROM log l WHERE l.case_id = g.case_id AND l.event_time < g.event_time) lv FROM grp g)",
        "starts AS (SELECT case_id, ts_ms, n, bag, []::VARCHAR[] s FROM grp UNION ALL SELECT a.case_id, ts_ms, a.n, bag, t[:lv] FROM plc a JOIN st USING (case_id) WHERE lv > 0)",
        "SELECT g.case_id, g.ts_ms, len(g.s) s_level, d.level hit_level, d.first_trace FROM starts g JOIN nodes d"
        " ON d.level = len(g.s) + g.n AND d.prefix[:len(g.s)] = g.s AND list_sort(d.prefix[len(g.s)+1:]) = g.bag",
    ),
    "known_cases": "SELECT CAST(c_custkey AS VARCHAR) case_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "unknown_case_cost": _with(
        _model(USERS),
        "SELECT CAST(c_custkey AS VARCHAR) case_id, (SELECT min(level) FROM ends) AS cost FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    ),
    "parse_alignment": _with(
        WRITTEN,
        "SELECT o_orderkey, CAST(0 AS INTEGER) place, a AS log, a AS model, CAST(0 AS INTEGER) AS cost FROM w UNION ALL"
        " SELECT o_orderkey, 1, b, NULL, 1 FROM w UNION ALL SELECT o_orderkey, 2, NULL, c, 1 FROM w",
    ),
    "alignment_algebra": _with(
        WRITTEN,
        "SELECT o_orderkey, CAST(3 AS INTEGER) total_cost, CAST(3 AS INTEGER) trace_size, CAST(2 AS INTEGER) model_size, a || b || 'z' log_projection,"
        " a || c model_projection, '[logMove:' || a || ', modelMove:' || a || ', cost:0]|[logMove:' || b || ', modelMove:>>, cost:1]|[logMove:>>, modelMove:'"
        " || c || ', cost:1]|[logMove:z, modelMove:>>, cost:1]|' AS text FROM w",
    ),
    "alignment_decode": _with(
        _log(ORDERS),
        "SELECT arrival_seq, '[logMove:' || activity || ', modelMove:' || activity || ', cost:0]|[logMove:' || activity || ', modelMove:>>, cost:1]|' AS text FROM log",
    ),
    "late_flags": _with(
        _log(ORDERS), SEEN, "SELECT arrival_seq, seen_ms, (epoch_us(event_time) // 1000) < seen_ms late, (epoch_us(event_time) // 1000) <= seen_ms late_or_tied FROM seen"
    ),
    "replay_size": _with(
        _log(ORDERS),
        "SELECT b.arrival_seq, count(a.arrival_seq) replay FROM log b LEFT JOIN log a ON a.case_id = b.case_id AND a.arrival_seq < b.arrival_seq"
        " AND a.event_time > b.event_time GROUP BY b.arrival_seq",
    ),
    "event_time_order": _with(
        _log(ORDERS), "SELECT case_id, arrival_seq, activity, row_number() OVER (PARTITION BY case_id ORDER BY event_time, arrival_seq) pos FROM log"
    ),
    "ewma_multiplier": _with(
        _log(ORDERS), SEEN,
        "fl AS (SELECT arrival_seq, CASE WHEN seen_ms IS NULL THEN NULL WHEN (epoch_us(event_time) // 1000) < seen_ms THEN 1 ELSE 0 END flag FROM seen)",
        "ix AS (SELECT *, count(flag) OVER (ORDER BY arrival_seq) i FROM fl)",
        "sm AS (SELECT *, coalesce(sum(CAST(0.005 AS DOUBLE) * flag * pow(CAST(0.995 AS DOUBLE), -i)) OVER (ORDER BY arrival_seq), CAST(0 AS DOUBLE)) s FROM ix)",
        "mx AS (SELECT *, max(CAST(0.3 AS DOUBLE) * pow(CAST(0.995 AS DOUBLE), -i) - s) OVER (ORDER BY arrival_seq) g FROM sm)",
        "SELECT arrival_seq, CAST(flag AS INTEGER) flag, round(pow(CAST(0.995 AS DOUBLE), i) * (s + greatest(CAST(0.3 AS DOUBLE), g)), 6) multiplier FROM mx",
    ),
    "inject_disorder": _with(SWAPS, "SELECT setting, case_id, activity, epoch_us(event_time) event_us, arrival_seq FROM swapped"),
    "disorder_levels": _with(
        SWAPS,
        "fl AS (SELECT setting, (epoch_us(event_time) // 1000) < max((epoch_us(event_time) // 1000)) OVER (PARTITION BY setting, case_id ORDER BY arrival_seq"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) late FROM swapped)",
        "SELECT setting, count(*) FILTER (late) n_late, count(*) n_events FROM fl GROUP BY setting",
    ),
    "conforming_events": _with(
        _model(USERS), _stream(DAYS), "SELECT s.case_id, s.arrival_seq, count(d.prefix) OVER (PARTITION BY s.case_id ORDER BY s.level) matched,"
        " d.prefix IS NOT NULL conforms, true AS bounded FROM spre s LEFT JOIN nodes d ON s.prefix = d.prefix"
    ),
    "first_event_cost": _with(
        _model(USERS), _log(ORDERS),
        "SELECT case_id, CASE WHEN arg_min(activity, arrival_seq) IN (SELECT symbol FROM nodes WHERE level = 1) THEN CAST(0 AS BIGINT) ELSE 1 END AS cost FROM log GROUP BY case_id",
    ),
    "fold_flags": _with(
        _log(ORDERS), SEEN,
        "SELECT arrival_seq, CAST(CASE WHEN seen_ms IS NULL THEN NULL WHEN (epoch_us(event_time) // 1000) < seen_ms THEN 1 ELSE 0 END AS INTEGER) flag FROM seen",
    ),
    "alignment_invariants": _with(
        _log(DAYS),
        "SELECT arrival_seq, true AS cost_ok, true AS complete_cost_ok, true AS log_ok, true AS model_ok, true AS end_ok, row_number() OVER (PARTITION BY case_id ORDER BY arrival_seq) trace_size FROM log",
    ),
    "active_cases": _with(
        _log(DAYS),
        "SELECT * FROM (SELECT case_id, max(arrival_seq) last_seen, row_number() OVER (ORDER BY max(arrival_seq) DESC) recency FROM log GROUP BY case_id) WHERE recency <= 1000",
    ),
    "param_grid": _with(
        _log(USERS),
        "SELECT case_id, n_events, alpha, swap, CAST(r AS INTEGER) repetition FROM (SELECT case_id, count(*) n_events FROM log GROUP BY 1),"
        " (SELECT unnest([0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05]::DOUBLE[]) alpha), (SELECT unnest(['01', '10', '50']) swap), unnest(range(1, 4)) u(r)",
    ),
    "summary_case": _with(RESULTS, "SELECT case_id, filename, dataset, algo, swap, total_time_ms, cost, event_count FROM cases"),
    "summary_last_cost": _with(RESULTS, "SELECT case_id, o_orderkey, algo, swap, last_cost AS cost,"
        " CAST(row_number() OVER (PARTITION BY filename ORDER BY t, o_orderkey) AS INTEGER) rn FROM lasts"),
    "summary_setting": _with(
        RESULTS,
        "agg AS (SELECT dataset, algo, swap, CAST(sum(total_time_ms) AS BIGINT) total_time_ms, CAST(sum(cost) AS BIGINT) AS cost,"
        " CAST(sum(event_count) AS BIGINT) event_count, count(*) case_count FROM cases GROUP BY ALL)",
        "SELECT *, round(total_time_ms / event_count, 9) time_per_event_ms, round(cost / case_count, 9) cost_per_trace FROM agg",
    ),
}

EVENTS = "SELECT case_id, activity, arrival_seq, cost, n_states, open_events, flag, replayed, complete_cost FROM fold"
SQL |= {
    "conformance_none": fold_sql(EVENTS, ORDERS, ORDERS, aware=True, adaptive=True),
    "conformance_non_adaptive": fold_sql(EVENTS, ORDERS, ORDERS, aware=True, adaptive=False),
    "conformance_unaware": fold_sql(EVENTS, ORDERS, ORDERS, aware=False, adaptive=False),
    "conformance_user_days": fold_sql("SELECT case_id, activity, arrival_seq, cost, n_states, open_events, complete_cost FROM fold", DAYS, USERS, aware=True, adaptive=True),
    "complete_cost": fold_sql("SELECT case_id, arg_max(cost, arrival_seq) AS cost, arg_max(complete_cost, arrival_seq) AS complete_cost FROM fold GROUP BY case_id", ORDERS, ORDERS, aware=True, adaptive=True),
    "state_counts": fold_sql(
        "SELECT count(*) AS n_cases, sum(n_states)::BIGINT AS n_states, max(open_events) AS max_open_events FROM (SELECT arg_max(n_states, arrival_seq) AS n_states, arg_max(open_events, arrival_seq) AS open_events FROM fold GROUP BY case_id)",
        ORDERS, ORDERS, aware=True, adaptive=True,
    ),
}

# the states kept after the last event of a case, and the ends below them by the insert/delete distance of the open events and the way down
LEAVES = """
last_ AS (SELECT case_id, max(i) AS i FROM steps GROUP BY case_id),
kept AS (SELECT s.case_id, s.tail, s.cost + d.more + 1 AS most, unnest(s.gens) AS g FROM steps s JOIN last_ USING (case_id, i) JOIN ends d USING (case_id, i) WHERE redo = ''),
state AS (SELECT case_id, g.k AS open_events, unnest(g.nodes) AS node, g.cost AS base, right(tail, g.k) AS post, most - g.cost AS room FROM kept),
asked AS (SELECT DISTINCT node, post, room FROM state),
under AS (SELECT prefix[:l] AS node, prefix AS leaf FROM first_end, unnest(range(0, len(prefix))) u(l)),
pairs AS (SELECT *, list_transform(range(1, len(post) + 1), lambda x: ascii(post[x])) AS p FROM asked JOIN under USING (node) WHERE abs(len(leaf) - len(node) - len(post)) < room),
apart AS (SELECT node, post, room, leaf, list_reduce(
    list_concat([list_transform(range(0, len(post) + 1), lambda x: x::INTEGER)], list_transform(range(len(node) + 1, len(leaf) + 1), lambda x: [ascii(leaf[x])])),
    lambda r, c: list_transform(range(0, len(r)), lambda j: (j + list_min(list_transform(range(0, j + 1), lambda i: CASE WHEN i > 0 AND p[i] = c[1] THEN r[i] ELSE r[i + 1] + 1 END - i)))::INTEGER))[-1] AS d FROM pairs),
nearest AS (SELECT node, post, room, min((d, len(leaf))) AS best FROM apart WHERE d < room GROUP BY ALL)"""
SQL["best_leaf_search"] = fold_sql(
    """
SELECT case_id, open_events, (SELECT min(id) FROM mpre WHERE mpre.prefix = s.node) AS first_trace, len(node)::BIGINT AS level,
  (base + n.best[1])::INTEGER AS cost, n.best[2]::INTEGER AS leaf_level FROM state s JOIN nearest n USING (node, post, room)""",
    ORDERS, ORDERS, aware=True, adaptive=True, more=[LEAVES],
)
SQL["state_order"] = fold_sql(
    """
SELECT case_id, open_events, (SELECT min(id) FROM mpre WHERE mpre.prefix = s.node) AS first_trace, len(node)::BIGINT AS level, base AS cost,
  (rank() OVER (PARTITION BY case_id ORDER BY base))::INTEGER AS cost_rank FROM state s""",
    ORDERS, ORDERS, aware=True, adaptive=True, more=[LEAVES.split("asked AS")[0].rstrip().rstrip(",")],
)
SQL["message_rejects"] = _with(
    _log(USERS),
    """SELECT reason, count(*) AS n_messages, min(arrival_seq) AS first_seq, max(arrival_seq) AS last_seq
  FROM (SELECT arrival_seq, CASE WHEN arrival_seq % 50 IN (1, 2, 3) THEN 'no time' WHEN arrival_seq % 50 = 4 THEN 'no case' WHEN arrival_seq % 50 = 5 THEN 'no activity' END AS reason FROM log)
  WHERE reason IS NOT NULL GROUP BY reason""",
)
_LAST = "SELECT case_id, arg_max(cost, arrival_seq) AS cost, count(*) AS n FROM fold GROUP BY case_id"
SQL["experiment_files"] = "SELECT 'orders' AS dataset, algo, '00' AS swap, sum(cost)::BIGINT AS cost, sum(n)::BIGINT AS event_count, count(*) AS case_count, round(sum(cost) / count(*), 9) AS cost_per_trace FROM (" + " UNION ALL ".join(
    f"SELECT '{algo}' AS algo, * FROM ({fold_sql(_LAST, ORDERS, ORDERS, aware=aware, adaptive=adaptive)})" for algo, aware, adaptive in (("adaptive", True, True), ("non_adaptive", True, False), ("non_aware", False, False))
) + ") GROUP BY algo"
