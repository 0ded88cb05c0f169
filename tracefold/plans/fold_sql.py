"""The checker as recursive SQL over sets, for an independent engine: no tree walk, no budget, no memo.

A node of the model is the text of its prefix, one character per activity; a case is one row per step with its generations as a list.  Each round of the recursion
takes one event of every case that has any left: either the next one that was delivered or, behind a late one, the next to replay.  All continuations are listed and
the cheapest ones kept, so the text says what the result is and not how to find it quickly.
"""

from __future__ import annotations


def fold(log: str, model: str, aware: bool, adaptive: bool, min_decay: int = 3, multiplier: float = 0.3, alpha: float = 0.005) -> list[str]:
    """Parts of a WITH clause; the last one, ``fold``, has one row per event.  ``log`` and ``model`` are queries with the columns of a log."""
    if adaptive:  # closed form of m' = greatest(floor, alpha * flag + (1 - alpha) * m) over all flags in delivery order
        mult = f"""
flags AS (SELECT arrival_seq, seen_ms IS NOT NULL AS counts, CASE WHEN ts < seen_ms THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM
  (SELECT arrival_seq, ts, max(ts) OVER (PARTITION BY case_id ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_ms FROM ev0)),
counted AS (SELECT *, count(*) FILTER (counts) OVER (ORDER BY arrival_seq) AS t FROM flags),
summed AS (SELECT *, sum(CASE WHEN counts THEN {alpha}::DOUBLE * x * pow({1 - alpha}::DOUBLE, -t) ELSE 0::DOUBLE END) OVER (ORDER BY arrival_seq) AS s FROM counted),
mults AS (SELECT arrival_seq, round(pow({1 - alpha}::DOUBLE, t) * (s + greatest({multiplier}::DOUBLE, coalesce(max({multiplier}::DOUBLE * pow({1 - alpha}::DOUBLE, -t) - s) OVER (ORDER BY arrival_seq), {multiplier}::DOUBLE))), 12) AS mult FROM summed)"""
    else:
        mult = f"mults AS (SELECT arrival_seq, {multiplier}::DOUBLE AS mult FROM ev0)"
    life = lambda size: f"greatest(floor((avg_len - ({size})) * mult + 0.5)::INTEGER, {min_decay})"
    late = "len(times) > 0 AND ts < times[-1]" if aware else "false"
    return [
        f"""
mlog0 AS ({model}), log0 AS ({log}),
letters AS (SELECT activity, chr(64 + row_number() OVER (ORDER BY activity)::INTEGER) AS c FROM (SELECT activity FROM mlog0 UNION SELECT activity FROM log0)),
mtr AS (SELECT case_id, string_agg(c, '' ORDER BY event_time, arrival_seq) AS t, min(arrival_seq) AS id FROM mlog0 JOIN letters USING (activity) GROUP BY case_id),
mpre AS (SELECT t[:l] AS prefix, len(t) - l AS left_, id, l FROM mtr, unnest(range(0, len(t) + 1)) u(l)),
tree AS (SELECT prefix, min(left_) AS to_end FROM mpre GROUP BY prefix),
first_end AS (SELECT t AS prefix, min(id) AS id FROM mtr GROUP BY t),
size_ AS (SELECT sum(p.l) // count(*) AS avg_len FROM mpre p JOIN first_end e USING (prefix) WHERE p.id >= e.id AND p.l > 0),
ev0 AS (SELECT case_id, activity, c, epoch_us(event_time) // 1000 AS ts, arrival_seq, row_number() OVER (PARTITION BY case_id ORDER BY arrival_seq) AS i FROM log0 JOIN letters USING (activity)),
longest AS (SELECT max(i) AS n FROM ev0),
below AS (SELECT prefix[:l] AS above, prefix AS hit, len(prefix) - l AS deep FROM tree, longest, unnest(range(greatest(0, len(prefix) - 2 * n), len(prefix))) u(l))""",
        mult,
        "ev AS (SELECT * FROM ev0 JOIN mults USING (arrival_seq), size_)",
        f"""
steps AS (
  SELECT case_id, 0::BIGINT AS i, 0 AS size, 0 AS cost, ''::VARCHAR AS tail, []::BIGINT[] AS times, []::STRUCT(k INTEGER, cost INTEGER, decay INTEGER, nodes VARCHAR[])[] AS gens,
         ''::VARCHAR AS redo, []::BIGINT[] AS redo_t, 0::DOUBLE AS mult, NULL::INTEGER AS flag, 0 AS replayed FROM (SELECT DISTINCT case_id FROM ev0)
  UNION ALL
  (WITH arrived AS (
     SELECT s.case_id, e.i, s.size, s.tail, s.times, e.mult, e.avg_len, e.c, e.ts, {late} AS late,
            CASE WHEN s.i = 0 THEN [{{'k': 0, 'cost': 0, 'decay': greatest(floor(avg_len * e.mult + 0.5)::INTEGER, {min_decay}) + 1, 'nodes': ['']}}] ELSE s.gens END AS gens,
            CASE WHEN {'len(s.times) > 0' if aware else 'false'} THEN ({late})::INTEGER END AS flag
     FROM steps s JOIN ev e ON s.case_id = e.case_id AND e.i = s.i + 1 WHERE s.redo = ''),
   cut AS (SELECT *, CASE WHEN late THEN len(list_filter(times, lambda x: x > ts)) ELSE 0 END AS back FROM arrived),
   now AS (
     SELECT case_id, i, (size - back)::INTEGER AS size, tail[:len(tail) - back] AS tail, times[:len(times) - back] AS times, mult, avg_len, flag, (back + 1)::INTEGER AS replayed,
            list_transform(list_filter(gens, lambda g: g.k >= back), lambda g: {{'k': (g.k - back)::INTEGER, 'cost': g.cost, 'decay': g.decay, 'nodes': g.nodes}}) AS gens,
            c || tail[len(tail) - back + 1:] AS redo, list_concat([ts], times[len(times) - back + 1:]) AS redo_t FROM cut
     UNION ALL
     SELECT case_id, i, size, tail, times, mult, avg_len, flag, replayed, gens, redo, redo_t FROM steps, size_ WHERE redo <> ''),
   sync AS (SELECT q.case_id, list(to_) AS nodes, any_value(cost) AS cost
            FROM (SELECT case_id, gens[-1].cost AS cost, unnest(gens[-1].nodes) || redo[1] AS to_ FROM now WHERE len(gens) > 0 AND gens[-1].k = 0) q JOIN tree ON tree.prefix = q.to_ GROUP BY q.case_id),
   open_ AS (SELECT case_id, g.k, g.cost, unnest(g.nodes) AS node, right(tail, g.k) || redo[1] AS seq FROM (SELECT case_id, tail, redo, unnest(gens) AS g FROM now ANTI JOIN sync USING (case_id))),
   moves AS (SELECT case_id, cost, node, seq, hit, deep, given_up, deep - (len(seq) - given_up) AS skipped
             FROM (SELECT *, unnest(range(0, len(seq))) AS given_up FROM open_) o JOIN below b ON b.above = o.node
             WHERE deep - (len(seq) - given_up) BETWEEN 1 AND len(seq) - given_up AND right(hit, len(seq) - given_up) = right(seq, len(seq) - given_up)),
   first_ AS (SELECT case_id, node, seq, min((given_up, skipped)) AS at FROM moves GROUP BY ALL),
   led AS (SELECT m.case_id, m.cost, m.seq, m.hit, m.deep, list_max(list_filter(range(0, least(len(m.seq), m.deep) + 1), lambda l: right(m.hit, l) = right(m.seq, l))) AS same
           FROM moves m JOIN first_ f ON m.case_id = f.case_id AND m.node = f.node AND m.seq = f.seq AND (m.given_up, m.skipped) = f.at),
   options AS (SELECT case_id, node AS to_, cost + len(seq) AS cost FROM open_ UNION ALL SELECT case_id, hit, cost + len(seq) + deep - 2 * same FROM led),
   least_ AS (SELECT case_id, min(cost) AS cost FROM options GROUP BY case_id),
   best AS (SELECT case_id, list(DISTINCT to_) AS nodes, any_value(cost) AS cost FROM options JOIN least_ USING (case_id, cost) GROUP BY case_id UNION ALL SELECT case_id, nodes, cost FROM sync),
   grown AS (
     SELECT n.case_id, i, (size + 1)::INTEGER AS size, b.cost::INTEGER AS cost, tail || redo[1] AS tail, list_append(times, redo_t[1]) AS times, redo[2:] AS redo, redo_t[2:] AS redo_t, mult, flag, replayed,
            list_append(list_transform(list_filter(gens, lambda g: g.decay >= 2), lambda g: {{'k': (g.k + 1)::INTEGER, 'cost': g.cost, 'decay': (g.decay - (CASE WHEN len(redo) = 1 THEN 1 ELSE 0 END))::INTEGER, 'nodes': g.nodes}}),
                        {{'k': 0, 'cost': b.cost::INTEGER, 'decay': {life('size + 1')}, 'nodes': b.nodes}}) AS gens
     FROM now n JOIN best b USING (case_id))
   SELECT case_id, i, size, cost, CASE WHEN redo = '' THEN right(tail, gens[1].k) ELSE tail END, CASE WHEN redo = '' THEN times[len(times) - gens[1].k + 1:] ELSE times END,
          gens, redo, redo_t, mult, flag, replayed FROM grown)
)""",
        """
ends AS (SELECT case_id, i, min(to_end) AS more FROM (SELECT case_id, i, unnest(gens[-1].nodes) AS prefix FROM steps WHERE redo = '' AND i > 0) JOIN tree USING (prefix) GROUP BY case_id, i),
fold AS (SELECT s.case_id, e.activity, e.arrival_seq, s.cost, list_sum(list_transform(gens, lambda g: len(g.nodes)))::INTEGER AS n_states, gens[1].k AS open_events, s.flag, s.replayed,
                (s.cost + d.more)::INTEGER AS complete_cost
         FROM steps s JOIN ev0 e ON s.case_id = e.case_id AND s.i = e.i JOIN ends d ON s.case_id = d.case_id AND s.i = d.i WHERE s.redo = '')""",
    ]


def fold_sql(body: str, *args, more: list[str] | None = None, **kwargs) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in [*fold(*args, **kwargs), *(more or [])]) + "\n" + body
