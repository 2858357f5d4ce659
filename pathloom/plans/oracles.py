"""DuckDB SQL that gives the same rows as the queries of the catalog."""

from __future__ import annotations

from pathloom.operators.graph import PALETTE

_PAIRS = """pairs AS (
 SELECT 'talk' AS src, conv_id * 1000 + turn AS id, text AS question, answer FROM (
  SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)
 WHERE role = 'user' AND next_role = 'assistant'
 UNION ALL SELECT 'document', doc_id, 'Is document ' || doc_id || ' in ' || lang, text FROM documents
 UNION ALL SELECT 'source', doc_id, source, text FROM documents
 UNION ALL SELECT 'item', item_id, 'What does item ' || item_id || ' say?', text FROM benchmark
 UNION ALL SELECT 'part', p_partkey, 'How would you describe part ' || p_partkey || '?', 'A ' || p_name || '.' FROM part
 UNION ALL SELECT 'brand', p_partkey, 'Explain part ' || p_partkey, 'It is a ' || p_name || ' of type ' || p_type || ' made by ' || p_brand || ' in size ' || p_size FROM part
 UNION ALL SELECT 'event', event_id, 'Did event ' || event_id || ' come up?', CASE event_type WHEN 'click' THEN ' Yes. ' WHEN 'error' THEN 'Maybe!?' WHEN 'view' THEN 'I don''t know...' ELSE event_type END FROM events
 UNION ALL SELECT 'nation', n_nationkey, 'Explain the nation ' || n_name, ' ' || chr(10) || ' ' FROM nation)"""


def _scores(least: str = "20", threshold: str = "0.7") -> str:
    """CTEs pairs, parts and scored."""
    return f"""{_PAIRS},
stripped AS (SELECT *, regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS q, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS a FROM pairs),
parts AS (SELECT *, CASE WHEN question IS NULL OR answer IS NULL THEN 'missing' WHEN q = '' OR a = '' THEN 'empty' WHEN length(q) < 10 THEN 'short_question'
  WHEN trim(lower(a), '.,!? ') IN ('yes', 'no', 'i don''t know', 'not sure', 'maybe') THEN 'generic_answer' END AS hard,
 CASE WHEN a = '' THEN 0 ELSE len(regexp_split_to_array(a, '\\s+')) END AS words FROM stripped),
marks AS (SELECT *, CASE WHEN words BETWEEN {least} AND 500 THEN 0.4::DOUBLE WHEN words > 500 THEN 0.35::DOUBLE WHEN words >= 10 THEN 0.4::DOUBLE * (words::DOUBLE / {least}::DOUBLE) ELSE 0.0::DOUBLE END AS l,
 CASE WHEN contains(q, '?') THEN 0.3::DOUBLE WHEN regexp_matches(lower(q), '^(what|how|why|when|where|who|which|can|is|does|do)') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS f,
 CASE WHEN length(a) >= 50 AND regexp_matches(a, '[.!?]') THEN 0.3::DOUBLE WHEN length(a) >= 30 THEN 0.2::DOUBLE WHEN length(a) >= 20 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS s FROM parts),
scored AS (SELECT src, id, question, answer, CASE WHEN hard IS NULL THEN l ELSE 0.0::DOUBLE END AS len_score, CASE WHEN hard IS NULL THEN f ELSE 0.0::DOUBLE END AS fmt_score, CASE WHEN hard IS NULL THEN s ELSE 0.0::DOUBLE END AS sub_score,
 CASE WHEN hard IS NULL THEN least(1.0::DOUBLE, l + f + s) ELSE 0.0::DOUBLE END AS quality_score, hard IS NULL AND l + f + s >= {threshold}::DOUBLE AS is_valid,
 coalesce(hard, CASE WHEN l + f + s < {threshold}::DOUBLE THEN 'low_score' END) AS reject_reason FROM marks)"""


_WITH = "WITH " + _scores()
QA_SCORE = f"{_WITH} SELECT src, id, len_score, fmt_score, sub_score, quality_score, is_valid, reject_reason FROM scored"
QA_ACCEPT = f"{_WITH} SELECT src, id, quality_score FROM scored WHERE is_valid"
QA_REASONS = f"{_WITH} SELECT src, coalesce(reject_reason, 'accepted') AS status, count(*) AS n FROM scored GROUP BY ALL"
QA_REPORT = f"{_WITH} SELECT count(*) AS total_examples, round(coalesce(avg(quality_score), 0.0), 6) AS avg_quality, min(quality_score) AS min_quality, max(quality_score) AS max_quality FROM scored WHERE is_valid"
QA_ACCEPTANCE = f"{_WITH} SELECT count(*) FILTER (is_valid) AS accepted, count(*) FILTER (NOT is_valid) AS rejected, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (is_valid) / count(*)::DOUBLE END AS acceptance_rate FROM scored"
MESSAGES = f"{_WITH} SELECT src, id, 'user' AS first_role, question AS first_content, 'assistant' AS second_role, md5(answer) AS second_md5, quality_score FROM scored WHERE is_valid"
QA_SWEEP = " UNION ALL ".join(f"(WITH {_scores(least, threshold)} SELECT {tier}::INT AS tier, count(*) AS accepted FROM scored WHERE is_valid HAVING count(*) > 0)" for tier, least, threshold in ((0, "20", "0.7"), (1, "20", "0.7"), (2, "20", "0.5"), (3, "20", "0.5"), (4, "20", "0.5"), (5, "10", "0.3")))
_DRAW_ID = "id * 10 + list_position(['talk', 'document', 'source', 'item', 'part', 'brand', 'event', 'nation'], src) AS draw_id"
CLEAN = f"WITH {_PAIRS} SELECT {_DRAW_ID}, question, md5(to_json({{'question': question, 'answer': answer, 'difficulty': 'easy'}})::VARCHAR) AS clean_md5 FROM pairs"
PARSED = f"{_WITH} SELECT {_DRAW_ID}, question, md5(answer) AS answer_md5, 'easy' AS difficulty, quality_score, is_valid, reject_reason FROM scored"
REPAIRED = f"""WITH {_PAIRS} SELECT {_DRAW_ID}, regexp_replace(question, '["\\\\]', '', 'g') AS question, md5(regexp_replace(answer, '["\\\\]', '', 'g')) AS answer_md5 FROM pairs"""
COST = f"""WITH {_PAIRS}, t AS (SELECT sum(ceil(length(question) / 4.0))::BIGINT AS i, sum(ceil(length(answer) / 4.0))::BIGINT AS o, count(*) AS n FROM pairs)
SELECT i AS input_tokens, o AS output_tokens, i + o AS total_tokens, i / 1000.0::DOUBLE * 0.0004::DOUBLE AS input_cost, o / 1000.0::DOUBLE * 0.0016::DOUBLE AS output_cost,
 i / 1000.0::DOUBLE * 0.0004::DOUBLE + o / 1000.0::DOUBLE * 0.0016::DOUBLE AS total_cost, n AS api_calls, (i / 1000.0::DOUBLE * 0.0004::DOUBLE + o / 1000.0::DOUBLE * 0.0016::DOUBLE) / n AS avg_cost_per_call FROM t"""

_NODES = """nodes AS (
 SELECT r_regionkey::BIGINT AS ord, 'R' || r_regionkey AS id, r_name AS label, '' AS description, '<br>type: region' AS more FROM region
 UNION ALL SELECT 1000000000000 + n_nationkey, 'N' || n_nationkey, n_name, '', '<br>type: nation' FROM nation
 UNION ALL SELECT 2000000000000 + s_suppkey, 'S' || s_suppkey, s_name, '', '<br>description: <br>desc: unused' FROM supplier
 UNION ALL SELECT 3000000000000 + c_custkey, 'C' || c_custkey, c_mktsegment, c_name, '<br>type: customer<br>segment: ' || c_mktsegment || '<br>desc: ' || c_name FROM customer
 UNION ALL SELECT 4000000000000 + p_partkey, 'P' || p_partkey, p_name, 'a part of type ' || p_type, '<br>description: a part of type ' || p_type FROM part
 UNION ALL SELECT DISTINCT 5000000000000 + split_part(p_brand, '#', 2)::BIGINT, 'B' || split_part(p_brand, '#', 2), 'B' || split_part(p_brand, '#', 2), '', '<br>type: brand<br>color: none' FROM part)"""
_SUPPLY = """supply AS (SELECT l_orderkey::BIGINT * 100 + l_linenumber AS ord, 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_quantity::INT::VARCHAR AS weight,
 CASE WHEN l_returnflag = 'R' THEN 'SUPPLIED_BACK' ELSE 'SUPPLIES' END AS predicate, 'line status ' || l_linestatus AS reasoning FROM lineitem),
last AS (SELECT min(ord) OVER (PARTITION BY src, dst) AS ord, src, dst, weight, predicate, reasoning, row_number() OVER (PARTITION BY src, dst ORDER BY ord DESC, weight DESC, predicate DESC, reasoning DESC) AS rn FROM supply)"""
_EDGES = f"""{_SUPPLY},
edges AS (
 SELECT n_nationkey::BIGINT AS ord, 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 'HAS_NATION' AS relationship, '' AS reasoning, '' AS more FROM nation
 UNION ALL SELECT 1000000000000000 + n_nationkey, 'N' || n_nationkey, 'N' || next, 'BORDERS', '', '' FROM (
  SELECT n_nationkey, coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), first_value(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) AS next FROM nation) WHERE next <> n_nationkey
 UNION ALL SELECT 2000000000000000 + s_suppkey, 'N' || s_nationkey, 'S' || s_suppkey, 'HOSTS', '', '<br>weight: 1' FROM supplier
 UNION ALL SELECT 3000000000000000 + c_custkey, 'N' || c_nationkey, 'C' || c_custkey, 'HOME_OF', '', '<br>weight: 1<br>custom: HOME_OF' FROM customer
 UNION ALL SELECT 4000000000000000 + ord, src, dst, predicate, reasoning, '<br>weight: ' || weight || '<br>reasoning: ' || reasoning FROM last WHERE rn = 1
 UNION ALL SELECT 5000000000000000 + p_partkey, 'P' || p_partkey, 'B' || split_part(p_brand, '#', 2), 'RELATED_TO', '', '<br>color: none' FROM part
 UNION ALL SELECT 6000000000000000 + r_regionkey, 'R' || r_regionkey, 'R' || r_regionkey, 'TRADES_WITHIN', '', '' FROM region)"""
_DEGREES = """degrees AS (SELECT n.ord, n.id, n.label, n.more, coalesce(o.c, 0) + coalesce(i.c, 0) AS degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) AS in_degree FROM nodes n
 LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) o ON o.src = n.id LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) i ON i.dst = n.id)"""

NODE_LABEL = f"WITH {_NODES} SELECT ord, id, label FROM nodes"
NODE_DESCRIPTION = f"WITH {_NODES} SELECT id, description FROM nodes"
EDGE_RELATIONSHIP = f"WITH {_EDGES} SELECT src, dst, relationship, reasoning FROM edges"
EDGE_LAST = f"WITH {_SUPPLY} SELECT ord, src, dst, weight, predicate FROM last WHERE rn = 1"
_GRAPH = f"{_NODES}, {_EDGES}, {_DEGREES}"
NODE_DEGREE = f"WITH {_GRAPH} SELECT id, degree, out_degree, in_degree FROM degrees"
EDGE_ORDER = f"WITH {_NODES}, {_EDGES} SELECT n.ord AS src_ord, row_number() OVER (PARTITION BY n.ord ORDER BY e.ord, e.dst) AS place, e.src, e.dst FROM edges e JOIN nodes n ON n.id = e.src"
GRAPH_STATS = f"WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, sum(degree)::BIGINT AS total_degree, greatest(max(degree), 1) AS max_degree, 2.0::DOUBLE * (SELECT count(*) FROM edges) / count(*) AS avg_degree, greatest((SELECT count(*) FROM edges), count(*)) * 2 AS capacity FROM degrees"
KHOP = f"""WITH RECURSIVE {_NODES}, {_EDGES}, reach AS (SELECT id AS start, id, 0 AS hop FROM nodes UNION SELECT r.start, e.dst, r.hop + 1 FROM reach r JOIN edges e ON e.src = r.id WHERE r.hop < 3)
SELECT start, id, min(hop)::INT AS hop FROM reach GROUP BY start, id HAVING min(hop) > 0"""
SUCCESSORS = f"WITH {_EDGES} SELECT DISTINCT src AS start, dst AS id FROM edges"
VIZ_NODES = f"WITH {_GRAPH} SELECT id, label, round(15.0::DOUBLE + 20.0::DOUBLE * degree / (SELECT greatest(max(degree), 1) FROM degrees), 6) AS size, '<b>' || label || '</b><br>ID: ' || id || '<br>Connections: ' || degree || more AS tooltip, ([{', '.join(repr(c) for c in PALETTE)}])[('0x' || substr(md5(id), 1, 8))::BIGINT % {len(PALETTE)} + 1] AS colour FROM degrees"
VIZ_EDGES = f"WITH {_EDGES} SELECT src, dst, relationship, '<b>' || relationship || '</b>' || more AS tooltip FROM edges"
PREVIEW = f"""WITH {_NODES}, {_EDGES} (SELECT 'node' AS kind, ord, label AS line FROM nodes ORDER BY ord LIMIT 20)
UNION ALL SELECT 'edge', e.ord, a.label || ' → [' || e.relationship || '] → ' || b.label FROM (SELECT * FROM edges ORDER BY ord LIMIT 20) e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst"""


def _draw(total: str, *parts: str) -> str:
    digits = lambda n: f"('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, {n}))::BIGINT"
    return f"(CASE WHEN {total} <= 1048576 THEN ({digits(8)} * least({total}, 1048576)) >> 32 ELSE {digits(15)} % {total} END)"


_WEIGHTED = f"""owned AS (SELECT id, sum(degree) OVER (ORDER BY ord) - degree AS lo, sum(degree) OVER (ORDER BY ord) AS hi FROM degrees WHERE degree > 0),
drawn AS (SELECT i AS draw_id, {_draw("(SELECT sum(degree)::BIGINT FROM degrees)", "'42'", "i", "'start'")} AS u FROM range(1000) t(i)),
draws AS (SELECT draw_id, id AS start FROM drawn JOIN owned ON u >= lo AND u < hi)"""
SAMPLE_WEIGHTED = f"WITH {_GRAPH}, {_WEIGHTED} SELECT draw_id, start FROM draws"
SAMPLE_UNIFORM = f"""WITH {_NODES}, placed AS (SELECT id, row_number() OVER (ORDER BY ord) - 1 AS place FROM nodes)
SELECT i AS draw_id, id AS start FROM range(1000) t(i) JOIN placed ON place = {_draw("(SELECT count(*) FROM nodes)", "'42'", "i", "'start'")}"""


def _walks(hops: int = 999) -> str:
    tries = ", ".join(_draw("o.out", "'42'", "w.draw_id", "w.step", str(k)) for k in range(8))
    return f"""outs AS (SELECT src, count(*) AS out FROM edges GROUP BY src),
placed_steps AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY substr(md5(dst), 1, 2), dst) - 1 AS place FROM edges),
walk AS (SELECT draw_id, start, start AS cur, [start] AS nodes, 0 AS step FROM draws
 UNION ALL SELECT draw_id, start, dst, list_append(nodes, dst), step + 1 FROM (
  SELECT w.*, e.dst, row_number() OVER (PARTITION BY w.draw_id ORDER BY CASE WHEN list_contains(w.tries, e.place) THEN list_position(w.tries, e.place) ELSE 9 END, md5('42:' || w.draw_id || ':' || w.step || ':' || e.dst), e.dst) AS rn
  FROM (SELECT w.*, [{tries}] AS tries FROM walk w JOIN outs o ON o.src = w.cur WHERE w.step < {hops}) w JOIN placed_steps e ON e.src = w.cur WHERE NOT list_contains(w.nodes, e.dst)) WHERE rn = 1),
walks AS (SELECT draw_id, any_value(start) AS start, arg_max(nodes, step) AS nodes, (max(step) + 1)::INT AS length FROM walk GROUP BY draw_id)"""


_WALKS = f"WITH RECURSIVE {_GRAPH}, {_WEIGHTED}, {_walks()}"
_PATH = "array_to_string(nodes, '>') AS path"
RANDOM_WALK = f"{_WALKS} SELECT draw_id, start, {_PATH}, length FROM walks"
CAPPED_WALK = f"WITH RECURSIVE {_GRAPH}, {_WEIGHTED}, {_walks(2)} SELECT draw_id, start, {_PATH}, length FROM walks"
WALK_LOSSES = f"{_WALKS} SELECT count(*) AS walks, count(*) FILTER (length < 2) AS dropped_short FROM walks"


def _maximal(starts: str) -> str:
    return f"""WITH RECURSIVE {_NODES}, {_EDGES}, grow AS (SELECT id AS start, id AS cur, [id] AS nodes FROM nodes WHERE {starts}
 UNION ALL SELECT g.start, e.dst, list_append(g.nodes, e.dst) FROM grow g JOIN edges e ON e.src = g.cur WHERE NOT list_contains(g.nodes, e.dst)),
paths AS (SELECT * FROM grow g WHERE len(nodes) > 1 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = g.cur AND NOT list_contains(g.nodes, e.dst)))"""


MAXIMAL_PATHS = _maximal("true") + f" SELECT start, {_PATH}, len(nodes)::INT AS length FROM paths"
PATH_HISTOGRAM = _maximal("true") + " SELECT len(nodes)::INT AS length, count(*) AS n FROM paths GROUP BY 1"
_LONG = "long AS (SELECT * FROM walks WHERE length > 1)"
_ALIKE = "len(list_intersect(x.nodes, y.nodes))::DOUBLE / (len(x.nodes) + len(y.nodes) - len(list_intersect(x.nodes, y.nodes)))"
JACCARD = f"""{_WALKS}, {_LONG}, sets AS (SELECT min(draw_id) AS draw_id, list_sort(nodes) AS nodes FROM long GROUP BY list_sort(nodes))
SELECT x.draw_id AS a, y.draw_id AS b, round({_ALIKE}, 9) AS similarity FROM sets x JOIN sets y ON x.draw_id < y.draw_id WHERE {_ALIKE} >= 0.5"""


def _fold(threshold: str) -> str:
    """kept: the draws that a scan in order keeps, one row of the recursion per draw; equal sets are alike at any threshold."""
    return f"""{_LONG}, sets AS (SELECT min(draw_id) AS draw_id, list_sort(nodes) AS nodes FROM long GROUP BY list_sort(nodes)),
numbered AS (SELECT *, row_number() OVER (ORDER BY draw_id) AS k FROM sets),
pairs AS (SELECT x.k AS a, y.k AS b FROM numbered x JOIN numbered y ON x.k < y.k WHERE {_ALIKE} >= {threshold}),
before AS (SELECT n.k, n.draw_id, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS alike FROM numbered n LEFT JOIN pairs p ON p.b = n.k GROUP BY n.k, n.draw_id),
scan AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT b.k, CASE WHEN list_has_any(s.kept, b.alike) THEN s.kept ELSE list_append(s.kept, b.k) END FROM scan s JOIN before b ON b.k = s.k + 1),
kept AS (SELECT b.draw_id FROM before b WHERE list_contains((SELECT arg_max(kept, k) FROM scan), b.k))"""


DEDUP_EXACT = f"{_WALKS}, {_fold('0.95')} SELECT draw_id, {_PATH} FROM long WHERE draw_id IN (SELECT draw_id FROM kept)"
DEDUP_GREEDY = f"{_WALKS}, {_fold('0.5')} SELECT draw_id, {_PATH} FROM long WHERE draw_id IN (SELECT draw_id FROM kept)"
DEDUP_STATS = f"{_WALKS}, {_fold('0.5')} SELECT (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM long) - (SELECT count(*) FROM kept) AS duplicates_skipped"
_TEXT = f"""{_LONG}, steps AS (SELECT draw_id, length, unnest(nodes) AS id, unnest(range(1, len(nodes) + 1)) AS pos, nodes FROM long),
named AS (SELECT s.*, n.label, n.description, e.relationship, e.reasoning FROM steps s LEFT JOIN nodes n ON n.id = s.id LEFT JOIN edges e ON e.src = s.id AND e.dst = s.nodes[s.pos + 1]),
texts AS (SELECT draw_id, any_value(length) AS length,
 string_agg(label || CASE WHEN relationship IS NULL THEN '' ELSE ' -[' || relationship || ']-> ' END, '' ORDER BY pos) AS path_str,
 string_agg('  [' || label || ']' || CASE WHEN description = '' THEN '' ELSE ' - ' || description END || CASE WHEN relationship IS NULL THEN '' ELSE chr(10) || '    --(' || relationship || ')-->' || CASE WHEN reasoning = '' THEN '' ELSE ' (Reasoning: ' || reasoning || ')' END END, chr(10) ORDER BY pos) AS rich_context
 FROM named GROUP BY draw_id)"""
PATH_STR = f"{_WALKS}, {_TEXT} SELECT draw_id, path_str, length FROM texts"
RICH_CONTEXT = f"{_WALKS}, {_TEXT} SELECT draw_id, rich_context FROM texts"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_of(text: str) -> str:
    return f"{_WALKS}, {_TEXT} SELECT draw_id, {text} AS prompt FROM texts"


def prompt_sql(head: str, context: str, tail: str) -> str:
    h, c, t = ("'" + x.replace("'", "''") + "'" for x in (head, context, tail))
    return f"{_WALKS}, {_TEXT} SELECT draw_id, {h} || path_str || {c} || rich_context || {t} AS prompt FROM texts"


def _run_sql(draws: int, head: str, context: str, tail: str) -> str:
    """CTEs up to `judged`: a run's kept paths, the offline backend's replies to their prompts, and their scores."""
    h, c, t = ("'" + x.replace("'", "''") + "'" for x in (head, context, tail))
    walks = _WALKS.replace("range(1000)", f"range({draws})")
    text = _TEXT.removeprefix(f"{_LONG}, ")
    return f"""{walks}, {_fold("0.95")}, {text},
links AS (SELECT a.draw_id, count(*) AS n, string_agg(a.label || ' is tied to ' || b.label || ' by ' || lower(replace(a.relationship, '_', ' ')), '<then>' ORDER BY a.pos) AS said FROM named a JOIN named b ON b.draw_id = a.draw_id AND b.pos = a.pos + 1 GROUP BY a.draw_id),
ends AS (SELECT draw_id, arg_min(label, pos) AS first, arg_max(label, pos) AS last FROM named GROUP BY draw_id),
asked AS (SELECT x.draw_id, ('0x' || substr(md5({h} || x.path_str || {c} || x.rich_context || {t}), 1, 8))::BIGINT % 4 AS kind FROM texts x WHERE x.draw_id IN (SELECT draw_id FROM kept)),
replies AS (SELECT draw_id, CASE WHEN n = 1 THEN 'easy' WHEN n = 2 THEN 'medium' ELSE 'hard' END AS difficulty, 'How does ' || first || ' relate to ' || last || CASE WHEN kind > 0 THEN '?' ELSE '' END AS question,
 'In short, ' || replace(said, '<then>', CASE WHEN kind = 3 THEN ',' || chr(10) || 'and then ' ELSE ', and then ' END) || CASE WHEN kind = 1 THEN '' ELSE '.' END
 || CASE WHEN n > 1 THEN ' Each of these links was stated, step by step, on the way from the first to the last.' ELSE '' END AS answer FROM asked JOIN links USING (draw_id) JOIN ends USING (draw_id)),
counted AS (SELECT *, len(regexp_split_to_array(answer, '\\s+')) AS words FROM replies),
judged AS (SELECT *, (CASE WHEN words BETWEEN 20 AND 500 THEN 0.4::DOUBLE WHEN words > 500 THEN 0.35::DOUBLE WHEN words >= 10 THEN 0.4::DOUBLE * (words::DOUBLE / 20::DOUBLE) ELSE 0.0::DOUBLE END)
 + (CASE WHEN contains(question, '?') THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END)
 + (CASE WHEN length(answer) >= 50 AND regexp_matches(answer, '[.!?]') THEN 0.3::DOUBLE WHEN length(answer) >= 30 THEN 0.2::DOUBLE WHEN length(answer) >= 20 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM counted)"""


def chat_sql(draws: int, head: str, context: str, tail: str) -> str:
    return f"{_run_sql(draws, head, context, tail)} SELECT draw_id, question, answer, least(1.0::DOUBLE, score) AS quality_score FROM judged WHERE score >= 0.7::DOUBLE"


def rejects_sql(draws: int, head: str, context: str, tail: str) -> str:
    return f"{_run_sql(draws, head, context, tail)} SELECT difficulty, CASE WHEN score >= 0.7::DOUBLE THEN 'accepted' ELSE 'low_score' END AS status, count(*) AS n FROM judged GROUP BY ALL"


def metadata_sql(draws: int, head: str, context: str, tail: str) -> str:
    """Tokens are counted as the offline backend counts them: four characters begun each, of prompt and reply."""
    reply = """length('{"question": "", "answer": "", "difficulty": ""}') + length(j.question) + length(j.answer) + length(j.difficulty) + CASE WHEN k.kind = 2 THEN 12 ELSE 0 END"""
    asked = f"length({_quoted(head)} || x.path_str || {_quoted(context)} || x.rich_context || {_quoted(tail)})"
    return f"""{_run_sql(draws, head, context, tail)},
spent AS (SELECT sum(({asked} + 3) // 4)::BIGINT AS i, sum(({reply} + 3) // 4)::BIGINT AS o, count(*) AS n, count(*) FILTER (j.score >= 0.7::DOUBLE) AS good, avg(least(1.0::DOUBLE, j.score)) FILTER (j.score >= 0.7::DOUBLE) AS mean
 FROM judged j JOIN asked k USING (draw_id) JOIN texts x USING (draw_id))
SELECT {draws} AS count_requested, good AS count_generated, n - good AS count_rejected, round(good / n::DOUBLE, 9) AS acceptance_rate, i AS input_tokens, o AS output_tokens, n AS api_calls,
 round(i / 1000.0::DOUBLE * 0.0004::DOUBLE + o / 1000.0::DOUBLE * 0.0016::DOUBLE, 9) AS total_cost, round((i / 1000.0::DOUBLE * 0.0004::DOUBLE + o / 1000.0::DOUBLE * 0.0016::DOUBLE) / good, 9) AS avg_cost_per_example, round(mean, 6) AS avg_quality,
 (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, n AS paths_extracted, greatest((SELECT count(*) FROM edges), (SELECT count(*) FROM nodes)) * 2 AS estimated_capacity FROM spent"""


#: The warnings as the tier table words them.
TIER_WARNINGS = """SELECT * FROM (VALUES ('dedup threshold 0.70 instead of 0.95: more paths count as duplicates', 1), ('quality threshold 0.5 instead of 0.7', 2), ('dedup threshold 0.60 instead of 0.95: more paths count as duplicates', 3), ('temperature 0.9 instead of 0.7', 3),
 ('dedup threshold 0.50 instead of 0.95: more paths count as duplicates', 4), ('uniform instead of degree-weighted sampling', 4), ('quality threshold 0.3 instead of 0.7', 5), ('dedup threshold 0.30 instead of 0.95: more paths count as duplicates', 5), ('temperature 1.0 instead of 0.7', 5)) t(warning, first_tier)"""
GRAPHML_NODES = "SELECT * FROM (VALUES (0::BIGINT, 'a', 'Alpha', ''), (1, 'b', 'second', ''), (3, 'c', 'c', '')) t(ord, id, label, description)"
GRAPHML_EDGES = "SELECT * FROM (VALUES (0::BIGINT, 'a', 'b', 'last', ''), (1, 'b', 'c', 'loose', '')) t(ord, src, dst, relationship, reasoning)"
TRUTHY = "SELECT * FROM (VALUES (0, 'b'), (1, 't'), (2, 'n'), (3, '0.5'), (4, 'true'), (5, 'n'), (6, 'last'), (7, '0')) t(case_id, label)"
NO_CONTEXT = lambda head, tail: _prompt_of(f"{_quoted(head)} || path_str || {_quoted(tail)}")
DEDUP_EXTREMES = f"{_WALKS}, {_LONG} SELECT '0' AS threshold, min(draw_id) AS draw_id FROM long UNION ALL SELECT '1.1', draw_id FROM long"
JSONL = f"{_WITH} SELECT md5(question) AS question_md5, md5(answer) AS answer_md5 FROM scored WHERE is_valid"
RECOMMENDATIONS = """SELECT * FROM (VALUES (-1, 'HIGH', 1), (0, 'HIGH', 1), (1, 'MODERATE', 2), (2, 'MODERATE', 2), (3, 'REDUCED', 4), (4, 'REDUCED', 4), (5, 'REDUCED', 4)) t(top_tier, level, recommendations)"""
