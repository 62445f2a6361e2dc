"""SQL for DuckDB of the queries over transcripts, snapshots, verdicts, evaluation runs and messages. The rules of
plans/recorded.py are stated here once more, in terms of the results."""

from __future__ import annotations

import json

from ..functions import vocabulary as V
from ..operators import evaluation
from . import oracles as O
from .fixture import with_views as v
from .recorded import BUDGET_USD, END, TOOLS

# transcripts: kept lines, turns and sessions
_KEPT = ("kept", f"""
    SELECT conv_id AS c, turn AS t, role, CASE WHEN role = 'user' AND conv_id % 12 = 5 THEN '<scheduled-task name="job-' || conv_id % 3 || '">' || text ELSE text END AS text,
           CASE WHEN conv_id % 23 <> 0 THEN '2025-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || 'T08:' || lpad((turn % 60)::VARCHAR, 2, '0') || ':00Z' END AS ts,
           CASE WHEN turn % 4 = 1 THEN '/home/dev/p' || conv_id % 5 || '/t' || turn END AS cwd, CASE WHEN turn % 5 = 2 THEN '1.' || turn END AS version,
           CASE WHEN conv_id % 14 = 7 THEN 'internal' WHEN conv_id % 2 = 0 THEN 'external' END AS user_type, role = 'user' AND (conv_id * 3 + turn) % 8 = 0 AS is_result
    FROM raw_turns WHERE (conv_id + turn) % 17 <> 0""")
_TURNS = ("turns", f"SELECT *, {O.trim('text')} AS content, row_number() OVER (PARTITION BY c ORDER BY t) - 1 AS turn_index FROM kept WHERE NOT is_result AND (role = 'assistant' OR {O.trim('text')} <> '')")
_FOUND = ("found_sessions", f"""
    SELECT *, 'sess-' || c AS session_id, (scheduled_task_id IS NULL AND coalesce(user_type, 'external') = 'external') AS eligible FROM (
      SELECT a.c, coalesce(k.first_ts, sys) AS started_at, coalesce(sys, k.last_ts) AS ended_at, k.cwd, 'claude-code-' || k.version AS model, k.user_type, u.scheduled AS scheduled_task_id, coalesce(n.n, 0) AS turn_count
      FROM (SELECT c, CASE WHEN c % 6 = 0 THEN '{END}' END AS sys FROM (SELECT DISTINCT conv_id AS c FROM raw_turns) d) a
      LEFT JOIN (SELECT c, arg_min(ts, t) AS first_ts, arg_max(ts, t) AS last_ts, arg_max(cwd, t) AS cwd, arg_min(version, t) AS version, max(user_type) AS user_type FROM kept GROUP BY 1) k ON k.c = a.c
      LEFT JOIN (SELECT c, CASE WHEN c % 12 = 5 THEN 'job-' || c % 3 END AS scheduled FROM turns WHERE role = 'user' GROUP BY 1) u ON u.c = a.c
      LEFT JOIN (SELECT c, count(*) AS n FROM turns GROUP BY 1) n ON n.c = a.c) x WHERE started_at IS NOT NULL""")
_NAMED = ("named", f"SELECT *, coalesce({O._BASENAME}, scheduled_task_id, 'unknown') AS project_name, CASE WHEN cwd IS NOT NULL THEN 'cwd:' || {O._BASENAME} || ':' || substr(sha1(cwd), 1, 8) ELSE 'unknown:' || session_id END AS project_id, row_number() OVER (ORDER BY c::VARCHAR || '/') AS file_no FROM found_sessions")
_TRANSCRIPT = (_KEPT, _TURNS, _FOUND, _NAMED)
_TOOL = "([" + ", ".join(f"'{x}'" for x in TOOLS) + "])[t // 2 % 4 + 1]"

_AUDITS = ("audits", """
    SELECT 'cowork' AS source, c, started_at, ended_at, CASE WHEN has THEN 'w-' || c ELSE 'local_' || c END AS session_id, CASE WHEN has THEN 'Test: Feature  ' || c % 4 END AS title, CASE WHEN has THEN '/vm' END AS cwd,
           CASE WHEN has THEN 'm1' END AS model, CASE WHEN has AND c % 8 = 0 THEN 'night' END AS scheduled_task_id
    FROM (SELECT c, c % 3 <> 0 AND c % 10 <> 0 AS has, arg_min(said, t) AS started_at, arg_max(said, t) AS ended_at FROM (
        SELECT c, t, CASE WHEN t % 2 = 0 THEN '2025-03-' ELSE '2025-04-' END || lpad((c % 28 + 1)::VARCHAR, 2, '0') || 'T08:' || lpad((t % 60)::VARCHAR, 2, '0') || ':00Z' AS said FROM kept) y GROUP BY 1) x""")

_RULE = "SELECT *, pair_id // 10 AS b FROM pairs WHERE extraction_method = 'rule'"
_JUDGED = ("judged", f"""
    SELECT *, CASE WHEN b % 9 <= 1 THEN 'failed' WHEN b % 4 <> 0 THEN 'accepted' ELSE 'rejected' END AS outcome,
           CASE WHEN b % 5 = 0 THEN 'other' WHEN b % 13 = 0 THEN '' ELSE clarification_kind END AS kind, CASE WHEN b % 11 = 0 THEN '' ELSE substr(clarification_text, 1, 50) END AS text,
           CASE WHEN b % 6 <> 0 THEN (b % 10) / 10.0::DOUBLE ELSE 0.7 END AS conf, 'r' || b % 3 AS why, CASE WHEN b % 9 = 0 THEN 'RateLimit' WHEN b % 9 = 1 AND b % 2 = 1 THEN 'Overloaded' END AS error_class,
           CASE WHEN b % 9 = 0 THEN 429 END AS error_status, coalesce(b % 9 > 1 AND b % 4 <> 0 AND nullif(CASE WHEN b % 5 = 0 THEN 'other' WHEN b % 13 = 0 THEN '' ELSE clarification_kind END, '') <> clarification_kind, false) AS refined,
           b % 1000 / 1e6 * 3.0::DOUBLE + b % 500 / 1e6 * 0.3::DOUBLE + b % 50 / 1e6 * 15.0::DOUBLE AS cost FROM ({_RULE}) r""")
_ACCEPTED = ("accepted", "SELECT * FROM judged WHERE outcome = 'accepted' AND kind <> '' AND text <> ''")
_VERDICT = (*O.PAIR_VIEWS, _JUDGED, _ACCEPTED)

# evaluation: cases of a mode, their answers, what is found for them, and the rows of the run
_ORIGIN = "JOIN prompts o ON o.prompt_id = p.originating_prompt_id JOIN foreign_projects j ON j.project_id = o.project_id"
_FIELDS = "p.pair_id AS case_id, o.content AS prompt, o.project_id AS project_id, p.originating_prompt_id, p.pair_id AS gold_pair_id, p.clarification_kind AS gold_kind, p.clarification_text AS gold_text, CAST(NULL AS VARCHAR) AS shape"
GOLD = f"SELECT {_FIELDS} FROM pairs p {_ORIGIN} WHERE p.extraction_method = 'manual'"
_KEY = "session_id, orig_norm, clar_norm"
_WIDE_FIRST = f"SELECT min(r.pair_id) FROM contents r JOIN foreign_projects j ON j.project_id = r.project_id WHERE extraction_method = 'llm' AND ({_KEY}) NOT IN (SELECT ({_KEY}) FROM contents WHERE extraction_method = 'manual') GROUP BY originating_prompt_id, clarifying_prompt_id"
WIDE = f"SELECT {_FIELDS} FROM pairs p {_ORIGIN} WHERE p.pair_id IN ({_WIDE_FIRST})"


def _shapes() -> str:
    rows = json.loads(evaluation.SHAPES_FILE.read_text(encoding="utf-8"))["prompts"]
    text = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({i}, {text(p['text'])}, {text(p['shape'])})" for i, p in enumerate(rows))
    none = "CAST(NULL AS {}) AS {}"
    fields = ", ".join(none.format(k, n) for k, n in (("BIGINT", "project_id"), ("BIGINT", "originating_prompt_id"), ("BIGINT", "gold_pair_id"), ("VARCHAR", "gold_kind"), ("VARCHAR", "gold_text")))
    return f"SELECT CAST(i AS BIGINT) AS case_id, x AS prompt, {fields}, s AS shape FROM (VALUES {listed}) t(i, x, s)"


def _cases(source: str) -> tuple[str, str]:
    k = "case_id"
    return ("cases", f"""
        SELECT *, CASE WHEN {k} % 19 = 0 THEN 'RateLimit' END AS error_class, {k} % 500 AS latency_ms, length(prompt) * 10 / 1e6 * 3.0::DOUBLE + {k} % 1000 / 1e6 * 0.3::DOUBLE + (3000 + {k} % 7 * 100) / 1e6 * 15.0::DOUBLE AS cost_usd,
          CASE WHEN {k} % 19 = 0 THEN [] ELSE list_filter([
            CASE WHEN {k} % 2 = 1 THEN {{'text': 'does ''it'' mean ' || substr(coalesce(gold_text, 'nothing'), 1, 30), 'kind': 'file-scope', 'confidence': ({k} % 10) / 10.0::DOUBLE}} END,
            CASE WHEN {k} % 3 <> 0 THEN {{'text': 'live on production or local src/ ' || substr(prompt, 1, 40), 'kind': 'success-criteria', 'confidence': 0.5::DOUBLE}} END,
            CASE WHEN {k} % 4 <> 0 THEN {{'text': coalesce(gold_text, 'nothing'), 'kind': 'constraint', 'confidence': ({k} % 7) / 10.0::DOUBLE}} END], lambda q: q IS NOT NULL) END AS questions
        FROM ({source}) c0""")


def retrieved(limit: int) -> tuple[tuple[str, str], ...]:
    """Views of what retrieve() finds for the view searches."""
    half = -(-limit // 2)
    return (
        ("inside", O._cut("(SELECT * FROM ranked WHERE scope = project_id)", str(limit))),
        ("need", f"SELECT s.query_id, coalesce(h.n, 0) AS have, {limit} - coalesce(h.n, 0) AS missing, CASE WHEN scope IS NULL THEN {limit} ELSE ({limit} - coalesce(h.n, 0)) * 3 END AS most FROM searches s LEFT JOIN (SELECT query_id, count(*) AS n FROM inside GROUP BY 1) h USING (query_id) WHERE scope IS NULL OR coalesce(h.n, 0) < {half}"),
        ("found", f"""SELECT query_id, prompt_id, pos FROM inside UNION ALL SELECT query_id, prompt_id, rn + have AS pos FROM (
            SELECT w.query_id, w.prompt_id, n.have, n.missing, row_number() OVER (PARTITION BY w.query_id ORDER BY round(w.rank, 9), w.prompt_id) AS rn
            FROM ({O._cut('(SELECT r.*, n.most FROM ranked r JOIN need n USING (query_id))', 'most')}) w JOIN need n ON n.query_id = w.query_id
            WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.query_id = w.query_id AND i.prompt_id = w.prompt_id)) x WHERE rn <= missing"""),
    )


_SHOWN = "SELECT {key}, pair_id FROM (SELECT f.{key}, p.pair_id, row_number() OVER (PARTITION BY f.{key} ORDER BY p.pair_id) AS rn FROM {found} f JOIN pairs p ON p.originating_prompt_id = f.prompt_id WHERE p.extraction_method = 'manual' AND p.clarification_kind IS NOT NULL) x WHERE rn <= 6"


def _run_views(source: str, run_id: int) -> tuple[tuple[str, str], ...]:
    searches = ("searches", "SELECT case_id AS query_id, prompt AS text, project_id AS scope FROM cases")
    index = [x for x in O.SEARCH_VIEWS if x[0] not in ("flagged", "norm", "foreign_projects", "searches")]
    near = ("near", "SELECT * FROM (SELECT f.query_id AS case_id, f.prompt_id, row_number() OVER (PARTITION BY f.query_id ORDER BY f.pos) AS pos FROM found f JOIN cases c ON c.case_id = f.query_id WHERE f.prompt_id IS DISTINCT FROM c.originating_prompt_id) x WHERE pos <= 8")
    shown = ("shown", f"SELECT case_id, count(*) AS n FROM ({_SHOWN.format(key='case_id', found='near')}) s GROUP BY 1")
    run = ("run", f"""
        SELECT CAST({run_id} AS BIGINT) AS run_id, c.case_id, c.originating_prompt_id, c.gold_pair_id, c.shape, c.gold_kind, s.overlap_at_1, s.overlap_at_3, s.kind_match_top1, s.kind_match_any,
          CASE WHEN c.gold_pair_id IS NOT NULL THEN coalesce(m.kinds, '') END AS matched_kinds, coalesce(r.ids, '') AS retrieved_ids, coalesce(e.n, 0) AS n_examples, c.latency_ms, c.cost_usd, c.gold_pair_id IS NOT NULL AS is_in_gold_subset,
          i.vague_verb, i.has_disambiguation, i.live_or_local, CASE WHEN c.gold_pair_id IS NOT NULL THEN i.correct_skip END AS correct_skip, c.error_class
        FROM (SELECT *, coalesce(sum(cost_usd) OVER (ORDER BY case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM cases) c
        LEFT JOIN (SELECT * FROM scores WHERE case_id IN (SELECT case_id FROM cases WHERE gold_pair_id IS NOT NULL)) s ON s.case_id = c.case_id JOIN instruments i ON i.case_id = c.case_id
        LEFT JOIN (SELECT case_id, string_agg(kind, ',' ORDER BY pos) AS kinds FROM scored GROUP BY 1) m ON m.case_id = c.case_id
        LEFT JOIN (SELECT case_id, string_agg(prompt_id::VARCHAR, ',' ORDER BY pos) AS ids FROM near GROUP BY 1) r ON r.case_id = c.case_id
        LEFT JOIN shown e ON e.case_id = c.case_id WHERE round(spent, 9) <= {BUDGET_USD}""")
    return (*O.LABEL_VIEWS, _cases(source), O.SCORED, O.SCORES, O.INSTRUMENTS, searches, *index, *retrieved(10), near, shown, run)


_RUN = "SELECT * REPLACE (round(overlap_at_1, 6) AS overlap_at_1, round(overlap_at_3, 6) AS overlap_at_3, round(cost_usd, 6) AS cost_usd) FROM run"
_CODE = ("code", "SELECT doc_id, '/audits/local_' || doc_id % 97 AS folder, doc_id % 3 <> 0 AS is_output, strlen(text) AS size FROM documents")
_K = "prompt_id"
_CLARIFIED = ("clarified", f"""
    SELECT {_K}, content, CASE WHEN {_K} % 6 <> 0 THEN {_K} % 9 ELSE 0 END AS n, {_K} % 5 = 0 AS failed, CASE WHEN {_K} % 4 = 1 THEN CASE WHEN {_K} % 8 = 1 THEN 1 ELSE 2 END ELSE 0 END AS k FROM prompts WHERE role = 'user'""")


def _short(text: str, most: int) -> str:
    return f"CASE WHEN length({text}) > {most} THEN substr({text}, 1, {most}) || '… [truncated]' ELSE {text} END"


def oracle_sql() -> dict[str, str]:
    tags = O.tags("content")
    nl = "chr(10)"
    return {
        "transcript_sessions": v("SELECT session_id, cwd, started_at, ended_at, model, user_type, scheduled_task_id, eligible, project_name, turn_count FROM named", *_TRANSCRIPT),
        "transcript_prompts": v(f"SELECT s.session_id, turn_index, role, content, ts AS timestamp, {tags['has_files']} AS has_files, {tags['has_tests']} AS has_tests, s.eligible FROM turns JOIN named s ON s.c = turns.c", *_TRANSCRIPT),
        "stored_prompts": v(f"SELECT s.session_id, turn_index, role, content, ts AS timestamp, {tags['has_files']} AS has_files, {tags['has_tests']} AS has_tests, s.eligible FROM turns JOIN named s ON s.c = turns.c", *_TRANSCRIPT),
        "transcript_order": v("SELECT session_id, file_no, turn_count AS turns FROM named WHERE turn_count > 0", *_TRANSCRIPT),
        "transcript_tool_calls": v(f"SELECT s.session_id, {_TOOL} AS tool_name, {O._operation(_TOOL)} AS operation, 'src/' || turns.c % 7 || '.py' AS file_path, count(*) AS n FROM turns JOIN named s ON s.c = turns.c WHERE role = 'assistant' AND t % 2 = 1 GROUP BY ALL", *_TRANSCRIPT),
        "transcript_projects": v("SELECT project_id, arg_min(project_name, file_no) AS name, arg_min(cwd, file_no) AS cwd, arg_max(coalesce(ended_at, started_at), file_no) AS last_seen_at FROM named GROUP BY 1", *_TRANSCRIPT),
        "tool_result_lines": v("SELECT conv_id, count(*) FILTER (role = 'user' AND (conv_id * 3 + turn) % 8 = 0) AS n_results, count(*) AS n_lines FROM raw_turns GROUP BY 1"),
        "audit_sessions": v(f"SELECT session_id, {O._PROJECT_KEY} AS project_id, coalesce(title, {O._BASENAME}, scheduled_task_id, 'unknown') AS project_name, cwd, title, model, started_at, ended_at, CASE WHEN scheduled_task_id IS NULL THEN 'external' ELSE 'scheduled' END AS user_type, scheduled_task_id, scheduled_task_id IS NULL AS eligible FROM audits", _KEPT, _AUDITS),
        "resumed_sessions": v("""SELECT session_id, project_id, cwd, started_at, source AS model, 'old' AS source_path, CASE WHEN session_id % 2 = 0 THEN 'new ' || title ELSE title END AS title, CASE WHEN session_id % 2 = 0 THEN 'new ' || ended_at ELSE ended_at END AS ended_at FROM sessions
            UNION ALL SELECT session_id + 1000000, project_id + 100, 'new ' || cwd, 'new ' || started_at, 'new ' || source, 'new old', 'new ' || title, 'new ' || ended_at FROM sessions WHERE session_id % 3 = 0"""),
        "rewritten_prompts": v("SELECT prompt_id, session_id, turn_index, CAST(CASE WHEN session_id % 4 = 0 AND has THEN 2 ELSE 1 END AS BIGINT) AS version FROM (SELECT *, bool_or(turn_index % 2 = 0) OVER (PARTITION BY session_id) AS has FROM prompts) x WHERE session_id % 4 <> 0 OR NOT has OR turn_index % 2 = 0"),
        "stored_blobs": "SELECT sha256(text) AS content_hash, strlen(text) > 1024 AS is_compressed FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 5 = 0) GROUP BY 1, 2",
        "session_snapshots": v("SELECT 's' || s.session_id AS session_id, project_id, 'cowork-outputs' AS snapshot_type, folder || '/outputs' AS source_path, ended_at AS captured_at, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes FROM code JOIN sessions s ON folder = '/audits/local_' || s.session_id WHERE is_output AND eligible AND s.session_id % 4 <> 1 GROUP BY ALL", _CODE),
        "new_snapshots": v("SELECT snapshot_id, '/p/' || snapshot_id % 50 AS source_path, snapshot_type, session_id FROM snapshots s WHERE snapshot_id % 7 > 0 AND NOT EXISTS (SELECT 1 FROM snapshots e WHERE e.snapshot_id % 9 = 0 AND e.snapshot_id % 50 = s.snapshot_id % 50 AND e.snapshot_type = s.snapshot_type AND e.session_id IS NOT DISTINCT FROM s.session_id)", O.SNAPSHOTS),
        "trash_projects": """SELECT folder, (['trash:my-app', 'trash:old-site', 'trash:mile-s-shop', 'trash:plain', 'trash:x'])[i + 1] AS project_id, count(*) AS file_count, CAST(sum(n) AS BIGINT) AS total_bytes
            FROM (SELECT doc_id % 5 AS i, length(text) AS n, (['My App 8.44.09 AM', 'old--site', 'Émile''s Shop', 'plain', '-x- 12.01.59 pm'])[doc_id % 5 + 1] AS folder FROM documents WHERE doc_id % 6 <> 0) x GROUP BY ALL""",
        "replaced_rule_pairs": v("SELECT pair_id, extraction_method, confidence FROM pairs WHERE extraction_method <> 'rule' UNION ALL SELECT pair_id + 5, 'rule', 0.9 FROM pairs WHERE extraction_method = 'rule' AND pair_id % 20 = 0", *O.PAIR_VIEWS),
        "verdict_pairs": v("SELECT pair_id AS from_pair_id, originating_prompt_id, clarifying_prompt_id, kind AS clarification_kind, text AS clarification_text, extractor_version, conf AS confidence, why AS reason FROM accepted", *_VERDICT),
        "verdict_failures": v("SELECT pair_id, extractor_version, error_class, error_status, CASE WHEN b % 9 = 0 THEN 'slow down' ELSE why END AS error_message FROM judged WHERE outcome = 'failed'", *_VERDICT),
        "verdict_tally": v("SELECT outcome, CASE WHEN outcome = 'failed' THEN coalesce(error_class, 'Unknown') || coalesce('(' || error_status || ')', '') END AS error, count(*) AS n, count(*) FILTER (refined) AS refined, round(sum(cost), 6) AS cost_usd, round(avg(b % 100), 6) AS mean_latency_ms FROM judged GROUP BY 1, 2", *_VERDICT),
        "verdict_retry": v("SELECT outcome, count(*) AS n, count(*) FILTER (refined) AS refined FROM judged WHERE originating_prompt_id NOT IN (SELECT originating_prompt_id FROM pairs WHERE extraction_method = 'llm') GROUP BY 1", *_VERDICT),
        "verdict_table": v("SELECT extraction_method, clarification_kind, count(*) AS n, round(sum(confidence), 6) AS confidence FROM (SELECT extraction_method, clarification_kind, confidence FROM pairs WHERE extraction_method <> 'llm' UNION ALL SELECT 'llm', kind, conf FROM accepted) x GROUP BY 1, 2", *_VERDICT),
        "manual_labels": v("SELECT pair_id AS from_pair_id, originating_prompt_id, clarifying_prompt_id, CASE a WHEN 3 THEN NULL WHEN 2 THEN 'other' ELSE clarification_kind END AS clarification_kind, CASE a WHEN 3 THEN '__rejected__' WHEN 1 THEN 'edited ' || pair_id // 10 % 4 ELSE clarification_text END AS clarification_text, extractor_version, CASE WHEN a = 3 THEN 'no' END AS reason FROM (SELECT *, pair_id // 10 % 6 AS a FROM pairs WHERE extraction_method = 'llm') x WHERE a < 4", *O.PAIR_VIEWS),
        "updated_reasons": v("SELECT pair_id, CASE WHEN pair_id % 6 = 0 AND clarification_kind IS NOT NULL THEN 'now ' || clarification_kind ELSE reason END AS reason FROM pairs", *O.PAIR_VIEWS),
        "outcome_upsert": v("SELECT * REPLACE (CASE WHEN session_id % 3 = 0 THEN -1 ELSE turn_count END AS turn_count) FROM outcomes UNION ALL SELECT * REPLACE (session_id + 1000000 AS session_id) FROM outcomes WHERE session_id % 10 = 0", *O.OUTCOME_VIEWS),
        "gold_cases": v(f"SELECT case_id, project_id, originating_prompt_id, gold_kind, gold_text, length(prompt) AS prompt_length FROM ({GOLD}) g", *O.LABEL_VIEWS),
        "eval_gold_run": v(_RUN, *_run_views(GOLD, 1)),
        "eval_wide_run": v(_RUN, *_run_views(WIDE, 2)),
        "eval_shape_run": v(_RUN.replace("SELECT *", "SELECT * EXCLUDE (matched_kinds)"), *_run_views(_shapes(), 3)),
        "eval_runs": v("SELECT run_id, 'gold' AS mode, 'bm25' AS retrieval_method, CAST(8 AS BIGINT) AS retrieval_k, count(*) AS case_count, round(avg(overlap_at_1), 6) AS overlap_at_1, round(avg(overlap_at_3), 6) AS overlap_at_3, round(avg(kind_match_any::INT), 6) AS kind_match_rate, round(sum(cost_usd), 6) AS total_cost_usd FROM run GROUP BY 1", *_run_views(GOLD, 1)),
        "search_examples": v(f"""SELECT f.query_id, count(*) AS n, count(*) FILTER (f.prompt_id IN (SELECT originating_prompt_id FROM pairs WHERE extraction_method = 'manual')) AS n_clarified, any_value(s.pair_ids) AS pair_ids FROM found f
            LEFT JOIN (SELECT query_id, string_agg(pair_id::VARCHAR, ',' ORDER BY pair_id) AS pair_ids FROM ({_SHOWN.format(key='query_id', found='found')}) y GROUP BY 1) s ON s.query_id = f.query_id GROUP BY 1""", *O.PAIR_VIEWS, *[x for x in O.SEARCH_VIEWS if x[0] != "flagged"], *retrieved(6)),
        "project_lookup": v("""SELECT name, arg_min(project_id, (-(project_id % 2), -(project_id % 3), project_id)) AS project_id FROM (
            SELECT DISTINCT n.name, p.project_id FROM (SELECT DISTINCT CASE WHEN session_id % 2 = 0 THEN 'project-' || session_id % 7 ELSE 'P' || session_id % 6 END AS name FROM sessions) n JOIN projects p ON p.name = n.name OR p.cwd ILIKE '%/' || n.name) x GROUP BY 1"""),
        "clarify_results": v(f"""SELECT {_K}, CASE WHEN n > 0 AND failed THEN 'warning' ELSE 'info' END AS type,
            CASE WHEN n = 0 THEN 'No relevant past prompts found in your corpus' WHEN failed THEN 'Corpus-clarify failed: Timeout' || CASE WHEN {_K} % 10 = 0 THEN '(504)' ELSE '' END
                 WHEN k = 0 THEN 'Prompt is clear — no clarification proposed' ELSE k || ' clarifying question' || CASE WHEN k > 1 THEN 's' ELSE '' END || ' grounded in your corpus' END AS message,
            CASE WHEN n > 0 AND failed THEN substr('late ' || content, 1, 200) WHEN n > 0 AND k = 0 THEN 'clear' END AS suggestion, CASE WHEN n > 0 AND NOT failed AND k > 0 THEN k ELSE -1 END::BIGINT AS n_questions FROM clarified""", _CLARIFIED),
        "grounded_questions": v("SELECT a.prompt_id, CAST(pos AS BIGINT) AS pos, a.prompt_id + pos * 2 AS grounded_id, CASE WHEN pos < 2 THEN coalesce(substr(f.content, 1, 100), '') ELSE '' END AS snippet FROM (SELECT prompt_id, unnest([0, 1, 2]) AS pos FROM prompts WHERE role = 'user') a LEFT JOIN (SELECT * FROM prompts WHERE role = 'user') f ON f.prompt_id = a.prompt_id + a.pos * 2"),
        "generator_messages": v(f"""SELECT p.prompt_id, 'PROMPT:' || {nl} || '"' || p.content || '"' || {nl} || {nl} || coalesce('PAST PROMPTS (top retrieved from your corpus):' || {nl} || f.lines || {nl} || {nl}, '')
              || CASE WHEN p.prompt_id % 4 = 0 THEN 'PAST CLARIFICATIONS (concrete examples of how you typically nail down ambiguities):' || {nl} || '- (kind=constraint) "' || {_short('p.content', 600)} || '"' || {nl} || {nl} ELSE '' END
              || 'Use the submit_questions tool. Be honest about skip_reason if no clarification is warranted.' AS message
            FROM prompts p LEFT JOIN (SELECT q.prompt_id, string_agg('[id=' || n.prompt_id || '] (' || CASE WHEN n.project_id <> 2 THEN 'p' || n.project_id ELSE '?' END || ', turn ' || n.turn_index || '): "' || {_short('n.content', 600)} || '"', {nl} ORDER BY n.prompt_id) AS lines
              FROM prompts q JOIN prompts n ON n.session_id = q.session_id WHERE q.role = 'user' AND q.prompt_id % 3 <> 0 AND n.prompt_id % 1000 + 1 <= 8 GROUP BY 1) f ON f.prompt_id = p.prompt_id WHERE p.role = 'user'"""),
        "extractor_messages": v(f"""SELECT p.pair_id, 'ORIG: "' || {_short('o.content', 1500)} || '"' || {nl} || 'CLAR: "' || {_short('c.content', 1500)} || '"' || {nl} || 'RULE LABELER: kind=' || clarification_kind || ', extracted="' || substr(clarification_text, 1, 300) || '"' || {nl} || {nl}
            || 'Use the submit_verdict tool. Be honest about kind refinements; do not rubber-stamp.' AS message FROM pairs p JOIN prompts o ON o.prompt_id = originating_prompt_id JOIN prompts c ON c.prompt_id = clarifying_prompt_id WHERE extraction_method = 'rule'""", *O.PAIR_VIEWS),
        "session_tokens": v("SELECT session_id, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS tokens, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM prompts GROUP BY 1"),
    }
