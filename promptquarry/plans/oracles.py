"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions import vocabulary as V
from ..functions.regex import any_of, sql
from ..operators import checks
from .fixture import with_views

TRIM = sql(r"^\s+|\s+\z")


def rx(text: str, *patterns: str) -> str:
    return f"regexp_matches({text}, {sql(any_of(*patterns))})"


def sub(text: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({text}, {sql(pattern)}, '{by}', 'g')"


def trim(text: str) -> str:
    return f"regexp_replace({text}, {TRIM}, '', 'g')"


def normalized(text: str) -> str:
    text = f"lower({text})"
    for pattern in V.NOT_PROSE:
        text = sub(text, pattern)
    return trim(text)


def words(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in values) + "]"


def tags(text: str) -> dict[str, str]:
    found = {"files": V.FILES, "tests": V.TESTS, "criteria": V.CRITERIA, "constraints": V.CONSTRAINTS, "local_env": V.LOCAL_ENV, "shape": (V.SHAPE,), "ui": (V.UI,)}
    return {f"has_{k}": rx(text, *v) for k, v in found.items()}


def columns(named: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in named.items())


def distinct_in_order(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def files_in(text: str) -> str:
    return distinct_in_order(f"list_concat(regexp_extract_all({text}, {sql(V.FILE_NAME)}), regexp_extract_all({text}, {sql(V.DIRECTORY)}))")


def phrase(text: str, pattern: str) -> str:
    found = f"regexp_extract({text}, {sql(pattern)})"
    return f"CASE WHEN {found} <> '' THEN {trim(found)} END"


LOW_ALPHA = "coalesce(length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) / nullif(length(t), 0)::DOUBLE < 0.5 AND length(t) > 80, false)"
PASTED = " OR ".join(
    [f"starts_with(t, '{x}')" for x in (*V.HARNESS, V.LOGIN)]
    + [f"(starts_with(t, '{V.CAVEAT}') AND length(t) < {V.CAVEAT_LENGTH})", rx("t", V.SHELL_MAIN), rx("t", V.SHELL_ROOT)]
    + ["(" + rx("substr(t, 1, 120)", V.REPORT) + " AND " + rx("substr(t, 1, 120)", V.REPORT_OPENER) + ")"]
)
SYNTHETIC_LABEL = "(" + " OR ".join([
    PASTED, "t = ''", "(" + rx("t", V.SHELL_DOLLAR) + " AND " + rx("t", V.SHELL_PATH) + ")", rx("t", V.TEST_REPORT), rx("substr(t, 1, 80)", V.SMOKE_REPORT),
    "(" + rx("substr(t, 1, 120)", V.APP_SCRAPE) + " AND length(t) > 200)", rx("substr(split_part(t, chr(10), 1), 1, 80)", V.CAPS_HEADER), LOW_ALPHA,
]) + ")"
SYNTHETIC_SEARCH = "(" + " OR ".join([PASTED, "length(t) < 20", rx("t", V.COMPILED), *(rx("t", p) for p in V.OPENERS), LOW_ALPHA]) + ")"

FLAGGED = ("flagged", f"SELECT *, {SYNTHETIC_LABEL} AS synthetic, {SYNTHETIC_SEARCH} AS synthetic_search FROM (SELECT *, {trim('content')} AS t FROM prompts) x")
NORM = ("norm", f"SELECT *, {normalized('content')} AS normalized_content FROM prompts")


def terms(text: str, stop: tuple[str, ...], least: int = 3) -> str:
    parts = f"list_filter(string_split_regex({text}, '[^a-z0-9]+'), lambda w: length(w) >= {least} AND NOT list_contains({words(stop)}, w))"
    return distinct_in_order(parts)


RANKED = ("ranked_prompts", "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, prompt_id) AS ord FROM flagged WHERE role = 'user' AND eligible")
_BOTH = "FROM ranked_prompts o JOIN ranked_prompts c ON o.session_id = c.session_id AND c.ord BETWEEN o.ord + 1 AND o.ord + 3 WHERE NOT o.synthetic AND NOT c.synthetic AND length(o.content) >= 40"
_NEW = f"list_filter({files_in('c.content')}, lambda f: NOT list_contains({files_in('o.content')}, f))"
_RULES = (
    ("files", "file-scope", V.FILES, f"CASE WHEN len({_NEW}) > 0 THEN 'added file(s): ' || array_to_string(({_NEW})[1:6], ', ') END"),
    ("criteria", "success-criteria", V.CRITERIA, phrase("c.content", V.CRITERIA_PHRASE)),
    ("constraints", "constraint", V.CONSTRAINTS, phrase("c.content", V.CONSTRAINT_PHRASE)),
    ("tests", "success-criteria", V.TESTS, phrase("c.content", V.TESTS_PHRASE)),
    ("shape", "data-shape", (V.PAIR_SHAPE,), phrase("c.content", V.SHAPE_PHRASE)),
    ("ui", "ui-detail", (V.PAIR_UI,), phrase("c.content", V.UI_PHRASE)),
)
RULE_PAIRS = ("rule_pairs", " UNION ALL ".join(
    f"SELECT * FROM (SELECT o.session_id, o.prompt_id AS originating_prompt_id, c.prompt_id AS clarifying_prompt_id, '{kind}' AS clarification_kind, "
    f"{text} AS clarification_text, CAST({V.CONFIDENCE[rule]} AS DOUBLE) AS confidence, '{rule}' AS rule {_BOTH} AND {rx('c.content', *gate)} AND NOT {rx('o.content', *gate)}) x WHERE clarification_text IS NOT NULL"
    for rule, kind, gate, text in _RULES
))
_BASE = ("based", "SELECT *, originating_prompt_id * 100000 + (clarifying_prompt_id - originating_prompt_id) * 10 + CASE rule WHEN 'files' THEN 1 WHEN 'criteria' THEN 2 WHEN 'constraints' THEN 3 WHEN 'tests' THEN 4 WHEN 'shape' THEN 5 ELSE 6 END AS k FROM rule_pairs")
_PAIR = "session_id, originating_prompt_id, clarifying_prompt_id, {kind} AS clarification_kind, clarification_text, '{method}' AS extraction_method, 'v1' AS extractor_version, {confidence} AS confidence, {reason} AS reason FROM based"
PAIRS = ("pairs", " UNION ALL ".join([
    "SELECT k * 10 AS pair_id, " + _PAIR.format(kind="clarification_kind", method="rule", confidence="confidence", reason="CAST(NULL AS VARCHAR)"),
    "SELECT k * 10 + 1 AS pair_id, " + _PAIR.format(kind="clarification_kind", method="llm", confidence="0.5::DOUBLE + (k % 5) / 10.0::DOUBLE", reason="CASE WHEN k % 2 = 0 THEN 'because' END") + " WHERE k % 3 <> 0",
    "SELECT k * 10 + 2 AS pair_id, " + _PAIR.format(kind="CASE WHEN k % 14 <> 0 THEN clarification_kind END", method="manual", confidence="CAST(NULL AS DOUBLE)", reason="CAST(NULL AS VARCHAR)") + " WHERE k % 7 = 0",
]))
PAIR_VIEWS = (FLAGGED, RANKED, RULE_PAIRS, _BASE, PAIRS)

CONTENTS = ("contents", "SELECT p.*, coalesce(o.normalized_content, '') AS orig_norm, coalesce(c.normalized_content, '') AS clar_norm, o.turn_index AS orig_turn, c.turn_index AS clar_turn, o.project_id FROM pairs p JOIN norm o ON o.prompt_id = p.originating_prompt_id JOIN norm c ON c.prompt_id = p.clarifying_prompt_id")
FOREIGN = ("foreign_projects", "SELECT * FROM projects WHERE name <> 'own-tool' AND (cwd IS NULL OR NOT cwd ILIKE '%own-tool%')")
LABEL_VIEWS = (*PAIR_VIEWS, NORM, CONTENTS, FOREIGN)

SNAPSHOTS = ("snapshots", "SELECT doc_id AS snapshot_id, CASE WHEN doc_id % 2 = 0 THEN 'cowork-outputs' ELSE 'trash-snapshot' END AS snapshot_type, CASE WHEN doc_id % 2 = 0 THEN (doc_id // 2) % ((SELECT max(session_id) FROM sessions) + 1) END AS session_id FROM documents")
FILES = ("files", "SELECT doc_id AS snapshot_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) x WHERE line <> ''")
OVERLAP = ("overlap", """
    SELECT *, common / (n1 + n2 - common)::DOUBLE AS jaccard FROM (
      SELECT a.snapshot_id AS left_id, b.snapshot_id AS right_id, count(*) AS common, any_value(a.n) AS n1, any_value(b.n) AS n2
      FROM (SELECT d.*, count(*) OVER (PARTITION BY snapshot_id) AS n FROM (SELECT DISTINCT * FROM files) d) a
      JOIN (SELECT d.*, count(*) OVER (PARTITION BY snapshot_id) AS n FROM (SELECT DISTINCT * FROM files) d) b USING (line)
      JOIN snapshots sa ON sa.snapshot_id = a.snapshot_id AND sa.snapshot_type = 'cowork-outputs'
      JOIN snapshots sb ON sb.snapshot_id = b.snapshot_id AND sb.snapshot_type = 'trash-snapshot'
      GROUP BY 1, 2) x""")
SUCCESSORS = ("successors", "SELECT session_id, project_id, lead(session_id) OVER w AS successor_session_id, lead(session_id) OVER w IS NULL AS is_latest, coalesce(ended_at, started_at) AS at, started_at FROM sessions WHERE eligible WINDOW w AS (PARTITION BY project_id ORDER BY coalesce(ended_at, started_at), started_at, session_id)")
LATEST = ("latest", "SELECT session_id, max(snapshot_id) AS snapshot_id FROM snapshots WHERE snapshot_type = 'cowork-outputs' GROUP BY 1")
HITS = ("hits", "SELECT left_id, min(right_id) AS right_id, arg_min(jaccard, right_id) AS jaccard FROM overlap WHERE jaccard >= 0.5 AND left_id IN (SELECT snapshot_id FROM latest) GROUP BY 1")
OUTCOMES = ("outcomes", """
    SELECT s.session_id, CASE WHEN h.left_id IS NOT NULL THEN 'rejected' WHEN l.snapshot_id IS NOT NULL AND is_latest THEN 'accepted' WHEN l.snapshot_id IS NOT NULL THEN 'iterated' ELSE 'unknown' END AS outcome,
           h.left_id IS NOT NULL AS is_in_trash, NOT is_latest AS has_successor, successor_session_id, coalesce(t.n, 0) AS turn_count
    FROM successors s LEFT JOIN latest l ON l.session_id = s.session_id LEFT JOIN hits h ON h.left_id = l.snapshot_id
    LEFT JOIN (SELECT session_id, count(*) AS n FROM prompts WHERE role = 'user' GROUP BY 1) t ON t.session_id = s.session_id""")
OUTCOME_VIEWS = (SNAPSHOTS, FILES, OVERLAP, SUCCESSORS, LATEST, HITS, OUTCOMES)

GROUPS = ("replays", f"SELECT session_id, normalized_content, min(prompt_id) AS canonical_id, count(*) AS n FROM norm WHERE role = 'user' AND length({trim('normalized_content')}) >= 10 GROUP BY 1, 2 HAVING count(*) > 1")
CANONICAL = ("canonical", "SELECT p.prompt_id, g.canonical_id FROM norm p JOIN replays g USING (session_id, normalized_content) WHERE p.role = 'user' AND p.prompt_id <> g.canonical_id")

CASES = ("cases", f"""
    SELECT pair_id AS case_id, CASE WHEN pair_id % 11 <> 0 THEN clarification_kind END AS gold_kind, CASE WHEN pair_id % 11 <> 0 THEN clarification_text ELSE '__rejected__' END AS gold_text, o.content AS prompt,
           list_filter([
             CASE WHEN pair_id % 2 = 1 THEN {{'text': 'does ''it'' mean ' || substr(clarification_text, 1, 30), 'kind': 'file-scope', 'confidence': (pair_id % 10) / 10.0::DOUBLE}} END,
             CASE WHEN pair_id % 3 <> 0 THEN {{'text': 'live on production or local src/ ' || substr(o.content, 1, 40), 'kind': 'success-criteria', 'confidence': 0.5::DOUBLE}} END,
             CASE WHEN pair_id % 4 <> 0 THEN {{'text': clarification_text, 'kind': 'constraint', 'confidence': (pair_id % 7) / 10.0::DOUBLE}} END,
             CASE WHEN pair_id % 5 = 0 THEN {{'text': 'anything else to know?', 'kind': 'other', 'confidence': 0.9::DOUBLE}} END], lambda q: q IS NOT NULL) AS questions
    FROM pairs JOIN prompts o ON o.prompt_id = originating_prompt_id WHERE extraction_method = 'llm'""")
_TOK = lambda t: terms(f"lower(coalesce({t}, ''))", V.SCORE_STOP)
SCORED = ("scored", f"""
    SELECT case_id, gold_kind, pos, kind, kind_match, CASE WHEN kind_match THEN greatest(j, 0.5) ELSE j END AS combined FROM (
      SELECT *, coalesce(kind = gold_kind, false) AS kind_match, coalesce(len(list_intersect(q, g)) / nullif(len(list_distinct(list_concat(q, g))), 0)::DOUBLE, 0) AS j FROM (
        SELECT case_id, gold_kind, pos, kind, {_TOK('text')} AS q, {_TOK('gold_text')} AS g FROM (
          SELECT case_id, gold_kind, gold_text, q.text AS text, q.kind AS kind, row_number() OVER (PARTITION BY case_id ORDER BY q.confidence DESC NULLS LAST, i) AS pos
          FROM (SELECT case_id, gold_kind, gold_text, unnest(questions) AS q, unnest(range(len(questions))) AS i FROM cases) u) r WHERE pos <= 3) t) s""")
SCORES = ("scores", """
    SELECT c.case_id, c.gold_kind, len(c.questions) AS proposed, coalesce(max(combined) FILTER (pos = 1), 0) AS overlap_at_1, coalesce(max(combined), 0) AS overlap_at_3,
           coalesce(bool_or(kind_match) FILTER (pos = 1), false) AS kind_match_top1, coalesce(bool_or(kind_match), false) AS kind_match_any
    FROM cases c LEFT JOIN scored s ON s.case_id = c.case_id GROUP BY 1, 2, 3""")
SCORE_VIEWS = (*PAIR_VIEWS, CASES, SCORED, SCORES)
INSTRUMENTS = ("instruments", f"""
    SELECT case_id, {rx('prompt', V.VAGUE_VERB)} AS vague_verb, len(list_filter(questions, lambda q: {rx('q.text', *V.DISAMBIGUATION)})) > 0 AS has_disambiguation,
           coalesce({rx('questions[2].text', V.LIVE)} AND {rx('questions[2].text', V.LOCAL)}, false) AS live_or_local, CASE WHEN gold_kind IS NULL THEN len(questions) = 0 END AS correct_skip FROM cases""")

SEARCHES = ("searches", "SELECT prompt_id AS query_id, content AS text, CASE WHEN session_id % 20 <> 0 THEN project_id END AS scope FROM prompts WHERE prompt_id % 100 = 0")
_FOLD = "translate(lower(normalized_content), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
SEARCH_VIEWS = (
    FLAGGED, NORM, FOREIGN, SEARCHES,
    ("docs", f"SELECT prompt_id, project_id, list_filter(string_split_regex({_FOLD}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM norm WHERE role = 'user' AND eligible"),
    ("postings", "SELECT term, prompt_id, project_id, length, count(*) AS tf FROM (SELECT prompt_id, project_id, len(words) AS length, unnest(words) AS term FROM docs) x GROUP BY ALL"),
    ("wanted", f"SELECT query_id, scope, unnest({terms(normalized('text'), V.SEARCH_STOP)}) AS term FROM searches"),
    ("ranked", """SELECT query_id, w.scope, p.prompt_id, p.project_id, -sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))) AS rank
        FROM wanted w JOIN postings p USING (term) JOIN (SELECT term, count(*) AS df FROM postings GROUP BY 1) f USING (term), (SELECT count(*) AS n, avg(len(words)) AS avg FROM docs) s
        WHERE p.project_id IN (SELECT project_id FROM foreign_projects) GROUP BY ALL"""),
)
_ORDER = "OVER (PARTITION BY query_id ORDER BY round(rank, 9), prompt_id)"


def _cut(source: str, most: str) -> str:
    """Over-retrieve, filter, cut."""
    near = f"SELECT *, row_number() {_ORDER} AS rn FROM {source}"
    kept = f"SELECT n.* EXCLUDE (rn) FROM ({near}) n JOIN flagged f ON f.prompt_id = n.prompt_id WHERE rn <= 4 * ({most}) AND NOT f.synthetic_search"
    return f"SELECT * FROM (SELECT *, row_number() {_ORDER} AS pos FROM ({kept}) k) z WHERE pos <= {most}"


_NTH = "doc_id // 4 % 5 + 1"
CONTEXT = f"(SELECT doc_id % 4 AS project_id, (['PROJECT.md', 'SOUL.md', 'AGENTS.md', 'CONTEXT.md', 'README.md'])[{_NTH}] AS name, doc_id // 4 AS position, text AS content, ([1.0, 0.7, 0.8, 0.9, 0.6])[{_NTH}]::DOUBLE AS relevance, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents)"


def _keyword_list(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace(lower({text}), {sql(chr(91) + '^' + chr(92) + 'w' + chr(92) + 's]')}, ' ', 'g'), {sql(chr(92) + 's+')}, ' ', 'g'), ' '), lambda w: length(w) > 3 AND NOT list_contains({words(V.KEYWORD_STOP)}, w))"


def _keywords(text: str) -> str:
    return distinct_in_order(_keyword_list(text))


_FIT = f"""
  SELECT prompt_id, name, relevance, position, content, tokens, budget, total, total <= budget AS fits,
         coalesce(min(total <= budget) OVER (PARTITION BY prompt_id ORDER BY relevance DESC, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS all_before, budget - (total - tokens) AS rest
  FROM (SELECT p.prompt_id, f.*, 1500 - CAST(ceil(length(p.content) / 4.0) AS BIGINT) - 100 AS budget, sum(tokens) OVER (PARTITION BY prompt_id ORDER BY relevance DESC, position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
        FROM prompts p JOIN {CONTEXT} f ON f.project_id = p.project_id WHERE p.role = 'user') x"""
_CUT_TEXT = "CASE WHEN fits THEN content ELSE (CASE WHEN length(content) > rest * 4 THEN substr(content, 1, CAST(rest * 4 AS BIGINT)) || chr(10) || '... (truncated)' ELSE content END) || chr(10) || '... (truncated due to context limit)' END"

_ISSUES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {rx('content', p)} THEN '{label}' END" for p, label in zip(V.LOCAL_ENV, V.LOCAL_ENV_LABELS)) + "], lambda x: x IS NOT NULL), '@@')"


def _sanitized() -> str:
    """Ports in two steps, as RE2 has no lookahead: kept ones are marked, the rest replaced, the marks removed."""
    text = sub("content", V.HOME_PATHS, "<USER_HOME>")
    for port in V.KEPT_PORTS:
        text = rf"regexp_replace({text}, 'localhost:{port}($|[^0-9])', 'localhost:~{port}\1', 'g')"
    text = sub(text, V.LOCAL_PORT, "localhost:<PORT>")
    text = f"replace({text}, 'localhost:~', 'localhost:')"
    text = sub(text, r"(?i:(api[_-]?key|token|secret|password)\s*[:=]\s*['\"\w-]+)", r"\1: <REDACTED>")
    text = sub(text, r"\/\w+\/\w+\/[^\s]+\.(?:js|ts|json|md)", "<LOCAL_PATH>")
    return sub(text, r"(?i:(hostname|computer name|machine|device):\s*\w+)", r"\1: <MACHINE>")


def _operation(name: str) -> str:
    low = f"lower({name})"
    return f"CASE WHEN {low} LIKE '%edit' THEN 'edit' WHEN {low} LIKE '%write' THEN 'write' WHEN {low} LIKE '%read' THEN 'read' WHEN {low} IN ('bash', 'grep', 'glob') THEN {low} WHEN {low} LIKE '%search%' THEN 'search' ELSE 'other' END"


def _title(title: str) -> str:
    return trim(sub(f"regexp_replace(regexp_replace(lower({title}), {sql(V.TITLE_PREFIX)}, ''), '[—–]', '-', 'g')", r"\s+"))


_BASENAME = "list_filter(string_split(cwd, '/'), lambda p: p <> '')[-1]"
_PROJECT_KEY = f"""CASE WHEN source = 'cowork' THEN CASE WHEN coalesce(title, '') <> '' THEN 'cowork:' || substr(sha1({_title('title')}), 1, 16) WHEN coalesce(scheduled_task_id, '') <> '' THEN 'cowork-sched:' || scheduled_task_id ELSE 'cowork:' || session_id END
  WHEN coalesce(cwd, '') <> '' THEN 'cwd:' || coalesce({_BASENAME}, 'root') || ':' || substr(sha1(cwd), 1, 8) ELSE 'unknown:' || session_id END"""


def _check_rows() -> str:
    out = []
    tagged = {"files-mentioned": "has_files", "tests-mentioned": "has_tests", "success-criteria": "has_criteria", "constraints": "has_constraints"}
    # fixed values: texts of the checks, as in the registry
    said = {
        "files-mentioned": ("warning", "No specific files mentioned", 'Add file paths like "src/auth/**" or "update login.js"'),
        "tests-mentioned": ("warning", "No tests or validation criteria mentioned", 'Add "include tests" or "should handle X cases"'),
        "success-criteria": ("warning", "No clear success criteria", 'Add "should pass all tests" or "must handle 10k req/s"'),
        "constraints": ("info", "No constraints mentioned", "Consider adding \"don''t break existing API\" or \"keep under 100 lines\""),
    }
    for check, tag in tagged.items():
        kind, message, advice = said[check]
        out.append(f"SELECT prompt_id, '{check}' AS check_id, '{kind}' AS type, '{message}' AS message, '{advice}' AS suggestion FROM own WHERE NOT {tags('content')[tag]}")
    issues = _ISSUES.replace("@@", ", ")
    out.append(f"SELECT prompt_id, 'local-env', 'warning', 'Prompt contains local environment references', 'Remove: ' || {issues} || '. Use relative paths and generic config instead.' FROM own WHERE {issues} <> ''")
    out.append(_window_rows(4000))
    return " UNION ALL ".join(out)


def _window_rows(limit: int) -> str:
    total = "(CAST(ceil(length(content) / 4.0) AS BIGINT) + context_tokens)"
    return f"""SELECT prompt_id, 'context-window' AS check_id, CASE WHEN {total} > {limit} THEN 'error' ELSE 'warning' END AS type,
      CASE WHEN {total} > {limit} THEN 'Context window will be exceeded (~' ELSE 'Approaching context limit (~' END || {total} || ' tokens)' AS message,
      CASE WHEN {total} > {limit} THEN 'Reduce context files or truncate content. Current: ' || context_files || ' files, ' || context_tokens || ' tokens of context. Try removing less relevant .md files.'
           ELSE 'Consider truncating context files or removing less relevant ones. Leave room for AI response.' END AS suggestion
      FROM own WHERE {total} > {limit} * 0.8"""


OWN = ("own", "SELECT prompt_id, content, prompt_id % 40 * 100 AS context_tokens, prompt_id % 5 AS context_files FROM prompts WHERE role = 'user'")
_N = "CAST(sum(CASE WHEN {} THEN 1 ELSE 0 END) AS BIGINT)"


_IP6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?"
_PHONE = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d){7,12}"


def _scrubbed() -> str:
    """RE2 has no lookaround: what must stand beside a match is matched with it and put back. As one such character may
    stand between two matches, these steps are taken twice."""
    rows = "SELECT doc_id, ' ' || text || ' ' AS t FROM documents"
    step = lambda by: f"SELECT doc_id, {by} AS t FROM ({rows}) x"
    for pattern, by in (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
        (r"\b(?:sk-|pk-|sk_|pk_|(?i:api[_-]?key)=)[A-Za-z0-9_-]{16,}|\bAKIA[A-Z0-9]{16,}", "<KEY>"),
        (r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", "<CARD>"),
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    ):
        rows = step(sub("t", pattern, by))
    found = f"'[^\\w:](?:{_IP6})[^\\w:]'"
    for _ in range(2):
        gaps, values = f"string_split_regex(t, {found})", f"regexp_extract_all(t, {found})"
        rows = f"SELECT doc_id, CASE WHEN len(vs) = 0 THEN t ELSE array_to_string(list_transform(gs, lambda g, i: g || coalesce(CASE WHEN regexp_matches(vs[i], '[0-9]') THEN substr(vs[i], 1, 1) || '<IP>' || substr(vs[i], length(vs[i]), 1) ELSE vs[i] END, '')), '') END AS t FROM (SELECT doc_id, t, {gaps} AS gs, {values} AS vs FROM ({rows}) x) y"
    for _ in range(2):
        rows = step(f"regexp_replace(t, '([^\\w.+-])(?:{_PHONE})([^\\w-])', '\\1<PHONE>\\2', 'g')")
    rows = step(sub("t", r"/(?:Users|home)/\w+|[A-Z]:\\Users\\\w+", "<HOME>"))
    return f"SELECT doc_id, substr(t, 2, length(t) - 2) AS scrubbed FROM ({rows}) x"


def _report() -> str:
    fact = lambda section, key, metric, value, rest: f"SELECT '{section}' AS section, coalesce(CAST({key} AS VARCHAR), '?') AS key, '{metric}' AS metric, CAST({value} AS BIGINT) AS value FROM {rest}"
    users = "(SELECT p.project_id AS k, count(CASE WHEN r.role = 'user' THEN 1 END) AS n, count(DISTINCT s.session_id) AS m FROM projects p JOIN sessions s ON s.project_id = p.project_id AND s.eligible JOIN prompts r ON r.session_id = s.session_id GROUP BY 1 ORDER BY 2 DESC, CAST(p.project_id AS VARCHAR) LIMIT 5) x"
    calls = f"(SELECT {_operation('n')} AS k FROM (SELECT concat(event_type, CASE WHEN event_id % 3 = 0 THEN 'Edit' ELSE '' END) AS n FROM events) y) z"
    shots = "(SELECT snapshot_type AS k, count(*) AS a, sum(n) AS b, sum(b) AS c FROM snapshots JOIN (SELECT snapshot_id, count(*) AS n, sum(strlen(line)) AS b FROM files GROUP BY 1) f USING (snapshot_id) GROUP BY 1) x"
    dense = "(SELECT p.project_id AS k, count(*) AS a, count(DISTINCT clarification_kind) AS b, count(DISTINCT r.session_id) AS c FROM rule_pairs r JOIN prompts p ON p.prompt_id = r.originating_prompt_id JOIN projects j ON j.project_id = p.project_id GROUP BY 1 ORDER BY 2 DESC, CAST(p.project_id AS VARCHAR) LIMIT 10) x"
    sources = "(SELECT source AS k, count(DISTINCT s.session_id) AS a, count(p.prompt_id) AS b FROM sessions s LEFT JOIN prompts p ON p.session_id = s.session_id GROUP BY 1) x"
    roles = "(SELECT role AS k, count(*) AS a, count(*) FILTER (s.eligible) AS b FROM prompts p JOIN sessions s ON s.session_id = p.session_id GROUP BY 1) x"
    inside = "user_type IS NOT NULL AND user_type <> 'external' AND scheduled_task_id IS NULL"
    rows = [fact("sources", "k", "sessions", "a", sources), fact("sources", "k", "events", "b", sources), fact("roles", "k", "total", "a", roles), fact("roles", "k", "eligible", "b", roles)]
    for metric, condition in (("total", "true"), ("eligible", "eligible"), ("excluded", "NOT eligible"), ("scheduled", "scheduled_task_id IS NOT NULL"), ("non_external", inside)):
        rows.append(fact("sessions", "'all'", metric, f"count(*) FILTER ({condition})", "sessions"))
    rows += [fact("projects", "k", "user_prompts", "n", users), fact("projects", "k", "sessions", "m", users), fact("tools", "'all'", "calls", "count(*)", "events")]
    rows.append(fact("operations", "k", "calls", "n", f"(SELECT k, count(*) AS n FROM {calls} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) o"))
    rows += [fact("snapshots", "k", m, x, shots) for m, x in (("snapshots", "a"), ("files", "b"), ("bytes", "c"))]
    rows.append(fact("outcomes", "k", "sessions", "n", "(SELECT outcome AS k, count(*) AS n FROM outcomes GROUP BY 1) x"))
    rows.append(fact("kinds", "k", "pairs", "n", "(SELECT clarification_kind AS k, count(*) AS n FROM rule_pairs GROUP BY 1) x"))
    rows += [fact("pairs", "k", m, x, dense) for m, x in (("pairs", "a"), ("kinds", "b"), ("sessions", "c"))]
    return with_views(" UNION ALL ".join(f"({r})" for r in rows), *OUTCOME_VIEWS, FLAGGED, RANKED, RULE_PAIRS)


def oracle_sql() -> dict[str, str]:
    v = with_views
    key = "session_id, orig_norm, clar_norm"
    done = f"SELECT DISTINCT {key} FROM contents WHERE extraction_method = 'manual'"
    head = "'### From ' || name || ':' || chr(10) || c || chr(10) || chr(10)"
    out = {
        "normalize_text": v(f"SELECT prompt_id, {normalized('content')} AS normalized FROM prompts"),
        "tag_prompts": v(f"SELECT prompt_id, {columns(tags('content'))} FROM prompts"),
        "tag_documents": f"SELECT doc_id, {columns(tags('text'))} FROM documents",
        "alpha_ratio": "SELECT doc_id, round(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / nullif(length(text), 0)::DOUBLE, 6) AS ratio FROM documents",
        "synthetic_filter_label": v("SELECT prompt_id, synthetic FROM flagged", FLAGGED),
        "synthetic_filter_retrieval": v("SELECT prompt_id, synthetic_search AS synthetic FROM flagged", FLAGGED),
        "extract_files": v(f"SELECT prompt_id, array_to_string({files_in('content')}, ',') AS files FROM prompts"),
        "extract_phrases": v("SELECT prompt_id, " + columns({k: phrase("content", p) for k, p in (("criteria", V.CRITERIA_PHRASE), ("constraint_text", V.CONSTRAINT_PHRASE), ("shape", V.SHAPE_PHRASE), ("ui", V.UI_PHRASE), ("tests", V.TESTS_PHRASE))}) + " FROM prompts"),
        "sanitize_context": v(f"SELECT prompt_id, {_sanitized()} AS sanitized FROM prompts"),
        "token_estimate": "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents",
        "truncate_context": "SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '... (truncated)' ELSE text END AS content FROM documents",
        "tool_operation": f"SELECT event_type, {_operation('event_type')} AS operation, count(*) AS n FROM events GROUP BY event_type",
        "project_ids": v(f"SELECT session_id, {_PROJECT_KEY} AS project_key, coalesce(nullif(title, ''), {_BASENAME}, nullif(scheduled_task_id, ''), 'unknown') AS project_name FROM sessions"),
        "title_normalize": v(f"SELECT session_id, {_title('title')} AS title FROM sessions"),
        "local_env_issues": v(f"SELECT prompt_id, {_ISSUES.replace('@@', ';')} AS issues FROM prompts"),
        "vague_verb": v(f"SELECT prompt_id, {rx('content', V.VAGUE_VERB)} AS vague FROM prompts"),
        "search_terms": v(f"SELECT prompt_id, array_to_string({terms(normalized('content'), V.SEARCH_STOP)}, ' ') AS terms FROM prompts"),
        "score_tokens": v(f"SELECT prompt_id, array_to_string({_TOK('content')}, ' ') AS tokens FROM prompts"),
        "source_counts": v("SELECT source, count(DISTINCT s.session_id) AS sessions, count(p.prompt_id) AS events FROM sessions s LEFT JOIN prompts p ON p.session_id = s.session_id GROUP BY source"),
        "session_eligibility": v(f"SELECT count(*) AS total, {_N.format('eligible')} AS eligible, {_N.format('NOT eligible')} AS excluded, {_N.format('scheduled_task_id IS NOT NULL')} AS scheduled, " + _N.format("user_type IS NOT NULL AND user_type <> 'external' AND scheduled_task_id IS NULL") + " AS non_external FROM sessions"),
        "stats_report": _report(),
        "top_projects": v("SELECT p.project_id, p.name, count(CASE WHEN r.role = 'user' THEN 1 END) AS user_prompt_count, count(DISTINCT s.session_id) AS session_count FROM projects p JOIN sessions s ON s.project_id = p.project_id AND s.eligible JOIN prompts r ON r.session_id = s.session_id GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 5"),
        "role_counts": v(f"SELECT role, count(*) AS total, {_N.format('s.eligible')} AS eligible FROM prompts p JOIN sessions s ON s.session_id = p.session_id GROUP BY role"),
        "operation_histogram": f"SELECT operation, count(*) AS n FROM (SELECT {_operation('n')} AS operation FROM (SELECT concat(event_type, CASE WHEN event_id % 3 = 0 THEN 'Edit' ELSE '' END) AS n FROM events) x) y GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "snapshot_totals": v("SELECT snapshot_type, count(*) AS snapshots, CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS bytes FROM snapshots JOIN (SELECT snapshot_id, count(*) AS n, sum(strlen(line)) AS b FROM files GROUP BY 1) f USING (snapshot_id) GROUP BY 1", SNAPSHOTS, FILES),
        "pair_density": v("SELECT p.project_id, j.name, count(*) AS pairs, count(DISTINCT clarification_kind) AS kinds, count(DISTINCT r.session_id) AS sessions FROM rule_pairs r JOIN prompts p ON p.prompt_id = r.originating_prompt_id JOIN projects j ON j.project_id = p.project_id GROUP BY 1, 2", FLAGGED, RANKED, RULE_PAIRS),
        "kind_histogram": v("SELECT clarification_kind, count(*) AS n FROM pairs GROUP BY 1", *PAIR_VIEWS),
        "random_prompts": v("SELECT project_id, prompt_id, session_id, turn_index, substr(regexp_replace(content, '[ \\t\\n\\r]+', ' ', 'g'), 1, 200) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY md5(prompt_id || ':sample-1'), prompt_id) AS rn FROM prompts WHERE role = 'user' AND eligible AND length(content) > 20) x WHERE rn <= 3"),
        "lookahead_pairs": v("SELECT o.session_id, o.prompt_id AS originating_prompt_id, c.prompt_id AS clarifying_prompt_id, c.ord - o.ord AS step FROM ranked_prompts o JOIN ranked_prompts c ON o.session_id = c.session_id AND c.ord BETWEEN o.ord + 1 AND o.ord + 3", FLAGGED, RANKED),
        "clarifying_pairs": v("SELECT * FROM rule_pairs", FLAGGED, RANKED, RULE_PAIRS),
        "successor_sessions": v("SELECT session_id, project_id, successor_session_id, is_latest FROM successors", SUCCESSORS),
        "trash_jaccard": v("SELECT left_id, right_id, round(jaccard, 6) AS jaccard FROM overlap WHERE round(jaccard, 6) >= 0.5", SNAPSHOTS, FILES, OVERLAP),
        "session_outcomes": v("SELECT * FROM outcomes", *OUTCOME_VIEWS),
        "outcome_histogram": v("SELECT outcome, count(*) AS n FROM outcomes GROUP BY 1", *OUTCOME_VIEWS),
        "trash_remap": v("SELECT snapshot_id, project_id FROM (SELECT h.right_id AS snapshot_id, s.project_id, row_number() OVER (PARTITION BY h.right_id ORDER BY h.jaccard DESC, s.project_id, s.at, s.started_at, s.session_id) AS rn FROM hits h JOIN latest l ON l.snapshot_id = h.left_id JOIN successors s ON s.session_id = l.session_id) x WHERE rn = 1", *OUTCOME_VIEWS),
        "replay_groups": v("SELECT * FROM replays", NORM, GROUPS),
        "dedupe_prompts": v("SELECT prompt_id, session_id, turn_index, role FROM norm WHERE prompt_id NOT IN (SELECT prompt_id FROM canonical)", NORM, GROUPS, CANONICAL),
        "dedupe_pairs": v("SELECT pair_id, originating_prompt_id, clarifying_prompt_id, extraction_method FROM (SELECT *, row_number() OVER (PARTITION BY originating_prompt_id, clarifying_prompt_id, extraction_method, extractor_version ORDER BY pair_id) AS rn FROM (SELECT p.* REPLACE (coalesce(a.canonical_id, originating_prompt_id) AS originating_prompt_id, coalesce(b.canonical_id, clarifying_prompt_id) AS clarifying_prompt_id) FROM pairs p LEFT JOIN canonical a ON a.prompt_id = p.originating_prompt_id LEFT JOIN canonical b ON b.prompt_id = p.clarifying_prompt_id) x WHERE originating_prompt_id <> clarifying_prompt_id) y WHERE rn = 1", *PAIR_VIEWS, NORM, GROUPS, CANONICAL),
        "high_confidence": v("SELECT r.pair_id AS rule_pair_id, l.pair_id AS llm_pair_id, originating_prompt_id, clarification_kind, CASE WHEN r.confidence IS NOT NULL AND l.confidence IS NOT NULL THEN least(r.confidence, l.confidence) END AS confidence FROM (SELECT * FROM pairs WHERE extraction_method = 'rule') r JOIN (SELECT * FROM pairs WHERE extraction_method = 'llm') l USING (originating_prompt_id, clarification_kind)", *PAIR_VIEWS),
        "unlabeled_pairs": v(f"""SELECT r.pair_id, r.session_id, r.clarification_kind, r.confidence, b.clarification_kind AS rule_kind, b.clarification_text AS rule_text, j.name, r.all_llm_kinds, r.duplicate_count, r.orig_turn, r.clar_turn
            FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY confidence DESC NULLS LAST, pair_id) AS rn, count(*) OVER (PARTITION BY {key}) AS duplicate_count, array_to_string(list_sort(list_distinct(list(clarification_kind) OVER (PARTITION BY {key}))), ',') AS all_llm_kinds FROM contents WHERE extraction_method = 'llm') r
            JOIN foreign_projects j ON j.project_id = r.project_id
            LEFT JOIN (SELECT * FROM (SELECT *, max(confidence) OVER (PARTITION BY originating_prompt_id, clarifying_prompt_id) AS most FROM pairs WHERE extraction_method = 'rule') z WHERE confidence = most) b ON b.originating_prompt_id = r.originating_prompt_id AND b.clarifying_prompt_id = r.clarifying_prompt_id
            WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ({done}) d WHERE d.session_id = r.session_id AND d.orig_norm = r.orig_norm AND d.clar_norm = r.clar_norm)""", *LABEL_VIEWS),
        "wide_cases": v(f"SELECT session_id, pair_id, clarification_kind, clarification_text FROM (SELECT r.*, row_number() OVER (PARTITION BY originating_prompt_id, clarifying_prompt_id ORDER BY pair_id) AS rn FROM contents r JOIN foreign_projects j ON j.project_id = r.project_id WHERE extraction_method = 'llm' AND NOT EXISTS (SELECT 1 FROM ({done}) d WHERE d.session_id = r.session_id AND d.orig_norm = r.orig_norm AND d.clar_norm = r.clar_norm)) x WHERE rn = 1", *LABEL_VIEWS),
        "retry_missing": v("SELECT pair_id, originating_prompt_id, clarifying_prompt_id FROM pairs p WHERE extraction_method = 'rule' AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.extraction_method = 'llm' AND q.originating_prompt_id = p.originating_prompt_id)", *PAIR_VIEWS),
        "gold_progress": v(f"SELECT total, accepted, rejected, gold_total - total AS remaining, gold_total FROM (SELECT count(*) AS total, count(kind) AS accepted, count(*) - count(kind) AS rejected FROM (SELECT {key}, max(clarification_kind) AS kind FROM contents c JOIN foreign_projects USING (project_id) WHERE extraction_method = 'manual' AND extractor_version = 'v1' GROUP BY {key}) m), (SELECT count(DISTINCT session_id || '|' || orig_norm || '|' || clar_norm) AS gold_total FROM contents JOIN foreign_projects USING (project_id) WHERE extraction_method = 'llm')", *LABEL_VIEWS),
        "backfill_rows": v("SELECT p.pair_id, max(r.clarification_kind) AS rule_kind, max(r.clarification_text) AS rule_text FROM pairs p LEFT JOIN pairs r ON r.extraction_method = 'rule' AND r.originating_prompt_id = p.originating_prompt_id AND r.clarifying_prompt_id = p.clarifying_prompt_id WHERE p.extraction_method = 'llm' AND (p.reason IS NULL OR p.reason = '') GROUP BY 1", *PAIR_VIEWS),
        "pair_context": v("SELECT c.pair_id, p.prompt_id, p.turn_index, p.role FROM contents c JOIN prompts p ON p.session_id = c.session_id AND p.turn_index BETWEEN greatest(0, orig_turn - 5) AND clar_turn WHERE extraction_method = 'manual'", *LABEL_VIEWS),
        "balanced_sample": v("SELECT project_id, pair_id FROM (SELECT p.project_id, r.pair_id, row_number() OVER (PARTITION BY p.project_id ORDER BY md5(r.pair_id || ':pairs-1'), r.pair_id) AS rn FROM pairs r JOIN prompts p ON p.prompt_id = r.originating_prompt_id WHERE extraction_method = 'rule' AND p.project_id IN (SELECT project_id FROM pairs r2 JOIN prompts p2 ON p2.prompt_id = r2.originating_prompt_id WHERE extraction_method = 'rule' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)) x WHERE rn <= 4", *PAIR_VIEWS),
        "bm25_topk_nostem": v("SELECT query_id, prompt_id, round(rank, 6) AS rank, pos FROM (" + _cut("ranked", "5") + ") x", *SEARCH_VIEWS),
        "bm25_project_fallback": v(f"""SELECT query_id, prompt_id, round(rank, 6) AS rank, pos FROM inside
            UNION ALL SELECT query_id, prompt_id, round(rank, 6) AS rank, rn + have FROM (
              SELECT w.query_id, w.prompt_id, w.rank, n.have, n.missing, row_number() OVER (PARTITION BY w.query_id ORDER BY round(w.rank, 9), w.prompt_id) AS rn
              FROM ({_cut('(SELECT r.*, n.most FROM ranked r JOIN need n USING (query_id))', 'most')}) w JOIN need n ON n.query_id = w.query_id
              WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.query_id = w.query_id AND i.prompt_id = w.prompt_id)) x WHERE rn <= missing""",
            *SEARCH_VIEWS, ("inside", _cut("(SELECT * FROM ranked WHERE scope = project_id)", "6")),
            ("need", "SELECT s.query_id, coalesce(h.n, 0) AS have, 6 - coalesce(h.n, 0) AS missing, CASE WHEN scope IS NULL THEN 6 ELSE (6 - coalesce(h.n, 0)) * 3 END AS most FROM searches s LEFT JOIN (SELECT query_id, count(*) AS n FROM inside GROUP BY 1) h USING (query_id) WHERE scope IS NULL OR coalesce(h.n, 0) < 3")),
        "score_cases": v("SELECT case_id, gold_kind, proposed, round(overlap_at_1, 6) AS overlap_at_1, round(overlap_at_3, 6) AS overlap_at_3, kind_match_top1, kind_match_any FROM scores", *SCORE_VIEWS),
        "eval_aggregate": v("SELECT count(*) AS case_count, round(avg(overlap_at_1), 6) AS mean_overlap_at_1, round(avg(overlap_at_3), 6) AS mean_overlap_at_3, round(avg(kind_match_top1::INT), 6) AS kind_match_top1_rate, round(avg(kind_match_any::INT), 6) AS kind_match_any_rate FROM scores", *SCORE_VIEWS),
        "per_kind_overlap": v("SELECT gold_kind, count(*) AS n, round(avg(overlap_at_3), 6) AS mean_overlap_at_3 FROM scores WHERE gold_kind IS NOT NULL GROUP BY 1", *SCORE_VIEWS),
        "worst_cases": v("SELECT case_id, round(overlap_at_3, 6) AS overlap_at_3 FROM scores WHERE gold_kind IS NOT NULL ORDER BY scores.overlap_at_3, case_id LIMIT 3", *SCORE_VIEWS),
        "eval_instruments": v("SELECT * FROM instruments", *PAIR_VIEWS, CASES, INSTRUMENTS),
        "instrument_counts": v("SELECT count(*) AS cases, count(*) FILTER (vague_verb) AS vague_verb, count(*) FILTER (vague_verb AND has_disambiguation) AS asked_meaning, count(*) FILTER (live_or_local) AS live_or_local, count(*) FILTER (correct_skip) AS correct_skip FROM instruments", *PAIR_VIEWS, CASES, INSTRUMENTS),
        "budget_stop": v("SELECT run_id, case_id, round(spent_before, 6) AS spent_before FROM (SELECT *, coalesce(sum(cost) OVER (PARTITION BY run_id ORDER BY case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spent_before FROM (SELECT case_id, case_id % 3 AS run_id, (case_id % 5 + 1) / 10.0::DOUBLE AS cost FROM cases) c) x WHERE round(spent_before, 9) <= 0.75", *PAIR_VIEWS, CASES),
        "cost_estimate": "SELECT event_id, round(event_id * 10 / 1e6 * 3.0::DOUBLE + CASE WHEN event_id % 2 = 0 THEN event_id * 3 ELSE 0 END / 1e6 * 0.3::DOUBLE + CASE WHEN event_id % 3 <> 0 THEN event_id ELSE 0 END / 1e6 * 15.0::DOUBLE, 9) AS cost_usd FROM events",
        "check_pipeline": v(_check_rows(), OWN),
        "context_window_check": v(_window_rows(3000), OWN),
        "enhance_budget": v(f"SELECT prompt_id, name, NOT fits AS is_cut, length({_CUT_TEXT}) AS chars FROM ({_FIT}) x WHERE all_before AND (fits OR rest > 500)"),
        "enhance_prompts": v(f"""SELECT p.prompt_id, CASE WHEN p.project_id NOT IN (SELECT project_id FROM {CONTEXT} f) THEN p.content ELSE
              CASE WHEN h.head IS NOT NULL THEN '## Project Context' || chr(10) || chr(10) || h.head ELSE '' END || '## User Request' || chr(10) || chr(10) || p.content || chr(10) || chr(10) || '## Instructions' || chr(10) || chr(10) ||
              CASE WHEN h.head IS NOT NULL THEN '{checks.WITH_CONTEXT}' ELSE '{checks.WITHOUT_CONTEXT}' END END AS enhanced
            FROM prompts p LEFT JOIN (SELECT prompt_id, string_agg({head}, '' ORDER BY relevance DESC, position) AS head FROM (SELECT *, {_CUT_TEXT} AS c FROM ({_FIT}) x WHERE all_before AND (fits OR rest > 500)) y GROUP BY 1) h ON h.prompt_id = p.prompt_id WHERE p.role = 'user'"""),
        "context_relevance": v(
            "SELECT prompt_id, name, round(score, 6) AS score, coalesce(matched, '') AS matched, place FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY round(score, 9) DESC, position) AS place FROM scored_files) x WHERE place <= 3",
            ("wanted", f"SELECT prompt_id, project_id, {_keywords('content')} AS wanted FROM prompts WHERE role = 'user'"),
            ("context", f"SELECT project_id, name, position, relevance, length(content) AS length, list_distinct({_keyword_list('content')}) AS words FROM {CONTEXT} g"),
            ("common", "SELECT prompt_id, position, count(*) AS n, string_agg(word, ',' ORDER BY i) AS matched FROM (SELECT prompt_id, project_id, unnest(wanted) AS word, unnest(range(len(wanted))) AS i FROM wanted) p JOIN (SELECT project_id, position, unnest(words) AS word FROM context) f USING (project_id, word) GROUP BY 1, 2"),
            ("scored_files", "SELECT p.prompt_id, f.name, f.position, m.matched, coalesce(m.n, 0) / greatest(len(p.wanted), 1)::DOUBLE * 0.5 + f.relevance * 0.3 + least(f.length / 5000.0::DOUBLE, 1.0) * 0.2 AS score FROM wanted p JOIN context f ON f.project_id = p.project_id LEFT JOIN common m ON m.prompt_id = p.prompt_id AND m.position = f.position"),
        ),
        "tool_call_asof": "SELECT event_id, user_id, turn_event_id FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn_event_id FROM events) x WHERE event_type <> 'view' AND turn_event_id IS NOT NULL",
        "turn_numbers": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn_index FROM events WHERE event_type = 'view'",
        "event_props_json": "SELECT event_id, TRY_CAST(regexp_extract(props, '^\\s*\\{\\s*\"k\"\\s*:\\s*(-?[0-9]+)\\s*\\}\\s*$', 1) AS BIGINT) AS k FROM events",
        "pii_scrub": _scrubbed(),
    }
    return out
