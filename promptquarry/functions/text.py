"""Text functions as Column expressions: all of them stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .regex import any_of, java, java_ascii


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def matches(text: Column, *patterns: str) -> Column:
    pattern = any_of(*patterns)
    if r"\b" not in pattern:
        return text.rlike(java(pattern))
    return F.when(is_ascii(text), text.rlike(java_ascii(pattern))).otherwise(text.rlike(java(pattern)))


def replaced(text: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(text, java(pattern), by)


def trimmed(text: Column) -> Column:
    """Without white space in the wide sense at both ends."""
    return replaced(text, r"^\s+|\s+\z", "")


def normalized(text: Column) -> Column:
    """SCL1: lower case without fenced code, inline code and URLs, white space collapsed."""
    text = F.lower(text)
    for pattern in V.NOT_PROSE:
        text = replaced(text, pattern)
    return trimmed(text)


def prompt_tags(text: Column) -> dict[str, Column]:
    """SCL2: seven flags."""
    return {f"has_{k}": text.rlike(java(any_of(*v))) for k, v in V.QUICK_TAGS.items()}


def local_env_issues(text: Column) -> Column:
    """SCL3: labels of what ties a text to one machine, in fixed order."""
    labels = F.array(*[F.when(matches(text, p), F.lit(label)) for p, label in zip(V.LOCAL_ENV, V.LOCAL_ENV_LABELS)])
    return F.filter(labels, lambda x: x.isNotNull())


def files_in(text: Column) -> Column:
    """SCL4: file names, then directory paths, distinct in order of appearance."""
    every = [F.regexp_extract_all(text, F.lit(java(p)), F.lit(0)) for p in (V.FILE_NAME, V.DIRECTORY)]
    return F.array_distinct(F.concat(*every))


def first_phrase(text: Column, pattern: str) -> Column:
    """SCL5-9: the first match, trimmed; null where there is none."""
    found = F.regexp_extract(text, java(pattern), 0)
    return F.when(found != "", trimmed(found))


def alpha_ratio(text: Column) -> Column:
    """SCL10: share of ASCII letters; null for an empty text."""
    return F.try_divide(F.length(F.regexp_replace(text, "[^a-zA-Z]", "")).cast("double"), F.length(text).cast("double"))


def _low_alpha(t: Column) -> Column:
    return F.coalesce((alpha_ratio(t) < 0.5) & (F.length(t) > 80), F.lit(False))


def _pasted(t: Column) -> Column:
    """What both filters drop: harness text, log-ins and shells, re-pasted reports."""
    head = F.substring(t, 1, 120)
    opened = [t.startswith(x) for x in (*V.HARNESS, V.LOGIN)]
    opened += [t.startswith(V.CAVEAT) & (F.length(t) < V.CAVEAT_LENGTH), matches(t, V.SHELL_MAIN), matches(t, V.SHELL_ROOT)]
    return reduce(Column.__or__, opened) | (matches(head, V.REPORT) & matches(head, V.REPORT_OPENER))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it and wherever the optimizer moves the result."""
    return F.element_at(F.transform(F.array(value), f), 1)


def synthetic_for_labels(text: Column) -> Column:
    """SYN1: prompts that no person typed, for the extraction of pairs."""
    return once(trimmed(F.coalesce(text, F.lit(""))), _synthetic_label)


def _synthetic_label(t: Column) -> Column:
    first_line = F.substring(F.split(t, "\n", 2)[0], 1, 80)
    more = [
        t == "",
        matches(t, V.SHELL_DOLLAR) & matches(t, V.SHELL_PATH),
        matches(t, V.TEST_REPORT),
        matches(F.substring(t, 1, 80), V.SMOKE_REPORT),
        matches(F.substring(t, 1, 120), V.APP_SCRAPE) & (F.length(t) > 200),
        matches(first_line, V.CAPS_HEADER),
        _low_alpha(t),
    ]
    return reduce(Column.__or__, more, _pasted(t))


def synthetic_for_search(text: Column) -> Column:
    """SYN2: prompts that retrieval passes over. Its rules differ from SYN1's on purpose."""
    return once(trimmed(F.coalesce(text, F.lit(""))), _synthetic_search)


def _synthetic_search(t: Column) -> Column:
    return reduce(Column.__or__, [F.length(t) < 20, matches(t, V.COMPILED), *(matches(t, p) for p in V.OPENERS), _low_alpha(t)], _pasted(t))


def _words(text: Column, least: int, stop: tuple[str, ...]) -> Column:
    parts = F.filter(F.split(text, "[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.array_distinct(F.array_except(parts, F.array(*[F.lit(w) for w in stop])))


def search_terms(text: Column) -> Column:
    """SCL11: distinct terms of a query."""
    return _words(normalized(text), 3, V.SEARCH_STOP)


def score_tokens(text: Column) -> Column:
    """SCL12: distinct tokens for scoring."""
    return _words(F.lower(F.coalesce(text, F.lit(""))), 3, V.SCORE_STOP)


def keywords(text: Column) -> Column:
    """SCL13: distinct words of more than three characters, which are longest runs of word characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\w{4,}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in V.KEYWORD_STOP]))


def jaccard(a: Column, b: Column) -> Column:
    """SET1: of two arrays of distinct values; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def token_estimate(text: Column) -> Column:
    """SCL14: one token for each four characters begun."""
    return F.ceil(F.length(text) / 4).cast("long")


def sanitized(text: Column) -> Column:
    """SCL15: home folders, ports, secrets, paths and machines, in this order."""
    for pattern, by in V.SANITISED:
        text = replaced(text, pattern, by)
    return text


def truncated(text: Column, most: Column | int) -> Column:
    """SCL16."""
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), most), F.lit("\n... (truncated)"))).otherwise(text)


def relevance(name: Column) -> Column:
    """SCL17."""
    pairs = [F.lit(x) for kv in V.CONTEXT_FILES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(0.5))


def normalized_title(title: Column) -> Column:
    """SCL18."""
    return trimmed(replaced(replaced(replaced(F.lower(title), V.TITLE_PREFIX, ""), "[—–]", "-"), r"\s+"))


def _missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def project_id(source: Column, session_id: Column, title: Column, cwd: Column, scheduled: Column) -> Column:
    """SCL19: by title for one kind of source, by folder for the others."""
    parts = F.filter(F.split(cwd, "/"), lambda p: p != "")
    base = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("root"))
    by_title = (
        F.when(~_missing(title), F.concat(F.lit("cowork:"), F.substring(F.sha1(normalized_title(title)), 1, 16)))
        .when(~_missing(scheduled), F.concat(F.lit("cowork-sched:"), scheduled))
        .otherwise(F.concat(F.lit("cowork:"), session_id))
    )
    by_folder = F.when(~_missing(cwd), F.concat(F.lit("cwd:"), base, F.lit(":"), F.substring(F.sha1(cwd), 1, 8))).otherwise(F.concat(F.lit("unknown:"), session_id))
    return F.when(source == "cowork", by_title).otherwise(by_folder)


def project_name(title: Column, cwd: Column, scheduled: Column) -> Column:
    """SCL20."""
    base = F.try_element_at(F.filter(F.split(cwd, "/"), lambda p: p != ""), F.lit(-1))
    return F.coalesce(F.nullif(title, F.lit("")), base, F.nullif(scheduled, F.lit("")), F.lit("unknown"))


def tool_operation(name: Column) -> Column:
    """SCL21: by the end of the name for three of them, by the whole name or a part for the rest."""
    low = F.lower(name)
    out = F.when(low.endswith("edit"), "edit")
    for ending in ("write", "read"):
        out = out.when(low.endswith(ending), ending)
    for whole in ("bash", "grep", "glob"):
        out = out.when(low == whole, whole)
    return out.when(low.contains("search"), "search").otherwise("other")


def iso_time(value: Column) -> Column:
    """SCL22: epoch milliseconds or a date in another form become ISO; ISO strings stay as they are. value: variant."""
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    millis = F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double").cast("long"))
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), text), F.when(F.coalesce(text, F.lit("")) != "", iso(F.try_to_timestamp(text))), iso(F.timestamp_millis(millis))
    )


def scheduled_task(text: Column) -> Column:
    """SCL24."""
    return F.nullif(F.regexp_extract(text, java(V.SCHEDULED), 1), F.lit(""))


def trash_project(name: Column) -> Column:
    """SCL25."""
    base = trimmed(replaced(F.lower(name), V.TRASH_TIME, ""))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, "[^a-z0-9-]", "-"), "-+", "-"), r"^-|-\z", "")
    return F.concat(F.lit("trash:"), slug)


def has_vague_verb(text: Column) -> Column:
    """SCL26."""
    return matches(text, V.VAGUE_VERB)


def asks_for_meaning(text: Column) -> Column:
    """SCL27."""
    return matches(text, *V.DISAMBIGUATION)


def asks_live_or_local(second_question: Column) -> Column:
    """SCL28; null (no second question) is false."""
    return F.coalesce(matches(second_question, V.LIVE) & matches(second_question, V.LOCAL), F.lit(False))


def eligible(scheduled: Column, user_type: Column) -> Column:
    """FLT1: no scheduled run, and an outside user or none named. Empty strings are missing values."""
    return _missing(scheduled) & (_missing(user_type) | (user_type == "external"))


def cost_usd(fresh: Column, cached: Column, out: Column) -> Column:
    """PRJ4: fresh, cached and generated tokens are priced apart."""
    zero, p = F.lit(0), V.PRICE_PER_MILLION
    return sum((F.coalesce(n, zero) / 1_000_000 * p[k] for n, k in ((cached, "cached"), (out, "out"))), F.coalesce(fresh, zero) / 1_000_000 * p["fresh"])
