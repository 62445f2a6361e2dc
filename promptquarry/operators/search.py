"""BM25 retrieval: postings and statistics as tables, scope with fallback as relational steps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.porter import stem_udf
from ..sources.store import kept
from . import cells
from .labels import OWN_TOOL, foreign_project

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
OVER = 4


def _folded(text):
    """Terms of the index: lower case without accents, split at everything else."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stemmed(terms: DataFrame, column: str = "term") -> DataFrame:
    """Terms replaced by their stems; the stemmer runs once per distinct term."""
    stems = terms.select(column).distinct().withColumn("__stem", stem_udf(F.col(column)))
    return terms.join(stems, column).drop(column).withColumnRenamed("__stem", column)


def _counted(own: DataFrame) -> DataFrame:
    """A row for each distinct one of a row's words: term, tf, counted as runs of the sorted words, so that no shuffle meets them."""
    none, keys = F.array(F.lit(None).cast("string")), [c for c in own.columns if c != "words"]
    rows = own.withColumn("words", F.array_sort("words")).select(*keys, F.concat(none, "words").alias("before"), F.concat("words", none).alias("term"))
    rows = rows.withColumn("run", F.transform(F.arrays_zip("before", "term"), lambda x, i: F.struct(x["before"].alias("before"), x["term"].alias("term"), i.alias("at"))))
    rows = rows.select(*keys, F.filter("run", lambda x: ~x["before"].eqNullSafe(x["term"])).alias("run"))
    rows = rows.withColumn("next", F.slice("run", F.lit(2), F.size("run"))).select(*keys, F.explode(F.arrays_zip("run", "next")).alias("x"))
    return rows.filter("x.next IS NOT NULL").select(*keys, F.col("x.run.term").alias("term"), (F.col("x.next.at") - F.col("x.run.at")).cast("long").alias("tf"))


def build_index(prompts: DataFrame, porter: bool = True) -> tuple[DataFrame, DataFrame]:
    """FTS1, SNK15, JN25: postings (term, prompt_id, project_id, tf, length) over eligible user prompts, and one row of
    statistics (n_docs, avg_length). prompts with normalized_content. Words are counted prompt by prompt; only stems and the
    rows of an id that occurs more than once are counted together."""
    own = prompts.filter((F.col("role") == "user") & F.col("eligible")).select("prompt_id", "project_id", _folded(F.col("normalized_content")).alias("words"))
    own = own.withColumn("length", F.size("words").cast("long"))
    together = lambda rows: rows.groupBy("term", "prompt_id", "project_id", "length").agg(F.sum("tf").alias("tf"))
    stats = own.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
    if porter:
        return together(stemmed(_counted(own))), stats
    often = kept(own.groupBy("prompt_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("prompt_id").alias("often")), "ids-of-several")
    columns, same = ("term", "prompt_id", "project_id", "length", "tf"), F.col("prompt_id").eqNullSafe(F.col("often"))
    if often.isEmpty():
        return _counted(own).select(*columns), stats
    return _counted(own.join(often, same, "left_anti")).select(*columns).unionByName(together(_counted(own.join(often, same, "left_semi")))), stats


def query_terms(queries: DataFrame, porter: bool = True) -> DataFrame:
    """FTS2, SCL11: query_id, term from query_id, text. Two terms with one stem both count."""
    terms = queries.select("query_id", F.explode(T.search_terms(F.col("text"))).alias("term"))
    return stemmed(terms) if porter else terms


#: A term is common if more than one in so many postings has it; postings of a common term that one task pairs.
COMMON_SHARE, SLICE = 20_000, 8192


def _idf() -> Column:
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.when(idf <= 0, LEAST_IDF).otherwise(idf)


def _weight() -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))


def rank(terms: DataFrame, postings: DataFrame, stats: DataFrame) -> DataFrame:
    """FTS3: query_id, prompt_id, project_id, rank (lower is better) of all prompts with a term of the query. Document counts
    are of the whole index. The postings of common terms, of which there are fewer than COMMON_SHARE, are dealt in
    slices, so that no task pairs all of a term's."""
    wanted = postings.join(terms.select("term").distinct(), "term", "left_semi")
    counts = wanted.groupBy("term").agg(F.count("*").alias("df"))
    total = counts.agg(F.sum("df")).first()[0] or 0
    common = F.broadcast(counts.filter(F.col("df") > max(SLICE, -(-total // COMMON_SHARE))).select("term", F.ceil(F.col("df") / SLICE).cast("int").alias("slices")))
    one = F.coalesce("slices", F.lit(1))
    dealt = wanted.join(common, "term", "left").withColumn("slice", F.pmod(F.xxhash64("prompt_id"), one).cast("int")).drop("slices")
    asked = terms.join(counts, "term").join(common, "term", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), one - 1))).drop("slices")
    rows = asked.join(dealt, ["term", "slice"]).crossJoin(F.broadcast(stats))
    return rows.groupBy("query_id", "prompt_id", "project_id").agg((-F.sum(_idf() * _weight())).alias("rank"))


#: Steps of impact, from a term's greatest to its least, that its postings lie in.
STEPS = 16
#: Room for rounding in bounds, which are compared to nine digits.
ROOM = 1e-7
BLOCK = ["term", "project_id", "step", "part"]


@dataclass(frozen=True)
class Blocks:
    """Scored postings of the asked terms (term, project_id, prompt_id, impact, step); on first use, those dealt to blocks (BLOCK,
    prompt_id, impact) and the blocks (BLOCK, greatest impact, n)."""

    scored: DataFrame

    @cached_property
    def postings(self) -> DataFrame:
        sizes = self.scored.groupBy("term", "project_id", "step").agg(F.count("*").alias("n"))
        total = sizes.agg(F.sum("n")).first()[0] or 0
        large = F.broadcast(sizes.filter(F.col("n") > max(SLICE, -(-total // COMMON_SHARE))).select("term", "project_id", "step", F.ceil(F.col("n") / SLICE).cast("int").alias("parts")))
        parts = F.pmod(F.xxhash64("prompt_id"), F.coalesce("parts", F.lit(1))).cast("int")
        return self.scored.join(large, ["term", "project_id", "step"], "left").withColumn("part", parts).drop("parts")

    @cached_property
    def blocks(self) -> DataFrame:
        return self.postings.groupBy(*BLOCK).agg(F.max("impact").alias("greatest"), F.count("*").alias("n"))


def impact_blocks(terms: DataFrame, postings: DataFrame, stats: DataFrame, projects: DataFrame) -> Blocks:
    """FTS3: a posting's impact is what its term adds to its prompt's score. Postings of the given projects (project_id) in
    blocks by term, project and step of impact; a step with more than SLICE postings is several blocks."""
    wanted = postings.join(terms.select("term").distinct(), "term", "left_semi")
    return Blocks(_scored(wanted, stats, projects))


def _scored(wanted: DataFrame, stats: DataFrame, projects: DataFrame) -> DataFrame:
    # as an aggregate, the size of the counts would be known only after the postings are shuffled
    counts = cells.sent(kept(wanted.groupBy("term").agg(F.count("*").alias("df")), "term-counts"))
    rows = wanted.join(counts, "term").crossJoin(F.broadcast(stats)).select("term", "prompt_id", "project_id", (_idf() * _weight()).alias("impact"), (_idf() * (K1 + 1)).alias("most"))
    step = F.least(F.floor((1 - F.col("impact") / F.col("most")) * STEPS), F.lit(STEPS - 1)).cast("int")
    return kept(rows.join(projects, "project_id", "left_semi").select("term", "project_id", "prompt_id", "impact", step.alias("step")), "impacts")


def scored_blocks(asked: DataFrame, index: Blocks) -> tuple[DataFrame, DataFrame]:
    """Which blocks are read for each query: (query_id, BLOCK, times) of those that can hold a prompt of the first k, and per
    query (query_id, bound, unread): the k-th best score of a first few blocks, and the most that blocks that aren't read
    can add to a prompt. asked: query_id, term, scope (a project, or null for all), k; a term may be asked twice.

    The blocks of greatest impact are scored first, until about k postings are; the k-th best of these partial scores
    is a bound for what the first k reach. Terms are then taken by their greatest impacts: as long as these add up to
    less than the bound, prompts with no other terms can't reach it. Of the other terms a block is read only if its
    greatest impact and those of all other terms reach the bound."""
    asked = asked.groupBy("query_id", "term", "scope", "k").agg(F.count("*").alias("times"))
    own = asked.filter("scope IS NOT NULL").withColumnRenamed("scope", "project_id").join(index.blocks, ["term", "project_id"])
    every = asked.filter("scope IS NULL").drop("scope").join(index.blocks, "term")
    blocks = own.unionByName(every).withColumn("greatest", F.col("greatest") * F.col("times"))
    by_term = Window.partitionBy("query_id", "term")
    by_impact = Window.partitionBy("query_id").orderBy(F.desc("greatest"), *BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = kept(blocks.withColumns({"before": F.coalesce(F.sum("n").over(by_impact), F.lit(0)), "of_term": F.max("greatest").over(by_term)}), "asked-blocks")
    first = blocks.filter(F.col("before") < F.col("k")).select("query_id", "k", "times", *BLOCK).join(index.postings, BLOCK)
    first = first.groupBy("query_id", "k", "prompt_id").agg(F.sum(F.col("impact") * F.col("times")).alias("score"))
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"))
    bound = first.withColumn("rn", F.row_number().over(nth)).filter(F.col("rn") == F.col("k")).select("query_id", (F.col("score") * (1 - ROOM)).alias("bound"))
    terms = blocks.select("query_id", "term", "of_term").distinct()
    upwards = Window.partitionBy("query_id").orderBy("of_term", "term")
    terms = terms.join(bound, "query_id", "left").withColumns({"bound": F.coalesce("bound", F.lit(0.0)), "sum": F.sum("of_term").over(upwards.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("of_term").over(Window.partitionBy("query_id"))})
    reaches = (F.col("sum") >= F.col("bound")) & (F.col("greatest") + F.col("all") - F.col("of_term") >= F.col("bound"))
    blocks = kept(blocks.drop("of_term").join(terms, ["query_id", "term"]).withColumn("read", reaches), "bounded-blocks")
    unread = blocks.filter("NOT read").groupBy("query_id", "term").agg(F.max("greatest").alias("u")).groupBy("query_id").agg(F.sum("u").alias("unread"))
    per_query = blocks.select("query_id", "bound").distinct().join(unread, "query_id", "left").select("query_id", "bound", F.coalesce("unread", F.lit(0.0)).alias("unread"))
    return blocks.filter("read").select("query_id", *BLOCK, "times"), per_query


def best_ranked(asked: DataFrame, index: Blocks) -> DataFrame:
    """FTS3, FTS5: query_id, prompt_id, project_id, rank as rank() gives them, of prompts among which the first k of every
    query are. Queries meet the postings of their projects in cells of bounded size that let only first ones out; joined as
    rows, each query would shuffle its postings. asked as for scored_blocks."""
    asked = asked.groupBy("query_id", "term", "scope", "k").agg(F.count("*").cast("double").alias("times")).withColumns({"m": F.lit(1.0), "bound": F.lit(0.0)})
    postings = index.scored.select("project_id", "term", F.col("prompt_id").alias("doc_id"), "impact", F.lit(0.0).alias("base"))
    rank = (-F.col("total")).alias("rank")
    own = cells.best(asked.filter("scope IS NOT NULL").withColumnRenamed("scope", "group"), postings.withColumnRenamed("project_id", "group"))
    every = cells.best(asked.filter("scope IS NULL").drop("scope").withColumn("group", F.lit(0)), postings.drop("project_id").withColumn("group", F.lit(0)))
    places = index.scored.select("prompt_id", "project_id").distinct()
    every = every.select("query_id", F.col("doc_id").alias("prompt_id"), rank).join(places, "prompt_id")
    return own.select("query_id", F.col("doc_id").alias("prompt_id"), F.col("group").alias("project_id"), rank).unionByName(every)


def top(ranked: DataFrame, prompts: DataFrame, projects: DataFrame, limit: int, own: str = OWN_TOOL) -> DataFrame:
    """FTS5, SRT1: of each query the best OVER * limit rows of foreign projects, without synthetic ones, cut at limit.
    The wider cut comes before the filter, so it decides too. query_id, prompt_id, project_id, rank, pos."""
    ok = projects.filter(foreign_project(F.col("name"), F.col("cwd"), own)).select("project_id")
    order = Window.partitionBy("query_id").orderBy(F.round("rank", 9), "prompt_id")
    near = ranked.join(ok, "project_id", "left_semi").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= OVER * limit)
    near = near.join(prompts.select("prompt_id", "content"), "prompt_id").filter(~T.synthetic_for_search(F.col("content")))
    return near.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit).select("query_id", "prompt_id", "project_id", "rank", "pos")


def retrieve(queries: DataFrame, prompts: DataFrame, projects: DataFrame, limit: int = 12, fallback: bool = True, porter: bool = True, own: str = OWN_TOOL) -> DataFrame:
    """FTS4, SET3, JN21: queries (query_id, text, project_id or null). Rows of the query's project; if they are fewer
    than half the limit, rows of all projects follow, without those seen."""
    postings, stats = build_index(prompts, porter)
    terms = kept(query_terms(queries, porter), "query-terms")
    wanted = cells.sent(kept(terms.select("term").distinct(), "wanted-terms"))
    postings = kept(postings.join(wanted, "term", "left_semi"), "postings")
    scope = kept(queries.select("query_id", F.col("project_id").alias("scope")), "query-scopes")
    ok = projects.filter(foreign_project(F.col("name"), F.col("cwd"), own)).select("project_id")
    index = Blocks(_scored(postings, stats, kept(ok.distinct(), "foreign-projects")))
    asked = terms.join(scope, "query_id")
    inside = kept(top(best_ranked(asked.filter("scope IS NOT NULL").withColumn("k", F.lit(OVER * limit)), index), prompts, projects, limit, own), "inside")
    counts = inside.groupBy("query_id").agg(F.count("*").alias("have"))
    need = scope.join(counts, "query_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    half = -(-limit // 2)
    need = need.filter(F.col("scope").isNull() | (F.lit(fallback) & (F.col("have") < half))).select("query_id", "scope", (F.lit(limit) - F.col("have")).alias("missing"))
    # of each query three times what is missing (all of it without a scope), each over-retrieved before the filter
    order = Window.partitionBy("query_id").orderBy(F.round("rank", 9), "prompt_id")
    need = kept(need.withColumn("most", F.when(F.col("scope").isNull(), F.lit(limit)).otherwise(F.col("missing") * 3)), "needed")
    asked = terms.join(need.select("query_id", (OVER * F.col("most")).alias("k")), "query_id").withColumn("scope", F.lit(None).cast(dict(scope.dtypes)["scope"]))
    wide = best_ranked(asked, index).join(need, "query_id").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= OVER * F.col("most"))
    wide = wide.join(prompts.select("prompt_id", "content"), "prompt_id").filter(~T.synthetic_for_search(F.col("content")))
    wide = wide.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= F.col("most"))
    wide = wide.join(inside.select("query_id", "prompt_id"), ["query_id", "prompt_id"], "left_anti")
    wide = wide.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= F.col("missing"))
    rest = wide.join(counts, "query_id", "left").select("query_id", "prompt_id", "project_id", "rank", (F.col("rn") + F.coalesce("have", F.lit(0))).cast("int").alias("pos"))
    return inside.unionByName(rest)


def with_clarification_flag(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """JN14, PRJ1: whether a found prompt has a manual pair."""
    manual = pairs.filter("extraction_method = 'manual'").select(F.col("originating_prompt_id").alias("prompt_id"), F.lit(True).alias("__has")).distinct()
    return found.join(manual, "prompt_id", "left").withColumn("has_clarification", F.coalesce("__has", F.lit(False))).drop("__has")


def gold_examples(found: DataFrame, pairs: DataFrame, limit: int = 6) -> DataFrame:
    """FLT15, SRT5: manual pairs with a kind on found prompts; per query the first by pair_id."""
    manual = pairs.filter("extraction_method = 'manual' AND clarification_kind IS NOT NULL").select("pair_id", F.col("originating_prompt_id").alias("prompt_id"), "clarification_kind", "clarification_text")
    order = Window.partitionBy("query_id").orderBy("pair_id")
    return found.select("query_id", "prompt_id").join(manual, "prompt_id").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit).drop("rn")


def project_lookup(projects: DataFrame, names: DataFrame) -> DataFrame:
    """SRT4: name, project_id of the project that has the name or whose folder ends in it: explicit ones first, then those
    seen last. Letters of folders count alike in either case."""
    folder = F.lower(F.regexp_extract("cwd", "/([^/]*)$", 1))
    keys = F.array_distinct(F.array(F.concat(F.lit("n:"), F.col("name")), F.when(F.instr("cwd", "/") > 0, F.concat(F.lit("f:"), folder))))
    own = projects.select("project_id", "explicit", "last_seen_at", F.explode(keys).alias("key")).filter("key IS NOT NULL")
    wanted = names.select("name").distinct().select("name", F.explode(F.array(F.concat(F.lit("n:"), "name"), F.concat(F.lit("f:"), F.lower("name")))).alias("key"))
    order = Window.partitionBy("name").orderBy(F.desc("explicit"), F.desc("last_seen_at"), "project_id")
    return wanted.join(own, "key").withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("name", "project_id")
