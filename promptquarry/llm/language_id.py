"""Language identification by Bayesian evidence fusion.

The posterior of a language is proportional to its prior at the document's host times the likelihoods of the text,
of the declared markup language and of the address suffix. The text model is naive Bayes over hashed byte trigrams,
fitted on a bounded sample of rows with a declared language (sample_per_language rows of each, chosen by hash; the
fit is a bounded table, everything else sees all rows). Naive Bayes over overlapping trigrams is overconfident,
so its log-likelihood is tempered. Host priors are shrunk hierarchically: a host's counts towards those of its
suffix, these towards the corpus's; the reliabilities of declarations and suffixes are smoothed counts too. All of
these come from grouped aggregations of the text model's votes over all documents.

A document is rejected ("und") where its text has no letters or where no language reaches min_posterior.

Defined cases: null and empty texts are rejected; a null declaration, suffix or host is no evidence; an unknown
declaration has the smoothed likelihood, which is near to none; without labelled rows every document is rejected;
texts of any length are scored whole; repeated rows count as often as they occur; an empty table gives an empty result.
Working columns start with two underscores; all other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, lean_memory, stored, text_batches

BUCKETS = 1 << 16
SAMPLE_PER_LANGUAGE = 400
#: Trigrams count as independent evidence only once in so many.
TEMPER = 3.0
HOST_STRENGTH = 20.0
SUFFIX_STRENGTH = 200.0
SMOOTHING = 1.0
MIN_POSTERIOR = 0.5
#: One row per host is broadcast up to so many hosts, counted first; beyond, the join is an ordinary one.
BROADCAST_HOSTS = 20_000
#: The same for labels.
BROADCAST_LABELS = 20_000


def trigrams(text: str) -> np.ndarray:
    """Hash buckets of the lower-cased text's byte trigrams; digits and ASCII punctuation count as blanks."""
    raw = np.frombuffer(text.encode("utf-8", "replace").translate(_FOLD), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


_FOLD = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in LOWER_AZ)


def hash_unit(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def sampled(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Rows (t, l) chosen by hash, about per_language of every label, with the label's share."""
    share = stored(labelled.groupBy("l").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("share")), "lang-labels")
    right = F.broadcast(share) if share.count() <= BROADCAST_LABELS else share
    return labelled.join(right, "l").filter(hash_unit("t") < F.col("share"))


def fit_text_model(docs: DataFrame, text: str, label: str, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order and log P(bucket | language), from about per_language labelled rows of each language."""
    labelled = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("string").alias("l"))
    chosen = sampled(labelled, per_language)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_memory()
        held: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, texts in frame.groupby("l")["t"]:
                own = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(np.concatenate([trigrams(t) for t in texts]), minlength=BUCKETS)
        if held:  # a partition may be empty, and a frame without rows has no column of strings
            yield pd.DataFrame({"l": list(held), "counts": [c.tobytes() for c in held.values()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in frame["counts"])
        return pd.DataFrame({"l": [frame["l"].iloc[0]], "counts": [total.tobytes()]})

    rows = chosen.select("l", "t").mapInPandas(count, "l string, counts binary").groupBy("l").applyInPandas(add, "l string, counts binary").collect()
    rows = sorted(rows, key=lambda r: r["l"])
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in rows], float).reshape(len(rows), BUCKETS)
    model = np.log((counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * BUCKETS))
    return [r["l"] for r in rows], model.T.astype(np.float32).copy()


def text_likelihoods(model: np.ndarray):
    """pandas UDF: tempered log-likelihoods relative to the best one; null without letters."""

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        lean_memory()
        out = []
        for text in texts:
            codes = trigrams(text) if isinstance(text, str) and any(c.isalpha() for c in text) else ()
            if not len(codes) or not model.shape[1]:
                out.append(None)
                continue
            own = model[codes].sum(axis=0, dtype=np.float64) / TEMPER
            out.append(np.round(own - own.max(), 6))
        return pd.Series(out, dtype=object)

    return score


def evidence(docs: DataFrame, text: Column, declared: Column, suffix: Column, host: Column) -> DataFrame:
    """The input with the columns that the operator reads."""
    return docs.withColumns({"__text": text, "__declared": declared, "__suffix": suffix, "__host": host})


def identify(docs: DataFrame, min_posterior: float = MIN_POSTERIOR, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """docs as evidence() gives it, with __language ("und" where rejected) and __posterior instead of those columns."""
    text_batches(docs.sparkSession)
    languages, model = fit_text_model(docs, "__text", "__declared", per_language)
    names = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    k = len(languages)
    scored = docs.withColumn("__ll", text_likelihoods(model)(F.col("__text")))
    if not k:
        return _done(docs.withColumns({"__language": F.lit("und"), "__posterior": F.lit(0.0)}))

    # votes of the text model, one light row per group of equal evidence
    vote = F.element_at(names, F.array_position("__ll", F.lit(0.0)).cast("int"))
    votes = stored(
        scored.filter("__ll IS NOT NULL").groupBy("__host", "__suffix", "__declared", vote.alias("__vote")).agg(F.count("*").alias("n")), "lang-votes"
    )
    whole = {r["__vote"]: r["n"] for r in votes.groupBy("__vote").agg(F.sum("n").alias("n")).collect()}
    total = sum(whole.values())
    top = [(whole.get(x, 0) + SMOOTHING) / (total + SMOOTHING * k) for x in languages]
    per_vote = lambda c: F.array(*[F.sum(F.when(F.col("__vote") == x, F.col("n")).otherwise(0)).cast("double") for x in languages]).alias(c)

    # P(value | language) of declarations and suffixes
    tables = {}
    for name in ("__declared", "__suffix"):
        own = votes.filter(F.col(name).isNotNull())
        sums = own.agg(per_vote("all")).first()["all"] or [0.0] * k
        distinct = own.select(name).distinct().count() + 1
        like = [F.log((F.col("own")[i] + SMOOTHING) / F.lit((sums[i] or 0.0) + SMOOTHING * distinct)) for i in range(k)]
        tables[name] = (own.groupBy(name).agg(per_vote("own")).select(F.col(name).alias(name + "_key"), F.array(*like).alias(name + "_ll")), distinct)

    # priors: host shrunk towards its suffix, the suffix towards the corpus
    suffix = votes.groupBy("__suffix").agg(per_vote("c"), F.sum("n").cast("double").alias("m")).select(
        F.col("__suffix").alias("s"), F.array(*[(F.col("c")[i] + SUFFIX_STRENGTH * top[i]) / (F.col("m") + SUFFIX_STRENGTH) for i in range(k)]).alias("sp")
    )
    host = votes.filter("__host IS NOT NULL").groupBy("__host", "__suffix").agg(per_vote("c"), F.sum("n").cast("double").alias("m"))
    host = host.join(suffix, F.col("__suffix").eqNullSafe(F.col("s"))).select(
        F.col("__host").alias("__host_key"),
        F.col("__suffix").alias("__host_suffix"),
        F.array(*[F.log((F.col("c")[i] + HOST_STRENGTH * F.col("sp")[i]) / (F.col("m") + HOST_STRENGTH)) for i in range(k)]).alias("__prior"),
    )
    parts = scored
    host = stored(host, "lang-hosts")
    right = F.broadcast(host) if host.count() <= BROADCAST_HOSTS else host
    parts = parts.join(right, (F.col("__host") == F.col("__host_key")) & F.col("__suffix").eqNullSafe(F.col("__host_suffix")), "left").drop("__host_key", "__host_suffix")
    for name, (rows, distinct) in tables.items():
        rows = F.broadcast(rows) if distinct <= BROADCAST_HOSTS else rows
        parts = parts.join(rows, F.col(name) == F.col(name + "_key"), "left").drop(name + "_key")
    flat = F.array(*[F.lit(0.0)] * k)
    top_log = F.array(*[F.lit(float(np.log(x))) for x in top])
    logs = [F.col("__ll"), F.coalesce("__prior", top_log), F.coalesce("__declared_ll", flat), F.coalesce("__suffix_ll", flat)]
    total_log = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: sum((x[i] for x in logs[1:]), logs[0][i]))
    parts = parts.withColumn("__sum", total_log).withColumn("__best", F.array_max("__sum"))
    posterior = 1.0 / F.aggregate("__sum", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__best")))
    parts = parts.withColumn("__posterior", F.coalesce(posterior, F.lit(0.0)))
    best = F.element_at(names, F.array_position("__sum", F.col("__best")).cast("int"))
    language = F.when(F.col("__ll").isNull() | (F.col("__posterior") < min_posterior), "und").otherwise(best)
    parts = parts.withColumn("__language", language)
    return _done(parts.drop("__ll", "__prior", "__declared_ll", "__suffix_ll", "__sum", "__best"))


def _done(docs: DataFrame) -> DataFrame:
    return docs.drop("__text", "__declared", "__suffix", "__host")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents: the lang column is the declaration, the source the host; there is no address."""
    text = lambda c: F.col(c).cast("string")
    return evidence(docs, text("text"), text("lang"), F.lit(None).cast("string"), text("source"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Web pages: visible text, the html element's lang, the host and its last label."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)
    some = lambda c: F.when(c != "", c)
    return evidence(pages, visible, some(declared), some(suffix), some(host))


def keep_identified(docs: DataFrame, **how) -> DataFrame:
    """The pipeline's stage: documents that have a language."""
    return identify(document_evidence(docs), **how).filter("__language <> 'und'").select(*[F.col(f"`{c}`") for c in docs.columns])
