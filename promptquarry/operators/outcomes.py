"""Session outcomes from snapshots: overlap with trashed work, succession within a project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..sources.store import kept

#: A content hash is common if more than one in so many rows of files has it.
COMMON_SHARE = 2_000
#: Snapshots on one side of a common hash that one task pairs.
SLICE = 4096
#: Hashes that as many snapshots have are ordered by so many groups.
TIES = 16
ROUNDING = 1e-9


@dataclass(frozen=True)
class Overlaps:
    """Snapshots with equal files are one class, named by its least snapshot. members: snapshot_id, class_id; pairs: left_class,
    right_class, jaccard of those that overlap enough; candidates: left_class, right_class before they were verified."""

    members: DataFrame
    pairs: DataFrame
    candidates: DataFrame


def _classes(own: DataFrame) -> DataFrame:
    """snapshot_id, class_id, n. Equal sets have equal sums of two hashes of their members; sets aren't gathered."""
    prints = own.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("content_hash").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("content_hash", F.lit("x"))).alias("b"))
    prints = kept(prints, "prints")
    return prints.join(kept(prints.groupBy("n", "a", "b").agg(F.min("snapshot_id").alias("class_id")), "classes"), ["n", "a", "b"]).select("snapshot_id", "class_id", "n")


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """sets (class_id, n, is_left, is_right, content_hash) cut down to the hashes that the other side has too, the rarest
    first: place bounds a hash's place from below. A class that lacks too many hashes is dropped; is_prefix marks the
    first n - ceil(least * n) + 1 places, one of which two sets with this similarity have in common."""
    counts = kept(sets.groupBy("content_hash").agg(F.sum(F.col("is_left").cast("long")).alias("l"), F.sum(F.col("is_right").cast("long")).alias("r")), "hash-counts")
    order = F.struct((F.col("l") + F.col("r")).alias("k"), F.pmod(F.xxhash64("content_hash"), F.lit(TIES)).alias("tie"))
    met = (F.col("is_left") & (F.col("r") > 0)) | (F.col("is_right") & (F.col("l") > 0))
    rows = kept(sets.join(counts, "content_hash").filter(met).withColumn("order", order).drop("l", "r"), "shared-hashes")
    groups = rows.groupBy("class_id", "n", "order").agg(F.count("*").alias("m"))
    before = Window.partitionBy("class_id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("class_id")
    groups = groups.withColumn("shared", F.sum("m").over(every)).filter(F.col("shared") >= least * F.col("n") - ROUNDING)
    place = F.col("n") - F.col("shared") + F.coalesce(F.sum("m").over(before), F.lit(0))  # hashes of one side only come first
    groups = groups.withColumn("place", place).select("class_id", "order", "place")
    return rows.join(kept(groups, "hash-places"), ["class_id", "order"]).drop("order").withColumn("is_prefix", F.col("place") < F.col("n") - F.ceil(least * F.col("n") - ROUNDING) + 1)


def similar_snapshots(files: DataFrame, left: DataFrame, right: DataFrame, least: float = V.TRASH_OVERLAP) -> Overlaps:
    """JN19: a similarity join of left and right snapshots (snapshot_id) by the Jaccard similarity of their files
    (snapshot_id, content_hash): prefix filter with the rarest hashes first, filters of lengths and places, verification.

    A hash that very many snapshots have reaches the join only from snapshots that have little else; its rows are then
    paired in slices of the left side, so that no task has them all."""
    own = kept(files.select("snapshot_id", "content_hash").distinct(), "snapshot-hashes")
    members = kept(_classes(own), "members")
    side = lambda ids, name: members.join(ids.select("snapshot_id"), "snapshot_id", "left_semi").select("class_id", F.lit(True).alias(name)).distinct()
    classes = members.filter("snapshot_id = class_id").join(side(left, "is_left"), "class_id", "left").join(side(right, "is_right"), "class_id", "left")
    classes = classes.select("snapshot_id", "class_id", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_left", "is_right")]).filter("is_left OR is_right")
    rows = kept(_prefixes(own.join(classes, "snapshot_id").drop("snapshot_id"), least), "prefixes")
    prefix = rows.filter("is_prefix")
    counts = prefix.groupBy("content_hash").agg(F.count("*").alias("k"))
    total = int(counts.agg(F.sum("k")).first()[0] or 0)
    hot = F.broadcast(counts.filter(F.col("k") > max(SLICE, -(-total // COMMON_SHARE))).select("content_hash", F.ceil(F.col("k") / SLICE).cast("int").alias("slices")))
    sliced = prefix.join(hot, "content_hash", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    a = sliced.filter("is_left").select(F.col("class_id").alias("left_class"), F.col("n").alias("n1"), F.col("place").alias("p1"), "content_hash", F.pmod(F.xxhash64("class_id"), F.col("slices")).cast("int").alias("slice"))
    b = sliced.filter("is_right").select(F.col("class_id").alias("right_class"), F.col("n").alias("n2"), F.col("place").alias("p2"), "content_hash", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    n1, n2 = F.col("n1"), F.col("n2")
    fits = (F.least(n1, n2) >= least * F.greatest(n1, n2) - ROUNDING) & ((1 + least) * F.least(n1 - F.col("p1"), n2 - F.col("p2")) >= least * (n1 + n2) - ROUNDING)
    candidates = kept(a.join(b, ["content_hash", "slice"]).filter(fits).select("left_class", "right_class", "n1", "n2").distinct(), "overlap-candidates")
    theirs = rows.select(F.col("class_id").alias("right_class"), "content_hash")
    common = candidates.join(rows.select(F.col("class_id").alias("left_class"), "content_hash"), "left_class").join(theirs, ["right_class", "content_hash"]).groupBy("left_class", "right_class", "n1", "n2").agg(F.count("*").alias("common"))
    jaccard = F.col("common") / (n1 + n2 - F.col("common"))
    pairs = common.select("left_class", "right_class", jaccard.alias("jaccard")).filter(F.col("jaccard") >= least)
    return Overlaps(members.select("snapshot_id", "class_id"), pairs, candidates.select("left_class", "right_class"))


def snapshot_overlap(files: DataFrame, left: DataFrame, right: DataFrame, least: float = V.TRASH_OVERLAP) -> DataFrame:
    """JN19: left_id, right_id, jaccard of every left and right snapshot that overlap enough; copies are expanded."""
    found = similar_snapshots(files, left, right, least)
    a = found.members.join(left.select("snapshot_id").distinct(), "snapshot_id").select(F.col("snapshot_id").alias("left_id"), F.col("class_id").alias("left_class"))
    b = found.members.join(right.select("snapshot_id").distinct(), "snapshot_id").select(F.col("snapshot_id").alias("right_id"), F.col("class_id").alias("right_class"))
    return found.pairs.join(a, "left_class").join(b, "right_class").select("left_id", "right_id", "jaccard")


def first_overlap(files: DataFrame, left: DataFrame, right: DataFrame, least: float = V.TRASH_OVERLAP) -> DataFrame:
    """left_id, right_id, jaccard: per left snapshot the first right one (by id) that overlaps enough. Found per class, so
    copies on either side make no pairs."""
    found = similar_snapshots(files, left, right, least)
    firsts = found.members.join(right.select("snapshot_id"), "snapshot_id", "left_semi").groupBy(F.col("class_id").alias("right_class")).agg(F.min("snapshot_id").alias("right_id"))
    best = found.pairs.join(firsts, "right_class").groupBy("left_class").agg(F.min(F.struct("right_id", "jaccard")).alias("first"))
    own = found.members.join(left.select("snapshot_id"), "snapshot_id", "left_semi").select(F.col("snapshot_id").alias("left_id"), F.col("class_id").alias("left_class"))
    return own.join(kept(best, "first-overlaps"), "left_class").select("left_id", "first.right_id", "first.jaccard")


def successors(sessions: DataFrame) -> DataFrame:
    """WIN2-3: session_id, successor_session_id, is_latest among eligible sessions of a project, by end (else start)."""
    order = Window.partitionBy("project_id").orderBy(F.coalesce("ended_at", "started_at"), "started_at", "session_id")
    nxt = F.lead("session_id").over(order)
    return sessions.filter("eligible").select("session_id", "project_id", nxt.alias("successor_session_id"), nxt.isNull().alias("is_latest"))


def session_outcomes(sessions: DataFrame, snapshots: DataFrame, files: DataFrame, prompts: DataFrame) -> DataFrame:
    """LAB1: session_id, outcome, is_in_trash, has_successor, successor_session_id, turn_count. snapshots: snapshot_id,
    session_id, snapshot_type. Of a session's snapshots the one with the largest id counts."""
    outputs = snapshots.filter("snapshot_type = 'cowork-outputs' AND session_id IS NOT NULL")
    latest = outputs.groupBy("session_id").agg(F.max("snapshot_id").alias("snapshot_id"))
    hit = first_overlap(files, latest, snapshots.filter("snapshot_type = 'trash-snapshot'")).select(F.col("left_id").alias("snapshot_id"), F.lit(True).alias("trashed"))
    turns = prompts.filter("role = 'user'").groupBy("session_id").agg(F.count("*").alias("turn_count"))
    rows = successors(sessions).join(latest, "session_id", "left").join(hit, "snapshot_id", "left").join(turns, "session_id", "left")
    has = F.col("snapshot_id").isNotNull()
    outcome = F.when(F.col("trashed"), "rejected").when(has & F.col("is_latest"), "accepted").when(has, "iterated").otherwise("unknown")
    return rows.select(
        "session_id", outcome.alias("outcome"), F.coalesce("trashed", F.lit(False)).alias("is_in_trash"), (~F.col("is_latest")).alias("has_successor"),
        "successor_session_id", F.coalesce("turn_count", F.lit(0)).cast("long").alias("turn_count"),
    )


def trash_remap(sessions: DataFrame, snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """SNK13, WIN7: trash snapshot_id and the project of the session that overlaps it most; ties: the earlier session."""
    latest = snapshots.filter("snapshot_type = 'cowork-outputs' AND session_id IS NOT NULL").groupBy("session_id").agg(F.max("snapshot_id").alias("left_id"))
    own = sessions.filter("eligible").select("session_id", "project_id", F.coalesce("ended_at", "started_at").alias("at"), "started_at").join(latest, "session_id")
    best = Window.partitionBy("right_id").orderBy(F.desc("jaccard"), "project_id", "at", "started_at", "session_id")
    hits = first_overlap(files, latest.select(F.col("left_id").alias("snapshot_id")), snapshots.filter("snapshot_type = 'trash-snapshot'"))
    return hits.join(own, "left_id").withColumn("rn", F.row_number().over(best)).filter("rn = 1").select(F.col("right_id").alias("snapshot_id"), "project_id")


def upserted_outcomes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """SNK6: outcomes by session_id; a session seen before keeps its turn_count, all else is renewed."""
    kept = existing.select("session_id", F.col("turn_count").alias("__kept"), F.lit(True).alias("__seen"))
    renewed = new.join(kept, "session_id", "left").withColumn("turn_count", F.when(F.col("__seen"), F.col("__kept")).otherwise(F.col("turn_count"))).drop("__kept", "__seen")
    return renewed.unionByName(existing.join(new.select("session_id"), "session_id", "left_anti")).select(*existing.columns)
