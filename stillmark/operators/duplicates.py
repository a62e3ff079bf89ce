"""Duplicate videos: identical files, near copies by covered sample frames, and groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from . import pivots as P
from .recall import MAX_STRUCT, recall
from .shared import saved

DEFAULT_THRESHOLD = 0.88
SAMPLES, NEAR_VIDEOS, SEARCHED_VIDEOS = 8, 8, 50
SLICE, PAIRS_A_TASK, MOST_PARTS = 2048, 4_000_000, 10_000
LINKS = "a long, b long"


def threshold_or_default(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (x > 0) & (x <= 1), x).otherwise(DEFAULT_THRESHOLD)


def identical_candidates(videos: DataFrame, tolerance: float = 0.5, keys: tuple[str, ...] = ("size",)) -> DataFrame:
    """(id_a, id_b), id_a < id_b: equal size and durations less than ``tolerance`` apart; unknown durations pair with none.

    The equality on ``keys`` and a duration cell of the tolerance's width make it an equi-join: each row looks into its own
    cell and the two next to it, so many files of one size don't all meet. Cells are counted first: a large one is joined in
    slices of about ``SLICE`` files, and there are as many tasks as the pairs that meet ask for, so the longest task doesn't
    grow with their number. The pairs themselves grow with the square of the files of a cell.
    """
    v = videos.select("id", *keys, "duration").where(" and ".join(f"{c} is not null" for c in ("duration", *keys))).withColumn("cell", F.floor(F.col("duration") / tolerance))
    cells = v.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    met = cells.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    parts = max(int(videos.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, int(3 * met / PAIRS_A_TASK)))
    around = F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")
    a = v.select(F.col("id").alias("id_a"), *keys, F.col("duration").alias("duration_a"), around)
    b = v.select(F.col("id").alias("id_b"), *keys, F.col("duration").alias("duration_b"), "cell")
    large = cells.where(F.col("n") > SLICE).select(*keys, "cell", F.ceil(F.col("n") / SLICE).alias("slices"))
    slices = F.coalesce("slices", F.lit(1))
    a = a.join(large, [*keys, "cell"], "left").select("id_a", *keys, "duration_a", "cell", F.explode(F.sequence(F.lit(0), slices.cast("int") - 1)).alias("slice"))
    b = b.join(large, [*keys, "cell"], "left").select("id_b", *keys, "duration_b", "cell", F.pmod(F.xxhash64("id_b"), slices).cast("int").alias("slice"))
    near = (F.col("id_a") < F.col("id_b")) & (F.abs(F.col("duration_a") - F.col("duration_b")) < tolerance)
    by = [*keys, "cell", "slice"]
    return a.repartition(parts, *by).join(b.repartition(parts, *by), by).where(near).select("id_a", "id_b")


def with_twins(videos: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """id of every video that some other one equals in size and, to less than ``tolerance``, in duration.

    Rows of a (size, duration cell) are first summed up to one, so neither copies nor a common size make a hot key; the
    sums look at themselves and at the cells next to them. In one cell all are near enough.
    """
    v = videos.select("id", "size", "duration").where("duration is not null and size is not null").withColumn("cell", F.floor(F.col("duration") / tolerance))
    cells = v.groupBy("size", "cell").agg(F.count("*").alias("n"), F.min("duration").alias("low"), F.max("duration").alias("high"))
    around = cells.select("size", F.explode(F.array(F.col("cell") - 1, F.col("cell") + 1)).alias("cell"), F.col("low").alias("near_low"), F.col("high").alias("near_high"))
    near = around.groupBy("size", "cell").agg(F.max(F.struct("near_high", "near_low")).alias("above"), F.min(F.struct("near_low", "near_high")).alias("under"))
    seen = cells.join(near, ["size", "cell"], "left").select("size", "cell", "n", "above", "under")
    joined = v.join(seen, ["size", "cell"])
    by_next = (F.col("above.near_low") - F.col("duration") < tolerance) & (F.col("above.near_low") > F.col("duration"))
    by_last = (F.col("duration") - F.col("under.near_high") < tolerance) & (F.col("under.near_high") < F.col("duration"))
    return joined.where((F.col("n") > 1) | F.coalesce(by_next, F.lit(False)) | F.coalesce(by_last, F.lit(False))).select("id")


def identical_classes(videos: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """class_id (smallest id), id of every file that has an identical one: a row for each file and not for each pair.

    Identical are files of equal size and digest whose durations go on in steps of less than ``tolerance``: what
    ``identical_pairs`` links. Cells of equal files are summed up before they are put in order, so a task sees a row for each
    cell of a digest; the files themselves only meet one row of their cell.
    """
    keys = ["size", "file_hash"]
    v = videos.select("id", *keys, "duration").where("duration is not null and size is not null and file_hash is not null").withColumn("cell", F.floor(F.col("duration") / tolerance))
    cells = v.groupBy(*keys, "cell").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("duration").alias("low"), F.max("duration").alias("high"))
    order = Window.partitionBy(*keys).orderBy("cell")
    begins = F.coalesce(F.col("low") - F.lag("high").over(order) >= tolerance, F.lit(True)).cast("int")
    chains = cells.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "chain")
    classes = chains.select(*keys, "cell", F.min("first").over(whole).alias("class_id"), F.sum("n").over(whole).alias("members")).where("members > 1")
    return v.join(classes, [*keys, "cell"]).select("class_id", "id")


def identical_links(classes: DataFrame) -> DataFrame:
    """Classes as exact pairs of the representative and each other member: enough for groups, one fewer than the files."""
    pairs = classes.where("id <> class_id").select(F.col("class_id").alias("id_a"), F.col("id").alias("id_b"))
    return pairs.select("id_a", "id_b", *[F.lit(1.0).alias(c) for c in ("score", "hash_score", "color_score")], F.lit(0.0).alias("time_seconds"), F.lit(True).alias("identical_file"))


def with_hash(videos: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """file_hash kept where known, else the digest of the content, computed only for the candidates in ``ids``."""
    wanted = videos.join(ids, "id", "left_semi")
    content = files.select(F.col("path").alias("file_path"), "content")
    known, missing = wanted.where("file_hash is not null"), wanted.where("file_hash is null")
    hashed = missing.join(content, F.col("path") == F.col("file_path")).withColumn("file_hash", F.sha2("content", 256)).select(*videos.columns)
    return known.unionByName(hashed)


def identical_pairs(videos: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with equal digests: exact pairs of score 1."""
    h = videos.select("id", "file_hash").where("file_hash is not null")
    a, b = h.toDF("id_a", "hash_a"), h.toDF("id_b", "hash_b")
    same = candidates.join(a, "id_a").join(b, "id_b").where("hash_a = hash_b")
    return same.select("id_a", "id_b", *[F.lit(1.0).alias(c) for c in ("score", "hash_score", "color_score")], F.lit(0.0).alias("time_seconds"), F.lit(True).alias("identical_file"))


def identical_pairs_of(videos: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """What ``identical_pairs`` finds among all candidates; the digest is a key of the join, so that different files of one size don't meet."""
    same = identical_candidates(videos, tolerance, ("size", "file_hash"))
    return same.select("id_a", "id_b", *[F.lit(1.0).alias(c) for c in ("score", "hash_score", "color_score")], F.lit(0.0).alias("time_seconds"), F.lit(True).alias("identical_file"))


def representatives(frames: DataFrame, most: int) -> DataFrame:
    """Evenly spread frames of each video: the middle one for ``most`` = 1, else first and last and what lies between."""
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_index")) - 1
    sizes = frames.groupBy(F.col("video_id").alias("size_id")).agg(F.count("*").alias("n"))
    placed = frames.withColumn("place", place).join(sizes, F.col("video_id") == F.col("size_id"))
    if most < 1:
        return placed.where(F.lit(False)).drop("place", "n", "size_id")
    if most == 1:
        chosen = F.array(F.floor(F.col("n") / 2))
    else:
        n = F.least(F.lit(most), F.col("n"))
        spread = lambda k: F.floor(k * (F.col("n") - 1) / (n - 1) + 0.5)
        chosen = F.when(n == 1, F.array(F.floor(F.col("n") / 2))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), spread))
    return placed.where(F.array_contains(chosen, F.col("place").cast("long"))).drop("place", "n", "size_id")


def coverage_pairs(frames: DataFrame, struct: list[str], threshold: float = DEFAULT_THRESHOLD, most_met: float = 0.5, **limits) -> DataFrame:
    """Pairs of videos whose sample frames find each other: score = average * (0.5 + 0.5 * coverage), if it reaches the threshold.

    Each video's middle frame finds its nearest other video among the first 8; then the video's samples (at most 8) are
    looked up in all frames, and the share that finds the partner within the first 50 is the coverage. Sample frames are
    the stated query set. The threshold bounds the structure distance, so samples and frames meet in cells around pivots;
    where by a bounded sample more than ``most_met`` of all pairs would meet there, the samples go out in blocks against
    all frames instead. Either way gives the same pairs.
    """
    frames = saved(frames, "fingerprints")
    bits = limits.get("bits") or 64 * len(struct)
    radius = P.radius_of(threshold, limits.get("max_struct", MAX_STRUCT), bits)
    if 4 * radius < bits:  # from a quarter of the bits on it reaches across nearly all cells
        chosen = P.choose(frames, struct, radius)
        if chosen.share <= most_met:
            limits = {**limits, "pivots": chosen}
    middle = representatives(frames, 1).withColumn("query_id", F.col("video_id"))
    first = recall(frames, middle, struct, k=NEAR_VIDEOS, min_score=threshold, **limits).where("video_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    partner = first.withColumn("n", F.row_number().over(order)).where("n = 1")
    partner = partner.select(F.col("query_id").alias("id_a"), F.col("video_id").alias("id_b"), "hash_score", "color_score", (F.col("time_ms") / 1000).alias("time_seconds"))
    samples = representatives(frames, SAMPLES).join(partner.select(F.col("id_a").alias("video_id")).distinct(), "video_id", "left_semi")
    asked = samples.withColumn("query_id", F.struct(F.col("video_id").alias("of"), F.col("frame_index").alias("at")))
    found = recall(frames, asked, struct, k=SEARCHED_VIDEOS, min_score=threshold, **limits)
    found = found.select(F.col("query_id.of").alias("id_a"), F.col("video_id").alias("id_b"), F.col("score").alias("sample_score"))
    sampled = samples.groupBy(F.col("video_id").alias("id_a")).agg(F.count("*").alias("n_samples"))
    judged = found.join(partner, ["id_a", "id_b"]).groupBy("id_a", "id_b", "hash_score", "color_score", "time_seconds").agg(F.count("*").alias("matched"), F.avg("sample_score").alias("average")).join(sampled, "id_a")
    score = F.col("average") * (0.5 + 0.5 * F.col("matched") / F.col("n_samples"))
    kept = judged.withColumn("score", score).where(F.col("score") >= threshold)
    low, high = S.pair_key(F.col("id_a"), F.col("id_b"))
    one = Window.partitionBy("low", "high").orderBy("id_a")  # A finds B before B finds A
    once = kept.withColumns({"low": low, "high": high}).withColumn("n", F.row_number().over(one)).where("n = 1")
    return once.select("id_a", "id_b", "score", "hash_score", "color_score", "time_seconds", F.lit(False).alias("identical_file"))


def all_pairs(identical: DataFrame, near: DataFrame) -> DataFrame:
    """Exact pairs first; a near pair of the same two videos, either way round, goes."""
    keyed = lambda df: df.withColumns(dict(zip(("low", "high"), S.pair_key(F.col("id_a"), F.col("id_b")))))
    known = keyed(identical).select("low", "high")
    return identical.unionByName(keyed(near).join(known, ["low", "high"], "left_anti").drop("low", "high"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) over pairs (id_a, id_b); label is the smallest id reachable.

    Rounds of a large star and a small star, each written to the shared folder, until links are stars around the smallest
    id of each component; the number of links never grows. They are joined within tasks as well, which leaves one link for
    each node of a batch's groups. A node with very many links is a join key with one row on the other side, which the
    adaptive skew join splits.
    """
    edges = pairs.select(F.col("id_a").cast("long").alias("a"), F.col("id_b").cast("long").alias("b")).where("a is not null and b is not null")
    first = saved(edges.mapInArrow(_stars, LINKS), "edges")  # a node without links to others has one to itself
    links = first.where("a < b")
    while not _are_stars(links):
        links = saved(_small_star(_large_star(links)).mapInArrow(_stars, LINKS).where("a < b").distinct(), "links")
    nodes, centre = first.select(F.col("b").alias("node")).distinct(), links.select("b", F.col("a").alias("centre"))
    return nodes.join(centre, F.col("node") == F.col("b"), "left").select("node", F.coalesce("centre", "node").alias("label"))


def _are_stars(links: DataFrame) -> bool:
    several = links.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b")
    chained = links.join(links.select(F.col("b").alias("below")), F.col("a") == F.col("below"), "left_semi").select("b")
    return several.unionByName(chained).isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours."""
    ends = links.select(F.col("a").alias("of"), F.col("a").alias("near")).unionByName(links.select(F.col("b").alias("of"), F.col("a").alias("near")))
    low = ends.groupBy("of").agg(F.min("near").alias("low"))
    return links.join(low, F.col("a") == F.col("of")).select(F.col("low").alias("a"), "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    low = links.groupBy(F.col("b").alias("of")).agg(F.min("a").alias("low"))
    others = links.join(low, F.col("b") == F.col("of")).where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return low.select(F.col("low").alias("a"), F.col("of").alias("b")).unionByName(others)


def _stars(batches):
    """Links of a batch as (smallest node of its group there, node)."""
    for batch in batches:
        nodes, number = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True)
        a, b = number[: batch.num_rows], number[batch.num_rows :]
        root = np.arange(len(nodes))
        while True:  # smallest root of both ends, then pointer jumping, until all links agree
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
            if (root[a] == root[b]).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root]), pa.array(nodes)], ["a", "b"])


def groups(pairs: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups: group_id (smallest id), n_members, suggested_keep_id (the largest), best_score, identical_file, best group
    first. Members: group_id, id, size, a row for each."""
    labels = components(pairs)
    size = videos.select(F.col("id").alias("node"), F.coalesce("size", F.lit(0)).alias("size"))
    members = labels.join(size, "node", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    members = members.select(F.col("label").alias("group_id"), F.col("node").alias("id"), "size")
    largest = F.min_by("id", F.struct((-F.col("size")).alias("by"), "id"))
    counted = members.groupBy("group_id").agg(F.count("*").alias("n_members"), largest.alias("suggested_keep_id"))
    scores = pairs.join(labels, F.col("id_a") == F.col("node")).groupBy(F.col("label").alias("group_id")).agg(F.max("score").alias("best_score"), F.bool_or("identical_file").alias("identical_file"))
    return counted.join(scores, "group_id").orderBy(F.desc("best_score"), "group_id"), members


def kept_members(members: DataFrame, suggested: DataFrame, kept: DataFrame) -> DataFrame:
    """group_id, keep_id: a chosen member (the first by place of several, by id in one place), else the suggestion, else the first.

    members: group_id, id, place, a row for each; suggested: group_id, suggested_keep_id; kept: id.
    """
    chosen = kept.select(F.col("id").alias("chosen_id")).distinct()
    marked = members.join(chosen, F.col("id") == F.col("chosen_id"), "left")
    order = F.struct("place", "id")
    found = marked.groupBy("group_id").agg(F.min_by("id", F.when(F.col("chosen_id").isNotNull(), order)).alias("picked"), F.min_by("id", order).alias("first"))
    s = suggested.select(F.col("group_id").alias("of"), "suggested_keep_id")
    return found.join(s, F.col("group_id").eqNullSafe(F.col("of")), "left").select("group_id", F.coalesce("picked", "suggested_keep_id", "first").alias("keep_id"))
