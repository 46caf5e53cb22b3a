"""Density-based clustering of vectors, identities carried over, grouping inside one video."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.vectors import cosine_distance, fingerprint, mean_vectors
from lumenframe.operators.components import connected_components
from lumenframe.operators.metric import class_degrees, class_forest, neighbours, onto_members, vector_classes
from lumenframe.sources.shared import written


def dbscan(df: DataFrame, key: str, vector: str = "embedding", eps: float = 0.5, min_samples: int = 3, report: dict | None = None) -> DataFrame:
    """(key, cluster, core): cluster -1 is noise; ids by size, largest first, ties by the smallest member.

    A row counts among its own neighbours. A border row goes to the adjacent cluster whose smallest core is smallest. Equal vectors
    are one class that counts as often as it has rows, so copies cost their number and not its square. Rows are compared twice: to count
    neighbours, then to join cores; neither passes on the links themselves, of which a dense table has the square of its rows.
    """
    members, reps = vector_classes(df, key, vector, zeros_apart=eps < 1)
    weights = reps.select(F.col("k").alias("id"), "n")
    others = class_degrees(reps, eps, report).withColumnRenamed("rep", "id")
    core = written(weights.join(others, "id", "left").where(F.col("n") + F.coalesce("others", F.lit(0)) >= min_samples).select("id"), "core")
    flagged = reps.select("k", "v").join(core.select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")), "k", "left").select("k", "v", F.coalesce("n", F.lit(0)).alias("n"))
    forest = class_forest(flagged, eps)
    labels = written(connected_components(core, forest.where("core").select("a", "b")), "labels")
    border = forest.where("NOT core").join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("component"))
    classes = labels.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    # A component's least class holds its least core; its least member may be on the border.
    sizes = classes.join(weights, "id").groupBy("component").agg(F.sum("n").alias("n"), F.min("id").alias("first"))
    ranked = sizes.select("component", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("cluster"))  # one row a cluster
    of = classes.join(ranked, "component").select(F.col("id").alias("rep"), "cluster", "core")
    out = df.select(F.col(key).alias("id")).join(onto_members(members, of).select(F.col("k").alias("id"), "cluster", "core"), "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))


def cluster_table(faces: DataFrame, labels: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(cluster_id, size, mean_embedding) of labelled faces; noise left out. labels(key.., cluster)."""
    key = key or ["image_id", "face_index"]
    j = faces.join(labels.where("cluster >= 0"), key)
    sizes = j.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return mean_vectors(j, ["cluster"], out="mean_embedding").join(sizes, "cluster").withColumnRenamed("cluster", "cluster_id")


def carry_over(new: DataFrame, old: DataFrame, new_means: DataFrame, old_means: DataFrame, names: DataFrame, least_overlap: float = 0.5, most_distance: float = 0.1) -> DataFrame:
    """(cluster_id, name, status) of the new run: the old cluster that holds more than `least_overlap` of the new one's
    members, else the one with the nearest mean within `most_distance`; else status 'new'. Two new clusters may inherit
    the same identity. new and old: (member, cluster); means: (cluster, mean); names: (cluster, name, status)."""
    n = new.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    shared = new.join(old.select("member", F.col("cluster").alias("old")), "member").groupBy("cluster", "old").agg(F.count(F.lit(1)).alias("shared"))
    w = Window.partitionBy("cluster").orderBy(F.desc("shared"), "old")
    best = shared.join(n, "cluster").where(F.col("shared") > least_overlap * F.col("n")).withColumn("r", F.row_number().over(w)).where("r = 1").select("cluster", "old")
    # Means that are near meet in an exact blocked join on unit vectors.
    rest = new_means.join(best, "cluster", "left_anti").select(F.concat(F.lit("n"), F.col("cluster").cast("string")).alias("k"), "mean")
    both = rest.unionByName(old_means.select(F.concat(F.lit("a"), F.col("cluster").cast("string")).alias("k"), "mean"))
    near = neighbours(both, "k", "mean", most_distance).where(F.startswith("a", F.lit("a")) & F.startswith("b", F.lit("n")))
    near = near.select(F.substring("b", 2, 20).cast("int").alias("cluster"), F.substring("a", 2, 20).cast("int").alias("old"), "distance")
    w = Window.partitionBy("cluster").orderBy("distance", "old")
    best = best.unionByName(near.withColumn("r", F.row_number().over(w)).where("r = 1").select("cluster", "old"))
    out = n.join(best, "cluster", "left").join(names.select(F.col("cluster").alias("old"), "name", "status"), "old", "left")
    return out.select(F.col("cluster").alias("cluster_id"), F.col("n").alias("size"), "name", F.coalesce("status", F.lit("new")).alias("status"))


def member_state(members: DataFrame, faces: DataFrame) -> DataFrame:
    """members(cluster_id, image_id, face_index, fp) with the current embedding if its fingerprint still fits, else NULL."""
    now = faces.select("image_id", "face_index", "embedding", fingerprint("embedding").alias("__now"))
    j = members.join(now, ["image_id", "face_index"], "left")
    return j.withColumn("embedding", F.when(F.col("__now") == F.col("fp"), F.col("embedding"))).drop("__now")


def cluster_means(members: DataFrame, faces: DataFrame) -> DataFrame:
    """(cluster_id, state, mean): 'stale' if no member fits any more, else the mean of those that do."""
    s = member_state(members, faces)
    counts = s.groupBy("cluster_id").agg(F.count("embedding").alias("n"))
    means = mean_vectors(s.where("embedding IS NOT NULL"), ["cluster_id"])
    return counts.join(means, "cluster_id", "left").select("cluster_id", F.when(F.col("n") == 0, "stale").otherwise("fresh").alias("state"), "mean")


def list_clusters(clusters: DataFrame, samples: int) -> DataFrame:
    """Clusters that are not ignored, with their first members."""
    if not 1 <= samples <= 20:
        raise ValueError("samples must be from 1 to 20")
    return clusters.where("status <> 'ignored'").withColumn("members", F.slice("members", 1, samples)).orderBy("cluster_id")


def set_status(clusters: DataFrame, cluster_id: int, status: str, name: str | None = None) -> DataFrame:
    own = F.col("cluster_id") == cluster_id
    return clusters.withColumns({"status": F.when(own, F.lit(status)).otherwise(F.col("status")), "name": F.when(own & F.lit(name is not None), F.lit(name)).otherwise(F.col("name"))})


GROUPED = "video_id string, face_index int, bbox array<double>, group int, members int"


def _greedy(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("face_index").reset_index(drop=True)
        v = np.array(pdf.embedding.tolist(), np.float64)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        unit = v / np.where(norm == 0, 1, norm)
        sums, centres, group = [], np.zeros((0, v.shape[1])), np.zeros(len(v), int)
        for i, x in enumerate(unit):
            sims = centres @ x
            best = int(sims.argmax()) if len(sims) else -1
            if best >= 0 and sims[best] >= threshold:
                sums[best] = sums[best] + x
            else:
                best = len(sums)
                sums.append(x.copy())
                centres = np.vstack([centres, x])
            length = np.linalg.norm(sums[best])
            centres[best] = sums[best] / length if length else sums[best]
            group[i] = best
        pdf["group"] = group
        b = np.array([x if x is not None and len(x) == 4 else [0] * 4 for x in pdf.bbox], float)
        pdf["area"] = np.maximum(0, b[:, 2] - b[:, 0]) * np.maximum(0, b[:, 3] - b[:, 1])
        pdf["members"] = pdf.groupby("group").face_index.transform("size")
        top = pdf.sort_values(["group", "area", "face_index"], ascending=[True, False, True]).drop_duplicates("group")
        return top[["video_id", "face_index", "bbox", "group", "members"]]

    return run


def group_in_video(faces: DataFrame, threshold: float = 0.45) -> DataFrame:
    """One face for each person of a video: faces in order join the nearest running centre within the threshold;
    the face with the largest box stands for its group. Order decides, so a video is one group; it holds few frames."""
    rows = faces.where("embedding IS NOT NULL AND size(embedding) > 0").select("video_id", "face_index", "bbox", "embedding")
    return rows.groupBy("video_id").applyInPandas(_greedy(threshold), GROUPED)


def person_images(faces: DataFrame, embedding: list[float], threshold: float = 0.4, most: int = 10_000) -> DataFrame:
    """Distinct images with a face within the cosine distance, among the `most` nearest."""
    q = F.array(*[F.lit(float(x)) for x in embedding])
    near = faces.select("image_id", "face_index", cosine_distance("embedding", q).alias("distance")).orderBy("distance", "image_id", "face_index").limit(most)
    return near.where(F.col("distance") <= threshold).select("image_id").distinct()
