"""Work queues as anti-joins, and stage statistics in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.captions import has_caption
from lumenframe.functions.paths import is_video

# The attributes whose absence marks a row as stale.
STALE = ("weather", "occasion", "location_type", "scene", "mood")


def not_in(df: DataFrame, done: DataFrame, key: str, done_key: str = "id") -> DataFrame:
    return df.join(done.select(F.col(done_key).alias(key)), key, "left_anti")


def photos(media: DataFrame) -> DataFrame:
    return media.where(~is_video("media_type", "path"))


def videos(media: DataFrame) -> DataFrame:
    return media.where(is_video("media_type", "path"))


def missing(media: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Stills that are not embedded; all of them without an active model."""
    return photos(media) if vectors is None else not_in(photos(media), vectors, "uid")


def embed_pending(media: DataFrame, vectors: DataFrame) -> DataFrame:
    """Captioned stills that are not embedded."""
    return not_in(photos(media).where(has_caption("caption_json", "caption")), vectors, "uid")


def embed_pending_for(media: DataFrame, vectors: DataFrame, caption_model: str | None) -> DataFrame:
    """Rows that could be embedded from a caption (any that is not empty, or a given model's) and are not."""
    able = F.coalesce(F.col("caption_json") != "", F.lit(False)) if caption_model is None else F.coalesce(F.exists("caption_history", lambda h: h["model"] == caption_model), F.lit(False))
    return not_in(media.where(able), vectors, "uid")


def vision_pending(media: DataFrame, model: str | None = None) -> DataFrame:
    """Stills without any caption, or without one of the given model."""
    if model is None:
        return photos(media).where(~has_caption("caption_json", "caption"))
    return photos(media).where(~F.coalesce(F.exists("caption_history", lambda h: h["model"] == model), F.lit(False)))


def video_vision_pending(media: DataFrame) -> DataFrame:
    return videos(media).where(~has_caption("caption_json", "caption"))


def faces_pending(media: DataFrame, faces: DataFrame, video: bool = False) -> DataFrame:
    return not_in(videos(media) if video else photos(media), faces.select("image_id").distinct(), "uid", "image_id")


def thumbs_pending(media: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose derivative's key (SHA-1 of the id) is not in keys(key)."""
    return media.join(keys.select(F.col("key").alias("__k")), F.sha1(F.col("uid").cast("binary")) == F.col("__k"), "left_anti")


def hash_pending(media: DataFrame) -> DataFrame:
    return photos(media).where(F.coalesce("dhash", F.lit("")) == "")


def stale_attributes(vectors: DataFrame, media: DataFrame, attributes: tuple[str, ...] = STALE) -> DataFrame:
    """Catalogued rows all of whose attributes are unknown, empty or NULL in the vector table."""
    unknown = F.forall(F.array(*[F.col(a).cast("string") for a in attributes]), lambda x: x.isNull() | x.isin("unknown", ""))
    return media.join(vectors.where(unknown).select(F.col("id").alias("uid")), "uid", "left_semi")


def missing_files(media: DataFrame, listing: DataFrame) -> DataFrame:
    return media.join(listing.select("path"), "path", "left_anti")


def orphans_to_clean(media: DataFrame, listing: DataFrame, asked: DataFrame) -> DataFrame:
    """Of the rows asked for, those whose file is gone."""
    return missing_files(media.join(asked.select("uid"), "uid", "left_semi"), listing)


def stage_stats(media: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: totals, captioned and embedded counts, and pending ones: by difference of counts, clamped at 0, and by join."""
    m = media.select("uid", is_video("media_type", "path").alias("video"), has_caption("caption_json", "caption").alias("captioned"))
    j = m.join(vectors.select(F.col("id").alias("uid"), F.lit(True).alias("__in")).distinct(), "uid", "full_outer")
    here, got = F.col("video").isNotNull(), F.coalesce("__in", F.lit(False))
    a = j.agg(
        F.count_if(here).alias("total"), F.count_if(~F.col("video")).alias("photos"), F.count_if("video").alias("videos"),
        F.count_if(F.col("captioned") & ~F.col("video")).alias("captioned"), F.count_if(got).alias("embedded"), F.count_if(got & here).alias("embedded_here"),
        F.count_if(F.col("captioned") & ~F.col("video") & ~got).alias("embed_pending_listed"),
    )
    return a.withColumn("embed_pending", F.greatest(F.lit(0), F.col("captioned") - F.col("embedded")))


def face_stats(media: DataFrame, faces: DataFrame) -> DataFrame:
    """(video, total, detected, pending)."""
    done = faces.select(F.col("image_id").alias("uid"), F.lit(True).alias("__in")).distinct()
    j = media.select("uid", is_video("media_type", "path").alias("video")).join(done, "uid", "left")
    return j.groupBy("video").agg(F.count(F.lit(1)).alias("total"), F.count("__in").alias("detected"), F.count_if(F.col("__in").isNull()).alias("pending"))


def captions_per_model(media: DataFrame) -> DataFrame:
    """(model, n), entries without a model and errors left out, the most frequent first."""
    h = media.select(F.explode("caption_history").alias("h")).where("h.model <> '' AND h.model <> 'error'")
    return h.groupBy(F.col("h.model").alias("model")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "model")


def hash_stats(media: DataFrame) -> DataFrame:
    return photos(media).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("dhash", F.lit("")) != "").alias("hashed"))


def cluster_stats(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("status") == "named").alias("named"), F.coalesce(F.sum("size"), F.lit(0)).alias("faces"))
