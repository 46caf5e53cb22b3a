"""Aggregates with a rule for ties: votes, unions, longest texts, merged frame captions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.scans import Ordered, numbered
from lumenframe.sources.shared import written


def majority_vote(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Each group's most frequent known value, of equals the one met first; 'unknown' if it has none."""
    counts = df.where(F.col(value).isNotNull() & ~F.col(value).isin("", "unknown")).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    best = counts.groupBy(*by).agg(F.max_by(value, F.struct("__n", (-F.col("__first")).alias("f"))).alias(value))
    return df.select(*by).distinct().join(best, by, "left").select(*by, F.coalesce(value, F.lit("unknown")).alias(value))


def longest(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The longest text of each group, of equals the first."""
    return df.groupBy(*by).agg(F.coalesce(F.max_by(value, F.when(F.col(value) != "", F.struct(F.length(value), -F.col(order)))), F.lit("")).alias(value))


def ordered_union(df: DataFrame, by: list[str], values: str, order: str, most: int = 20) -> DataFrame:
    """Distinct elements of arrays without regard to case, in the order met, as first written, at most `most`."""
    flat = df.select(*by, F.col(order).alias("__o"), F.posexplode(values).alias("__p", "__v")).withColumn("__v", F.trim("__v")).where("__v <> ''")
    firsts = flat.groupBy(*by, F.lower("__v").alias("__k")).agg(F.min(F.struct("__o", "__p", "__v")).alias("f"))
    sorted_ = F.slice(F.array_sort(F.collect_list("f")), 1, most)
    return firsts.groupBy(*by).agg(F.transform(sorted_, lambda s: s["__v"]).alias(values))


def first_filled(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.min_by(value, F.when(F.col(value) != "", F.col(order))), F.lit("")).alias(value))


def merge_frames(frames: DataFrame) -> DataFrame:
    """frames(video_id, pos, scalar attributes, caption, people_description, objects, festival_name, person_count) -> a row a video."""
    votes = ["scene", "location_type", "weather", "season", "time_of_day", "occasion", "group_size", "clothing_style", "mood"]
    out = frames.groupBy("video_id").agg(F.max(F.coalesce("person_count", F.lit(0))).alias("person_count"))
    for c in votes:
        out = out.join(majority_vote(frames, ["video_id"], c, "pos"), "video_id")
    for c in ("caption", "people_description"):
        out = out.join(longest(frames, ["video_id"], c, "pos"), "video_id")
    out = out.join(first_filled(frames, ["video_id"], "festival_name", "pos"), "video_id")
    return out.join(ordered_union(frames, ["video_id"], "objects", "pos"), "video_id", "left")


def _runs(log: DataFrame, by: list[str], order: list, status: str) -> Ordered:
    """log with `failures`: all failures so far less those up to the last success."""
    fails = Ordered(log, by, order).add(sums={"__fails": (F.col(status) == "fail").cast("long")})
    fails = fails.add(maxima={"__reset": F.when(F.col(status) == "ok", F.coalesce("__fails", F.lit(0)))})
    fails.df = fails.df.withColumn("failures", F.coalesce("__fails", F.lit(0)) - F.coalesce("__reset", F.lit(0))).drop("__fails", "__reset")
    return fails


def failure_runs(log: DataFrame, by: list[str], order: list[str], status: str = "status") -> DataFrame:
    """log with `failures`: failures since the last success; a skipped item changes nothing. A log of any length is many ranges."""
    return _runs(log, by, order, status).rows()


def until_abort(log: DataFrame, by: list[str], order: list[str], most: int, status: str = "status") -> DataFrame:
    """log up to the row at which a job gives up, and `aborted`."""
    over = (F.col("failures") >= most).cast("long")
    runs = _runs(log, by, order, status).add(sums={"__over": over})
    return runs.rows().withColumn("aborted", F.col("failures") >= most).where(F.col("__over") - F.col("aborted").cast("long") == 0).drop("__over")


def sliding_counts(requests: DataFrame, by: str, ts: str, spans: dict[str, int]) -> DataFrame:
    """requests with the number of requests in (t - span, t] for each span in seconds; null for a request without a time.

    That is a difference of two prefix counts. The points at which they are wanted are merged with the requests, so nothing
    is held that is as long as a span, however many requests that has.
    """
    at = requests.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = written(numbered(at.where("__us IS NOT NULL"), ["__us"], [by], "__no"), "requests")
    ends = {"__all": 0} | {name: span * 1_000_000 for name, span in spans.items()}
    own = rows.select(by, F.col("__us").alias("__x"), F.lit(0).alias("__ask"), F.lit(None).cast("long").alias("__no"), F.lit(None).cast("string").alias("__end"))
    asked = [rows.select(by, (F.col("__us") - gone).alias("__x"), F.lit(1).alias("__ask"), "__no", F.lit(name).alias("__end")) for name, gone in ends.items()]
    counted = Ordered(reduce(DataFrame.unionByName, asked, own), [by], ["__x", "__ask", "__no"]).add(sums={"__n": 1 - F.col("__ask")}).rows().where("__ask = 1")
    wide = counted.groupBy(F.col(by).alias("__by"), F.col("__no").alias("__of")).agg(*(F.max(F.when(F.col("__end") == name, F.col("__n"))).alias(f"__at_{name}") for name in ends))
    found = rows.join(wide, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__no") == F.col("__of")))
    found = found.select(*requests.columns, *((F.col("__at___all") - F.col(f"__at_{name}")).alias(name) for name in spans))
    return found.unionByName(at.where("__us IS NULL").select(*requests.columns, *(F.lit(None).cast("long").alias(name) for name in spans)))


def job_counters(log: DataFrame) -> DataFrame:
    return log.groupBy("job_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "fail", "skipped")], F.count(F.lit(1)).alias("done"), F.array_sort(F.collect_set(F.when(F.col("status") == "fail", F.col("item_id")))).alias("failed_ids"))


def job_conflicts(jobs: DataFrame) -> DataFrame:
    """(a, b) of running jobs that claim a common resource, through the resources and not through all pairs."""
    r = jobs.where("running").select("job_id", F.explode(F.array_distinct("resources")).alias("r"))
    return r.select(F.col("job_id").alias("a"), "r").join(r.select(F.col("job_id").alias("b"), "r"), "r").where("a < b").select("a", "b").distinct()


def primary_job(jobs: DataFrame) -> DataFrame:
    """The latest-started running job, else the latest."""
    return jobs.orderBy(F.desc("running"), F.desc("started_at"), "job_id").limit(1)


def keep_finished(jobs: DataFrame, n: int = 8) -> DataFrame:
    """Running jobs, and the last n finished ones."""
    done = jobs.where("NOT running").orderBy(F.desc("started_at"), "job_id").limit(n)
    return jobs.where("running").unionByName(done)
