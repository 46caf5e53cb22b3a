"""Enrichment jobs: an anti-join gives the work, a pluggable function does it batch by batch, outcomes are rows."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.media import CONNECTION_WORDS

OUTCOME = "id string, status string, payload string, error string, model string, seq long"


class Cancelled(BaseException):
    """Raised by a worker that was told to stop: what it had not finished gets no outcome and stays pending."""


class Worker(Protocol):
    """Takes a list of (id, value); gives for each (payload or None, error or None, model)."""

    def __call__(self, items: list[tuple[str, str]]) -> list[tuple[str | None, str | None, str]]: ...


def run(pending: DataFrame, make_worker: Callable[[], Worker], batch: int = 16, max_fail: int | None = None) -> DataFrame:
    """pending(id, value) -> (id, status, payload, error, model, seq). A worker is made once a task.

    A batch that raises fails as a whole. After `max_fail` consecutive failures a task leaves the rest of its items out,
    so they stay pending; with one partition that is the order-dependent rule of a serial job. NULL values are skipped.
    A worker that raises Cancelled ends its task's work: that batch and what follows stay pending.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker, failures, seq, stopped = make_worker(), 0, 0, False
        for frame in frames:
            out = []
            items = list(zip(frame.id, frame.value, strict=True))
            for first in range(0, len(items), batch):
                if stopped or max_fail is not None and failures >= max_fail:
                    break
                part = items[first : first + batch]
                todo = [(i, v) for i, v in part if v is not None]
                try:
                    done = dict(zip([i for i, _ in todo], worker(todo), strict=True)) if todo else {}
                except Cancelled:
                    stopped = True
                    break
                except Exception as e:  # noqa: BLE001  the batch's outcome
                    done = {i: (None, str(e), "") for i, _ in todo}
                for i, v in part:
                    if max_fail is not None and failures >= max_fail:
                        break
                    seq += 1
                    payload, error, model = done.get(i, (None, None, "")) if v is not None else (None, None, "")
                    status = "skipped" if v is None else "fail" if payload is None else "ok"
                    failures = {"ok": 0, "fail": failures + 1, "skipped": failures}[status]
                    out.append((i, status, payload, error, model, seq))
            yield pd.DataFrame(out, columns=["id", "status", "payload", "error", "model", "seq"])

    return pending.select(F.col("id").cast("string").alias("id"), F.col("value").cast("string").alias("value")).mapInPandas(work, OUTCOME)


def with_budget(call: Callable[[str, int], str], first: int = 4096, most: int = 16384) -> Callable[[str], str]:
    """A call that is repeated with twice the token budget until its answer is JSON or the budget is spent."""

    def ask(value: str) -> str:
        budget = first
        while True:
            answer = call(value, budget)
            try:
                json.loads(answer)
                return answer
            except ValueError:
                if budget >= most:
                    raise
                budget = min(most, 2 * budget)

    return ask


def run_slices(pending: DataFrame, make_worker: Callable[[], Worker], path: str, slices: int, stop: Callable[[], bool] = lambda: False, batch: int = 16, interrupt: Callable[[], bool] = lambda: False, tick: float = 0.2) -> bool:
    """Work in slices of hashed ids, each appended to the outcomes at `path`; whether all were done.

    stop() is asked before each slice, interrupt() every `tick` seconds while one runs: its tasks then end, whatever call or wait they are in. A slice is
    written under its own number, whole or not at all, so what was interrupted stays pending and a second run, over what is
    then pending, replaces nothing that another run wrote.
    """
    spark, run_id = pending.sparkSession, uuid.uuid4().hex
    part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(slices))
    for k in range(slices):
        if stop():
            return False
        group, failed = f"{run_id}-{k}", []

        def work(k=k, group=group, failed=failed):
            spark.sparkContext.setJobGroup(group, f"slice {k}", interruptOnCancel=True)
            try:
                run(pending.where(part == k), make_worker, batch).write.mode("overwrite").parquet(f"{path}/run={run_id}/slice={k}")
            except Exception as e:  # noqa: BLE001  looked at below
                failed.append(e)

        thread = InheritableThread(target=work)
        thread.start()
        stopped = False
        while thread.is_alive():
            thread.join(tick)
            if thread.is_alive() and not stopped and interrupt():
                stopped = True
            if stopped and thread.is_alive():
                spark.sparkContext.cancelJobGroup(group)  # again and again, for a job that was about to begin
        if failed and not stopped:
            raise failed[0]
        if stopped and failed:
            return False
    return True


def still_pending(pending: DataFrame, path: str) -> DataFrame:
    """pending(id, ..) without the ids that have an outcome at `path`."""
    done = pending.sparkSession.read.schema(OUTCOME).option("recursiveFileLookup", "true").parquet(path).where("status <> 'fail'")
    return pending.join(done.select(F.col("id").alias("__id")), F.col("id").cast("string") == F.col("__id"), "left_anti")


class Chain:
    """Providers in order of preference: (name, worker) pairs. An item goes to the next one only if this one cannot be reached;
    any other error is the item's outcome. The model is named after the provider that answered."""

    def __init__(self, providers: list[tuple[str, Worker]]):
        self.providers = providers

    def one(self, item):
        reasons = []
        for name, worker in self.providers:
            try:
                payload, error, model = worker([item])[0]
            except Exception as e:  # noqa: BLE001  decides about the next provider
                payload, error, model = None, str(e), ""
            if payload is not None:
                return payload, None, f"{name}:{model}"
            reasons.append(f"{name}: {error}")
            if not any(w in (error or "").lower() for w in CONNECTION_WORDS):
                break
        return None, "; ".join(reasons), "error"

    def __call__(self, items):
        return [self.one(i) for i in items]


def video_requests(frames: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(id, value) for one call a video: its frames(video_id, pos, frame) in order and its transcripts(video_id, text) as JSON.
    Videos have few frames, as many as were extracted. NULL, and so skipped, for a video whose frames are all NULL."""
    kept = frames.groupBy(F.col("video_id").alias("id")).agg(F.array_sort(F.collect_list(F.when(F.col("frame").isNotNull(), F.struct("pos", "frame")))).alias("f"))
    texts = transcripts.groupBy(F.col("video_id").alias("id")).agg(F.max("text").alias("text"))
    body = F.to_json(F.struct(F.transform("f", lambda x: x["frame"]).alias("frames"), F.coalesce("text", F.lit("")).alias("transcript")))
    return kept.join(texts, "id", "left").select("id", F.when(F.size("f") > 0, body).alias("value"))


def transcripts(videos: DataFrame, make_worker: Callable[[], Worker], batch: int = 16) -> DataFrame:
    """videos(id, value, has_audio) -> (id, text, language). Speech is a best effort: a video known to be without sound is not
    tried, and one that fails has an empty text. Unknown (NULL) has_audio is tried."""
    silent = F.coalesce(~F.col("has_audio"), F.lit(False))
    done = run(videos.select("id", F.when(~silent, F.col("value")).alias("value")), make_worker, batch)
    heard = F.from_json("payload", "text string, language string")
    return done.select("id", F.coalesce(F.btrim(heard["text"]), F.lit("")).alias("text"), heard["language"].alias("language"))


class FakeTranscriber:
    """A deterministic stand-in for speech recognition; it fails on values without a letter."""

    model = "fake:speech"

    def __call__(self, items):
        return [(json.dumps({"text": f" says {v} ", "language": "en"}), None, self.model) if any(c.isalpha() for c in v) else (None, "no speech", self.model) for _, v in items]


class FakeVideoCaptioner:
    """A deterministic stand-in for a model that sees all frames of a video at once."""

    model = "fake:video"

    def __call__(self, items):
        out = []
        for _, v in items:
            asked = json.loads(v)
            said = f", saying {asked['transcript']}" if asked["transcript"] else ""
            out.append((json.dumps({"caption": f"{len(asked['frames'])} frames from {asked['frames'][0]}{said}"}), None, self.model))
        return out


class FakeCaptioner:
    """A deterministic stand-in for a vision model."""

    model = "fake:caption"

    def __call__(self, items):
        return [(json.dumps({"caption": f"a picture of {v}", "scene": ["indoor", "outdoor"][len(v) % 2], "occasion": "unknown", "weather": "unknown", "group_size": "unknown"}), None, self.model) if v else (None, "empty", self.model) for _, v in items]


class FakeEmbedder:
    """A deterministic stand-in for an embedding model: unit vectors from a hash."""

    model = "fake:embed"

    def __init__(self, dimension: int = 8):
        self.dimension = dimension

    def vector(self, text: str) -> list[float]:
        raw = [b - 127.5 for b in hashlib.sha256(text.encode()).digest()[: self.dimension]]
        n = sum(x * x for x in raw) ** 0.5
        return [x / n for x in raw]

    def __call__(self, items):
        return [(json.dumps(self.vector(v)), None, self.model) for _, v in items]


def fake_faces(images: DataFrame, dimension: int = 4) -> DataFrame:
    """A table function's shape: 0 to 2 faces for each image, from the SHA-1 of its id."""
    number = lambda c, digits: F.conv(F.substring(F.sha1(c.cast("binary")), 1, digits), 16, 10).cast("long")
    key = F.col("id").cast("string")
    index = F.explode(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.pmod(number(key, 4), F.lit(3))))
    rows = images.select(F.col("id").alias("image_id"), index.alias("face_index"))
    at = lambda k: number(F.concat_ws(":", F.col("image_id").cast("string"), F.col("face_index").cast("string"), F.lit(str(k))), 4) / 65536.0
    return rows.withColumns({"bbox": F.array(*[F.lit(float(x)) for x in (0, 0, 10, 10)]), "embedding": F.array(*[at(k) for k in range(dimension)])})


def split_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return outcomes.where("status = 'ok'"), outcomes.where("status = 'fail'")
