"""Video fields, boxes, model names, quotas and other small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.text import col, contains_any

# Name patterns of models, published quotas, and relations.
VISION_NAMES = ("llava", "bakllava", "moondream", "minicpm-v", "pixtral", "cogvlm", "idefics", "-vl", "vl-", "vision", "visual", "multimodal", "gemma-3-", "gemma-4-")
EMBED_NAMES = ("embed", "nomic", "bge-", "e5-", "gte-", "minilm", "mpnet", "mxbai", "sfr-embedding")
NOT_FOR_IMAGES = "Embedding model — not suitable for image analysis"
TEXT_ONLY = "Text-only model — cannot analyze images"
BOTH_NAMES = "Name matches both vision and embed patterns — verify model type"
NO_NAME = "Cannot determine model type from name — image output may be unreliable"
QUOTAS = (("embedding", {"rpm": 100, "rpd": 1000}), ("flash-lite", {"rpm": 15, "rpd": 500}), ("", {"rpm": 10, "rpd": 250}))
QUOTA_IDS = (("PerSecond", "rps"), ("PerMinute", "rpm"), ("PerHour", "rph"), ("PerDay", "rpd"))
WINDOWS = {"rps": 1, "rpm": 60, "rph": 3600, "rpd": 86400}
RELATIONS = (
    "self", "spouse", "partner", "mother", "father", "parent", "son", "daughter", "child", "brother", "sister", "sibling", "grandmother", "grandfather",
    "grandparent", "grandchild", "aunt", "uncle", "cousin", "niece", "nephew", "in-law", "friend", "colleague", "other", "",
)
NOT_FAMILY = ("friend", "colleague", "other", "")
CONNECTION_WORDS = ("connection", "refused", "unreachable", "timeout", "connect error", "cannot connect")


def box_area(b) -> Column:
    b = col(b)
    return F.coalesce(F.greatest(F.get(b, F.lit(2)) - F.get(b, F.lit(0)), F.lit(0.0)) * F.greatest(F.get(b, F.lit(3)) - F.get(b, F.lit(1)), F.lit(0.0)), F.lit(0.0))


def crop_box(b, width, height, pad: float = 0.3) -> Column:
    """A face's box padded on each side by a share of its size, inside the image, in whole pixels."""
    x1, y1, x2, y2 = (F.get(col(b), F.lit(i)) for i in range(4))
    dx, dy, w, h = (x2 - x1) * pad, (y2 - y1) * pad, col(width), col(height)
    return F.array(F.greatest(F.lit(0), (x1 - dx).cast("int")), F.greatest(F.lit(0), (y1 - dy).cast("int")), F.least(w, (x2 + dx).cast("int")), F.least(h, (y2 + dy).cast("int")))


def poster_time(duration) -> Column:
    return F.least(F.greatest(0.1 * F.coalesce(col(duration), F.lit(0.0)), F.lit(0.0)), F.lit(3.0))


def uniform_times(duration, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.round(col(duration) / (n + 1) * i, 3))


def thin(times, most: int) -> Column:
    """At most `most` elements, at evenly spaced places."""
    t = col(times)
    step = F.size(t) / F.lit(most)
    pick = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(t, F.least(F.size(t) - 1, F.floor(i * step).cast("int"))))
    return F.when(F.size(t) <= most, t).otherwise(pick)


def keyframe_times(cuts, duration, most: int) -> Column:
    """Scene cuts and anchors at 10, 50 and 90 percent, to a tenth, sorted, strictly inside, thinned."""
    d = col(duration)
    anchors = F.array(*[d * x for x in (0.1, 0.5, 0.9)])
    both = F.transform(F.concat(F.coalesce(col(cuts), F.array().cast("array<double>")), anchors), lambda x: F.round(x, 1))
    return thin(F.array_sort(F.array_distinct(F.filter(both, lambda x: (x > 0) & (x < d)))), most)


def clamp_frames(n) -> Column:
    return F.least(F.greatest(F.coalesce(F.try_to_number(col(n).cast("string"), F.lit("S999999999")).cast("int"), F.lit(4)), F.lit(1)), F.lit(12))


def probe_duration(text) -> Column:
    part = lambda i: F.nullif(F.regexp_extract(col(text), r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", i), F.lit("")).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def probe_size(text) -> Column:
    part = lambda i: F.nullif(F.regexp_extract(col(text), r"Video:.*?(\d{2,5})x(\d{2,5})", i), F.lit("")).cast("int")
    return F.struct(part(1).alias("width"), part(2).alias("height"))


def probe_codec(text) -> Column:
    return F.nullif(F.regexp_extract(col(text), r"Video:\s*([A-Za-z0-9_]+)", 1), F.lit(""))


def probe_created(text) -> Column:
    return F.nullif(F.regexp_extract(col(text), r"creation_time\s*:\s*(\S+)", 1), F.lit(""))


def scene_times(text) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit(r"pts_time:(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


PROBE = (
    "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,duration:string,avg_frame_rate:string,r_frame_rate:string,"
    "tags:map<string,string>,side_data_list:array<struct<rotation:string>>>>, format struct<duration:string,tags:map<string,string>>"
)


def probe_report(text) -> Column:
    """struct(duration_s, width, height, codec, capture_time, fps, rotation, has_audio) of a JSON probe; NULL without a video stream."""
    r = F.from_json(col(text), PROBE)
    v = F.get(F.filter(r["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    number = lambda c: F.nullif(c.try_cast("double"), F.lit(0.0))
    turns = F.filter(F.transform(v["side_data_list"], lambda d: d["rotation"].try_cast("double").cast("int")), lambda x: x.isNotNull())
    turn = F.coalesce(F.try_element_at(turns, F.lit(-1)), v["tags"]["rotate"].try_cast("int"))
    stamp = lambda tags: F.nullif(tags["creation_time"], F.lit(""))
    found = F.struct(
        F.round(F.coalesce(number(v["duration"]), number(r["format"]["duration"])), 3).alias("duration_s"), v["width"].alias("width"), v["height"].alias("height"),
        v["codec_name"].alias("codec"), F.coalesce(stamp(v["tags"]), stamp(r["format"]["tags"])).alias("capture_time"),
        F.round(frame_rate(F.coalesce(F.nullif(v["avg_frame_rate"], F.lit("")), v["r_frame_rate"])), 3).alias("fps"), F.pmod(turn, F.lit(360)).alias("rotation"),
        F.exists(r["streams"], lambda s: s["codec_type"] == "audio").alias("has_audio"),
    )
    return F.when(v.isNotNull(), found)


def frame_rate(fraction) -> Column:
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(col(fraction), r"^(\d+)/(\d+)$", i), F.lit("")), F.lit("9" * 12)).cast("double")
    return F.try_divide(part(1), part(2))


def rotation(degrees) -> Column:
    return F.pmod(col(degrees), F.lit(360))


def collection_slug(model) -> Column:
    inner = F.btrim(F.regexp_replace(F.lower(col(model)), "[^a-z0-9]", "_"), F.lit("_"))
    return F.substring(F.concat(F.lit("img_"), inner), 1, 63)


def model_label(provider, model) -> Column:
    p = F.coalesce(col(provider), F.lit("auto"))
    return F.when(~p.isin("auto", "9router"), F.concat(p, F.lit(":"), col(model)))


def model_class(name, reported=None, state=None) -> Column:
    """struct(type, state, warning): the server's report if there is one, else by the name's patterns."""
    n = F.lower(col(name))
    vision, embed = contains_any(n, VISION_NAMES), contains_any(n, EMBED_NAMES)
    kind = F.when(embed & ~vision, "embed").when(vision & ~embed, "vision").otherwise("unknown")
    warning = F.when(embed & ~vision, NOT_FOR_IMAGES).when(vision & embed, BOTH_NAMES).when(~vision & ~embed, NO_NAME)
    if reported is None:
        return F.struct(kind.alias("type"), F.lit(None).cast("string").alias("state"), warning.alias("warning"))
    r = col(reported)
    said = F.when(r == "vlm", "vision").when(r == "embeddings", "embed").when(r == "llm", "text-only").otherwise("unknown")
    return F.struct(
        F.when(r.isNull(), kind).otherwise(said).alias("type"), F.when(r.isNotNull(), col(state)).alias("state"),
        F.when(r.isNull(), warning).when(r == "embeddings", NOT_FOR_IMAGES).when(r == "llm", TEXT_ONLY).alias("warning"),
    )


def relation_fields(relation, is_family=None) -> Column:
    """struct(relation, is_family, valid): unless said otherwise, family follows from the relation."""
    r = F.lower(F.trim(F.coalesce(col(relation), F.lit(""))))
    family = ~r.isin(*NOT_FAMILY)
    return F.struct(r.alias("relation"), (family if is_family is None else F.coalesce(col(is_family), family)).alias("is_family"), r.isin(*RELATIONS).alias("valid"))


def suggested_quota(provider, model, learned=None) -> Column:
    """map of window to struct(value, source): published by the first pattern in the name, overridden by learned values; NULL for others."""
    kind = "map<string,struct<value:int,source:string>>"
    table = None
    for pattern, values in QUOTAS:
        m = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.struct(F.lit(v).alias("value"), F.lit("published").alias("source")) for v in values.values()]))
        table = F.when(F.contains(col(model), F.lit(pattern)), m) if table is None else table.when(F.contains(col(model), F.lit(pattern)), m)
    if learned is not None:
        own = F.transform_values(F.coalesce(col(learned), F.create_map().cast("map<string,int>")), lambda k, v: F.struct(v.alias("value"), F.lit("learned").alias("source")))
        table = F.map_concat(F.map_filter(table, lambda k, v: ~F.map_contains_key(own, k)), own)
    return F.when(col(provider) == "gemini", table.cast(kind))


ERROR_BODY = "error struct<details:array<struct<`@type`:string,violations:array<struct<quotaId:string,quotaValue:string,quotaDimensions:struct<model:string>>>>>>"


def learned_quotas(df, body: str = "body", model: str = "model"):
    """(model, window, value) rows of quota failures in error bodies; unreadable ones give none, the last value wins upstream."""
    parsed = df.select(F.col(model).alias("asked"), F.from_json(body, ERROR_BODY).alias("b"))
    details = parsed.select("asked", F.explode("b.error.details").alias("d")).where(F.endswith(F.col("d.@type"), F.lit("QuotaFailure")))
    v = details.select("asked", F.explode("d.violations").alias("v"))
    value = F.try_to_number("v.quotaValue", F.lit("S999999999")).cast("int")
    window = F.explode(F.filter(F.array(*[F.when(F.contains("v.quotaId", F.lit(t)), F.lit(w)) for t, w in QUOTA_IDS]), lambda x: x.isNotNull()))
    return v.select(F.coalesce(F.nullif("v.quotaDimensions.model", F.lit("")), "asked").alias("model"), window.alias("window"), value.alias("value")).where("value > 0")


def cooldown(now, retry_after, least: float = 90.0) -> Column:
    """Seconds of epoch until which a provider rests."""
    return col(now) + F.greatest(F.coalesce(col(retry_after), F.lit(0.0)), F.lit(least))


def remaining(until, now) -> Column:
    return F.round(F.greatest(col(until) - col(now), F.lit(0.0)), 1)


def is_connection_error(message) -> Column:
    return F.coalesce(contains_any(F.lower(col(message)), CONNECTION_WORDS), F.lit(False))


# Parts of the names by which a gateway's models count as able to see, and those left out of its list.
SEEING = ("gemini", "gemma", "claude", "gpt-5", "qwen-vl", "-vl")
UNLISTED = ("-thinking", "-agentic", "embedding")


def listed_model(name) -> Column:
    """Whether a gateway's model belongs in the list of those that caption images."""
    n = F.lower(col(name))
    return F.coalesce(contains_any(n, SEEING) & ~contains_any(n, UNLISTED), F.lit(False))


def offers(methods, output_limit, method: str) -> Column:
    """Whether a catalogue's entry supports a method and gives any output; an entry without a limit counts as giving some."""
    return F.coalesce(F.array_contains(col(methods), method), F.lit(False)) & (F.coalesce(col(output_limit), F.lit(1)) > 0)


def same_model(asked, served) -> Column:
    """Whether the model that answered is the one asked for, by name containment."""
    a, s = F.lower(col(asked)), F.lower(col(served))
    return F.contains(a, s) | F.contains(s, a)


def job_rate(done, total, elapsed) -> Column:
    """struct(per_minute, eta_seconds)."""
    rate = F.try_divide(col(done).cast("double"), F.nullif(col(elapsed).cast("double"), F.lit(0.0)))
    return F.struct(F.round(rate * 60, 1).alias("per_minute"), F.round(F.try_divide((col(total) - col(done)).cast("double"), F.nullif(rate, F.lit(0.0)))).cast("long").alias("eta_seconds"))
