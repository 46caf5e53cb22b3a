"""Caption JSON: parsing, validation, texts to embed, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.text import col

# The attributes of a caption, with their defaults, in the table's order.
DEFAULTS = {
    "caption": "", "scene": "unknown", "location_type": "unknown", "weather": "unknown", "season": "unknown", "time_of_day": "unknown",
    "occasion": "unknown", "festival_name": "", "group_size": "unknown", "person_count": 0, "clothing_style": "unknown", "mood": "unknown",
    "objects": "", "animals": "", "vehicles": "", "food_items": "", "activities": "", "photo_type": "unknown", "text_in_image": "",
    "landmark": "", "dominant_colors": "", "people_description": "",
}
LISTS = ("objects", "animals", "vehicles", "food_items", "activities", "dominant_colors")
REQUIRED = ("caption", "scene", "occasion", "weather", "group_size")
TAGS = ("occasion", "mood", "weather", "season", "time_of_day", "location_type", "clothing_style", "group_size", "photo_type")
NOT_JSON = "Output is not valid JSON — model may not support image input"


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(" \t\n\x0b\x0c\r"))


def parsed(text) -> Column:
    return F.try_parse_json(col(text))


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def _has(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _plain(item: Column) -> Column:
    """An element as text: strings bare, booleans and null as Python writes them."""
    kind = _kind(item)
    text = F.try_variant_get(item, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(text)).when(kind == "VOID", "None").otherwise(F.coalesce(text, F.to_json(item)))


def _attribute(item: Column, kind: Column, key: str) -> Column:
    """One attribute as text or, for person_count, int, from its variant and that one's kind; the default where it is missing."""
    default = DEFAULTS[key]
    if key == "person_count":
        return F.coalesce(F.try_variant_get(item, "$", "int"), F.lit(0))
    joined = F.array_join(F.transform(F.try_variant_get(item, "$", "array<variant>"), _plain), ", ")
    is_list = F.startswith(kind, F.lit("ARRAY"))
    if key in LISTS:
        return F.when(is_list, joined).when(kind == "STRING", F.try_variant_get(item, "$", "string")).otherwise("")
    pairs = F.map_entries(F.try_variant_get(item, "$", "map<string,variant>"))
    as_dict = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), _plain(e["value"]))), ", ")
    # A JSON null is kept as NULL and overrides the default.
    return F.when(kind.isNull(), F.lit(default)).when(kind == "VOID", F.lit(None)).when(is_list, joined).when(F.startswith(kind, F.lit("OBJECT")), as_dict).otherwise(F.try_variant_get(item, "$", "string"))


def attributes(text) -> Column:
    """struct of the 22 attributes of a caption's JSON, as one expression. Over a table use `with_attributes`, which parses a text once."""
    v = parsed(text)
    members = F.when(is_object(v), F.try_variant_get(v, "$", "map<string,variant>"))
    items = {k: F.try_element_at(members, F.lit(k)) for k in DEFAULTS}
    return F.struct(*[_attribute(item, _kind(item), k).alias(k) for k, item in items.items()])


def with_attributes(df: DataFrame, text: str, out: str = "a") -> DataFrame:
    """df with a struct of the 22 attributes of a caption's JSON, defaults where it is no object.

    Each text is parsed once: the parsed value, its members and their kinds are columns of their own, which the optimizer
    doesn't multiply into the expressions that use them. Write the struct beside the text, and readers prune to the attributes they want.
    """
    row = {k: f"__item_{k}" for k in DEFAULTS}
    kind = {k: f"__kind_{k}" for k in DEFAULTS}
    rows = df.withColumn("__parsed", parsed(text)).withColumn("__members", F.when(is_object(F.col("__parsed")), F.try_variant_get("__parsed", "$", "map<string,variant>")))
    rows = rows.withColumns({row[k]: F.try_element_at("__members", F.lit(k)) for k in DEFAULTS})
    rows = rows.withColumns({kind[k]: _kind(F.col(row[k])) for k in DEFAULTS if k != "person_count"})
    rows = rows.withColumn(out, F.struct(*[_attribute(F.col(row[k]), F.col(kind[k]), k).alias(k) for k in DEFAULTS]))
    return rows.drop("__parsed", "__members", *row.values(), *kind.values())


def embedding_text(a: Column) -> Column:
    """Labelled sentences of an attributes struct, missing and unknown ones left out."""
    get = lambda k: F.nullif(a[k], F.lit(""))
    label = lambda name, k: F.concat(F.lit(f"{name}: "), get(k), F.lit("."))
    tags = F.nullif(F.concat_ws(", ", *[F.when(a[k] != "unknown", get(k)) for k in TAGS]), F.lit(""))
    return F.concat_ws(
        " ", get("caption"), get("people_description"),
        label("Animals", "animals"), label("Vehicles", "vehicles"), label("Food", "food_items"), label("Activities", "activities"), label("Objects", "objects"),
        label("Visible text", "text_in_image"), label("Landmark", "landmark"), label("Festival", "festival_name"),
        F.concat(F.lit("Tags: "), tags, F.lit(".")), label("Colors", "dominant_colors"),
    )


def has_error(text) -> Column:
    """Whether the JSON is an object with a truthy `error`."""
    v = parsed(text)
    error = F.try_variant_get(v, "$.error", "string")
    return F.coalesce(is_object(v) & ~error.isin("", "false", "0", "[]", "{}"), F.lit(False))


def validation(text) -> Column:
    """struct(valid, warning): JSON at all, no error reported, all required keys there."""
    v = parsed(text)
    missing = F.filter(F.array(*[F.when(~_has(v, k), F.lit(k)) for k in REQUIRED]), lambda x: x.isNotNull())
    listed = F.concat(F.lit("["), F.array_join(F.transform(missing, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    warning = (
        F.when(v.isNull(), NOT_JSON)
        .when(_has(v, "error"), F.concat(F.lit("Model returned error: "), F.coalesce(F.try_variant_get(v, "$.error", "string"), F.lit("None"))))
        .when(F.size(missing) > 0, F.concat(F.lit("Missing expected keys: "), listed, F.lit(" — model may be text-only")))
    )
    return F.struct(warning.isNull().alias("valid"), warning.alias("warning"))


def caption_text(caption_json, caption) -> Column:
    """The trimmed caption inside the JSON, else the flat one, else ''."""
    v = parsed(caption_json)
    inner = F.try_variant_get(v, "$.caption", "variant")
    inner = F.when(_kind(inner) == "STRING", F.try_variant_get(inner, "$", "string"))
    return F.coalesce(F.nullif(strip(inner), F.lit("")), F.nullif(strip(caption), F.lit("")), F.lit(""))


def has_caption(caption_json, caption) -> Column:
    """Only JSON with a literally blank caption counts as without one: the JSON is looked into only then."""
    j = col(caption_json)
    v = parsed(j)
    inner = F.try_variant_get(v, "$.caption", "variant")
    text = F.when(_kind(inner) == "STRING", strip(F.try_variant_get(inner, "$", "string")))
    blank = F.contains(j, F.lit('"caption": ""')) | F.contains(j, F.lit('"caption":""'))
    return F.when(j.isNull() | (j == ""), F.coalesce(col(caption) != "", F.lit(False))).when(~blank, True).when(is_object(v) & inner.isNotNull(), F.coalesce(text != "", F.lit(False))).otherwise(True)


def record_history(history, model, text) -> Column:
    """One entry a model, the newest last."""
    own, kind = col(model), "array<struct<model:string,caption_json:string>>"
    old = F.filter(F.coalesce(col(history), F.array().cast(kind)), lambda h: ~h["model"].eqNullSafe(own))
    return F.concat(old, F.array(F.struct(own.alias("model"), col(text).alias("caption_json"))).cast(kind))


def last_of_model(history, model) -> Column:
    """The newest caption of a model, NULL if it has none."""
    own = col(model)
    found = F.filter(col(history), lambda h: h["model"] == own)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["caption_json"])


def to_embed(caption_json, history, model=None) -> Column:
    """struct(value, error): the caption to embed, the latest or a given model's; an error instead of an exception."""
    value = col(caption_json) if model is None else last_of_model(history, model)
    error = F.when(value.isNull() | (value == ""), "no caption").when(has_error(value), "caption reports an error").when(~validation(value)["valid"], validation(value)["warning"])
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def strip_fence(text) -> Column:
    """The inside of a Markdown code fence, without its language tag."""
    t = col(text)
    inner = F.regexp_replace(F.get(F.split(t, "```"), F.lit(1)), "(?i)^\\s*json5?\\s*", "")
    return strip(F.when(F.startswith(t, F.lit("```")), inner).otherwise(t))


def salvage_json(text) -> Column:
    """The text without its fence if that is JSON, else from the first { to the last } if that is; else NULL."""
    t = strip_fence(text)
    found = F.nullif(F.regexp_extract(t, "(?s)\\{.*\\}", 0), F.lit(""))
    return F.when(parsed(t).isNotNull(), t).when(parsed(found).isNotNull(), found)


def attach_transcript(caption, transcript) -> Column:
    """A caption with at most 400 characters of speech behind it; unchanged without any."""
    t = col(transcript)
    snippet = F.when(F.length(t) <= 400, t).otherwise(F.concat(F.substring(t, 1, 400), F.lit("…")))
    spoken = strip(F.concat(F.rtrim(F.coalesce(col(caption), F.lit(""))), F.lit(" Spoken words: "), snippet))
    return F.when(t.isNull() | (t == ""), col(caption)).otherwise(spoken)


def truncated(finish_reason) -> Column:
    # What providers call a reply cut short.
    return F.coalesce(F.lower(col(finish_reason)).isin("length", "max_tokens", "model_length"), F.lit(False))
