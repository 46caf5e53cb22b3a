"""Search: an access path by what was asked for, then filter, nearest rows, people."""

from __future__ import annotations

from collections.abc import Callable

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.paths import base_name
from lumenframe.functions.text import all_of
from lumenframe.functions.vectors import top_k

BROWSE_LIMIT = 10_000
DEFAULT_TEXT = "photo"


@dataclass
class Request:
    text: str = ""
    filters: dict = field(default_factory=dict)
    person: str | None = None
    top_k: int = 200
    person_prefilter: bool = False


#: Values of a filter that ask for nothing: blanks, and the menu's entry for all.
UNFILTERED = (None, "", 0, False, "All")
#: Attributes stored as something else than text: a pattern of acceptable values, and their type.
TYPED = {"person_count": (re.compile(r"\s*[+-]?\d+\s*"), int)}


def compile_filters(filters: dict) -> dict:
    """The filters that restrict anything, in their attributes' types; a value that its type cannot hold restricts nothing."""
    asked = {k: v for k, v in filters.items() if not any(v is u or v == u for u in UNFILTERED) and v not in ([], {}, ())}
    fits = {k for k, v in asked.items() if k not in TYPED or isinstance(v, int | float) or isinstance(v, str) and TYPED[k][0].fullmatch(v)}
    return {k: TYPED[k][1](v) if k in TYPED else v for k, v in asked.items() if k in fits}


def filtered(vectors: DataFrame, filters: dict) -> tuple[DataFrame, bool]:
    """(rows that equal every filter, whether the filters were malformed: then all rows)."""
    wanted = compile_filters(filters)
    if any(name not in vectors.columns or isinstance(v, (dict, list, set)) for name, v in wanted.items()):
        return vectors, True
    return vectors.where(all_of(F.col(n) == F.lit(v) for n, v in wanted.items())), False


def search(vectors: DataFrame, request: Request, embed, people: dict[str, DataFrame], key: str = "id", metric: str = "l2") -> tuple[DataFrame, dict]:
    """(result rows, flags). embed(text) gives a vector in the rows' space; people maps names to DataFrames of their ids.

    A person alone: all their rows. Filters without text: every match up to 10 000. Otherwise the nearest rows of the
    filtered ones; the person then narrows the result, so it can be shorter than top_k, or narrows the rows before with
    person_prefilter.
    """
    if not 1 <= request.top_k <= 500:
        raise ValueError("top_k must be from 1 to 500")
    flags: dict = {}
    person = request.person or None
    ids = None
    if person is not None:
        ids = people.get(person)
        if ids is None:
            flags["person_not_found"] = True
            return vectors.limit(0), flags
        ids = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    text, wanted = request.text.strip(), compile_filters(request.filters)
    if ids is not None and not text and not wanted:
        return vectors.join(ids, key, "left_semi"), flags
    rows, bad = filtered(vectors, request.filters)
    if bad:
        flags["filter_error"] = True
    if wanted and not text:
        out = rows.orderBy(key).limit(BROWSE_LIMIT)
    else:
        if ids is not None and request.person_prefilter:
            rows = rows.join(ids, key, "left_semi")
        out = top_k(rows, embed(text or DEFAULT_TEXT), request.top_k, key, metric=metric)
    return (out if ids is None else out.join(ids, key, "left_semi")), flags


def similar(vectors: DataFrame, uid, embedding: list[float], k: int, key: str = "id", metric: str = "l2") -> DataFrame:
    """The k rows nearest to a stored one, without itself."""
    return top_k(vectors.where(F.col(key) != F.lit(uid)), embedding, k, key, metric=metric)


def result_cards(rows: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """The eight columns of a result card; `exists` is false for ids in missing(id)."""
    if missing is not None:
        rows = rows.join(missing.select("id", F.lit(True).alias("__gone")), "id", "left")
        exists = F.col("__gone").isNull()
    else:
        exists = F.lit(True)
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return rows.select("id", has("path").alias("path"), F.coalesce(F.nullif(has("filename"), F.lit("")), base_name(has("path").cast("string"))).alias("filename"), *[has(c).alias(c) for c in ("caption", "scene", "media_type", "duration_s")], exists.alias("exists"))


def active_space(registry: list[dict], embedders: dict[str, Callable[[str], list[float]]], vectors: DataFrame, model: str = "embedding_model") -> tuple[DataFrame, Callable[[str], list[float]]]:
    """The rows of the registry's active model, and how to embed a query in that model's space: vectors of different models
    share no space, so a query must not meet them, even where dimensions agree. No active model, no embedder for it, or an answer of another dimension is an error."""
    active = next((r for r in registry if r["is_active"]), None)
    if active is None or active["model"] not in embedders:
        raise LookupError("no embedder for the active model" if active else "no active model")

    def embed(text: str) -> list[float]:
        found = list(embedders[active["model"]](text))
        if len(found) != active["dimension"]:
            raise ValueError(f"{active['model']} has {active['dimension']} dimensions, not {len(found)}")
        return found

    return vectors.where(F.col(model) == active["model"]), embed
