"""Paths, file kinds and system names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.text import col

# The file kinds of the library, their types, and names of folders that belong to the system.
IMAGES = (".jpg", ".jpeg", ".png", ".heic", ".webp", ".bmp")
VIDEOS = (".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm", ".3gp", ".mts", ".m2ts", ".wmv")
MIME = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".heic": "image/heic", ".heif": "image/heif",
    ".gif": "image/gif", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff",
    ".mp4": "video/mp4", ".m4v": "video/mp4", ".mov": "video/quicktime", ".webm": "video/webm", ".mkv": "video/x-matroska", ".avi": "video/x-msvideo",
    ".3gp": "video/3gpp", ".wmv": "video/x-ms-wmv", ".mts": "video/mp2t", ".m2ts": "video/mp2t",
}
SYSTEM = (
    "$recycle.bin", "system volume information", "$sysreset", "recycler", ".trashes", ".spotlight-v100", ".fseventsd",
    ".documentrevisions-v100", ".temporaryitems", "lost+found", ".trash",
)
SYSTEM_STARTS = (".trash-", "$recycle")


def slashes(path) -> Column:
    """A path without doubled or trailing separators; the root stays."""
    p = F.regexp_replace(F.regexp_replace(col(path), "\\\\", "/"), "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def under(path, folder) -> Column:
    """The folder itself or anything inside it; /a/bc is not under /a/b."""
    p, f = slashes(path), slashes(folder)
    inside = (p == f) | F.startswith(p, F.concat(F.regexp_replace(f, "/$", ""), F.lit("/")))
    return F.coalesce((p != "") & (f != "") & inside, F.lit(False))


def ancestors(path) -> Column:
    """Every folder above a path and the path itself: an equi-join key for `under`."""
    parts = F.split(slashes(path), "/")
    found = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.transform(found, lambda x: F.when(x == "", "/").otherwise(x))


def base_name(path) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def extension(path) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1))


def is_video(media_type, path) -> Column:
    """The tag decides; without one, the extension."""
    tag = F.nullif(col(media_type), F.lit(""))
    return F.coalesce(tag == "video", extension(path).isin(*VIDEOS))


def wanted(ext, media: str) -> Column:
    """media: both, photos or videos."""
    e = F.lower(col(ext))
    return {"photos": e.isin(*IMAGES), "videos": e.isin(*VIDEOS), "both": e.isin(*IMAGES, *VIDEOS)}[media]


def mime_type(path) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("application/octet-stream"))


def is_system_name(name) -> Column:
    n = F.lower(col(name))
    return n.isin(*SYSTEM) | F.startswith(n, F.lit(SYSTEM_STARTS[0])) | F.startswith(n, F.lit(SYSTEM_STARTS[1]))


def backup_label(path) -> Column:
    return F.regexp_replace(col(path), r"[:\\/]+", "_")


def byte_range(header, size) -> Column:
    """struct(start, end) of 'bytes=a-b', 'bytes=a-' or 'bytes=-n', clamped to the file; NULL if it cannot be served."""
    n = col(size).cast("long")
    form = r"(?i)^\s*bytes=\s*(\d*)\s*-\s*(\d*)\s*(?:,.*)?$"
    a, b = (F.try_to_number(F.nullif(F.regexp_extract(col(header), form, i), F.lit("")), F.lit("9" * 18)).cast("long") for i in (1, 2))
    start = F.coalesce(a, F.when(b > 0, F.greatest(n - b, F.lit(0))))
    end = F.when(a.isNull(), n - 1).otherwise(F.least(F.coalesce(b, n - 1), n - 1))
    return F.when(F.coalesce((start <= end) & (start < n), F.lit(False)), F.struct(start.alias("start"), end.alias("end")))
