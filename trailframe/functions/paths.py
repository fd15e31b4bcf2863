"""Path texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes per kind of media, lower case.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".jpe", ".tif", ".tiff", ".pgm", ".pnm", ".36p"]
VIDEO_SUFFIXES = [
    ".mp4", ".avi", ".tavi", ".dv", ".m2t", ".m2ts", ".m4v", ".mqv", ".mts", ".ts", ".mov", ".qt", ".mkv", ".360",
]
ARCHIVE_SUFFIXES = [".zip"]
XML_SUFFIXES = [".xml"]

# File types whose telemetry is read natively; "video" covers them all.
NATIVE_VIDEO_TYPES = ["blackvue", "camm", "gopro"]

_SUFFIX = r"[^/](\.[^./]+)$"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, _SUFFIX, 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", "")


def media_kind(path: Column) -> Column:
    """``image``, ``video``, ``zip`` or ``xml`` by suffix, else null."""
    ext = F.lower(suffix(path))
    return (
        F.when(ext.isin(IMAGE_SUFFIXES), "image")
        .when(ext.isin(VIDEO_SUFFIXES), "video")
        .when(ext.isin(ARCHIVE_SUFFIXES), "zip")
        .when(ext.isin(XML_SUFFIXES), "xml")
    )


def resolve(path: Column) -> Column:
    """Absolute path with ``.`` and ``..`` steps worked out."""

    def walk(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), walk)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def sidecar(path: Column, pattern: str | None = None, fixed: str | None = None) -> Column:
    """Where a file's companion is: a fixed path, or a pattern.

    ``%f`` is the file name, ``%g`` the name without suffix, ``%e`` the suffix;
    a relative pattern starts at the file's folder.
    """
    if fixed is not None:
        return F.lit(fixed)
    name = basename(path)
    filled = F.lit(pattern)
    for mark, value in (("%f", name), ("%g", stem(name)), ("%e", suffix(name))):
        filled = F.replace(filled, F.lit(mark), value)
    placed = filled if pattern.startswith("/") else F.concat(parent(path), F.lit("/"), filled)
    return resolve(placed)


def combine_filters(a: Column, b: Column) -> Column:
    """Common file types of two filters; null means no filter."""
    native = F.array(*[F.lit(t) for t in NATIVE_VIDEO_TYPES])
    widen = lambda f: F.when(F.array_contains(f, "video"), F.array_union(f, native)).otherwise(f)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_sort(F.array_intersect(widen(a), widen(b))))


def passes_filter(kind: Column, allowed: Column) -> Column:
    """Whether a source restricted to ``allowed`` types takes an image or video file."""
    videos = F.array(*[F.lit(t) for t in ["video", *NATIVE_VIDEO_TYPES]])
    wanted = F.when(kind == "image", F.array_contains(allowed, "image")).when(
        kind == "video", F.arrays_overlap(allowed, videos)
    )
    return F.when(kind.isin("image", "video"), F.coalesce(wanted, F.lit(True))).otherwise(F.lit(False))
