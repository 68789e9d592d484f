"""Library and search filters; all push down to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SearchParams

# Accepted upload extensions.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif")
VIDEO_EXTENSIONS = (
    ".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v", ".mpg", ".mpeg", ".ts", ".flv", ".wmv",
)
METADATA_COLUMNS = ("filename", "media_type", "codec", "container")
ACTIVE_JOB = ("queued", "running", "cancelling")
SETTLED_MEDIA = ("ready", "failed", "cancelled")
# Fixed value: what an id may consist of.
ID_PATTERN = r"^[A-Za-z0-9._-]+$"
QUICK_RANGES = {"today": 0, "7d": 7, "30d": 30, "all": None}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def in_videos(ids: tuple[str, ...] | list[str], column: str = "video_id") -> Column:
    """Empty list = no filter."""
    return F.col(column).isin(*ids) if ids else F.lit(True)


def restrict_to(df: DataFrame, allowed: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows whose video is in ``allowed``; for id lists too long to write out."""
    return df.join(allowed.select(key), key, "left_semi")


def date_range(column: str, date_from: str, date_to: str) -> Column:
    """Whole days in UTC; ``''`` leaves a side open. The column itself stays bare so it can prune."""
    conditions = []
    if date_from:
        conditions.append(F.col(column) >= F.lit(date_from).cast("date"))
    if date_to:
        conditions.append(F.col(column) < F.date_add(F.lit(date_to).cast("date"), 1))
    return _all(conditions)


def quick_range(column: str, days: int | None, as_of: str) -> Column:
    if days is None:
        return F.lit(True)
    today = F.lit(as_of).cast("date")
    return (F.col(column) >= F.date_sub(today, days)) & (F.col(column) < F.date_add(today, 1))


def media_type_is(scalar: str = "", several: tuple[str, ...] = (), column: str = "media_type") -> Column:
    conditions = [F.col(column) == scalar] if scalar else []
    if several:
        conditions.append(F.col(column).isin(*several))
    return _all(conditions)


def duration_between(low: float | None, high: float | None, column: str = "duration_seconds") -> Column:
    """A set bound rejects unknown durations."""
    conditions = []
    if low is not None:
        conditions.append(F.col(column) >= low)
    if high is not None:
        conditions.append(F.col(column) <= high)
    return _all(conditions)


def status_is(status: str, column: str = "status") -> Column:
    return F.col(column) == status if status else F.lit(True)


def metadata_match(text: str, columns: tuple[str, ...] = METADATA_COLUMNS) -> Column:
    """Every word of ``text`` is a case-insensitive substring of some column."""
    words = text.lower().split()
    return _all(
        [
            reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(w), F.lit(False)) for c in columns])
            for w in words
        ]
    )


def library_search(text: str, column: str = "filename") -> Column:
    return F.lower(F.col(column)).contains(text.lower()) if text else F.lit(True)


def apply_filters(media: DataFrame, p: SearchParams) -> DataFrame:
    """All library-side conditions of a search request."""
    return media.filter(
        in_videos(p.video_ids)
        & date_range("uploaded_at", p.date_from, p.date_to)
        & media_type_is(p.media_type, p.media_types)
        & duration_between(p.min_duration, p.max_duration)
        & status_is(p.status)
    )


def extension(filename: Column) -> Column:
    """Text from the last dot, lower-cased; without a dot the last character."""
    dotted = F.regexp_extract(filename, r"(?s)(\.[^.]*)$", 1)
    return F.lower(F.when(filename.contains("."), dotted).otherwise(F.right(filename, F.lit(1))))


def media_kind(filename: Column, mime: Column) -> Column:
    """MIME prefix first, then extension, else video."""
    mime = F.coalesce(mime, F.lit(""))
    return (
        F.when(mime.startswith("image/"), "image")
        .when(mime.startswith("video/"), "video")
        .when(extension(filename).isin(*IMAGE_EXTENSIONS), "image")
        .otherwise("video")
    )


def accepted_upload(filename: Column, mime: Column) -> Column:
    mime = F.coalesce(mime, F.lit(""))
    known = extension(filename).isin(*IMAGE_EXTENSIONS, *VIDEO_EXTENSIONS)
    return known | mime.startswith("video/") | mime.startswith("image/")


def access_label(uid: Column, role: Column, status: Column, need: str) -> Column:
    """200 / 401 / 403 for an action that needs ``admin``, ``editor`` or ``searcher``.

    ``uid`` is the user row's key after a left join: null means unknown user.
    """
    allowed = {
        "admin": F.coalesce(role == "ADMIN", F.lit(False)),
        "editor": F.coalesce(role.isin("ADMIN", "VIDEO_EDITOR"), F.lit(False)),
        "searcher": F.lit(True),
    }[need]
    return F.when(uid.isNull(), 401).when(status == "REVOKED", 403).when(allowed, 200).otherwise(403)


def job_active(status: Column) -> Column:
    return status.isin(*ACTIVE_JOB)


def media_active(status: Column) -> Column:
    return ~status.isin(*SETTLED_MEDIA)


def valid_id(value: Column) -> Column:
    return value.rlike(ID_PATTERN)


def path_contained(path: Column) -> Column:
    """Relative, no drive letter, no ``..`` segment, for either slash."""
    absolute = path.rlike(r"^([/\\]|[A-Za-z]:)")
    climbs = path.rlike(r"(^|[/\\])\.\.([/\\]|$)")
    return F.coalesce(~absolute & ~climbs & (path != ""), F.lit(False))
