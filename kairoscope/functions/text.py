"""Display and export text as column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
# Fixed value: the rule of an evidence block.
RULE = "-" * 40
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


INFINITY = float("inf")


def _finite(x: Column) -> Column:
    """False for null, NaN (which sorts above infinity) and the infinities."""
    d = x.cast("double")
    return F.coalesce((d > -INFINITY) & (d < INFINITY), F.lit(False))


def js_round(x: Column) -> Column:
    """Round half up, as a long."""
    return F.floor(x.cast("double") + 0.5).cast("long")


def to_fixed(x: Column, digits: int) -> Column:
    """Fixed-point text through integer parts: floor(|x| * 10^n + 0.5)."""
    d = x.cast("double")
    sign = F.when(d < 0, "-").otherwise("")
    scaled = F.floor(F.abs(d) * float(10**digits) + 0.5).cast("long")
    if digits == 0:
        return F.concat(sign, scaled.cast("string"))
    unit = F.lit(10**digits).cast("long")
    whole = F.floor(scaled / unit)
    return F.concat(
        sign,
        whole.cast("long").cast("string"),
        F.lit("."),
        F.lpad((scaled % unit).cast("string"), digits, "0"),
    )


def js_number(x: Column) -> Column:
    """A double as a script engine prints it: shortest digits, no trailing ``.0``."""
    d = x.cast("double")
    short = d.cast("string")
    size = F.abs(d)
    digits = F.when(size < 1, short.try_cast("decimal(38,23)").cast("string")).otherwise(
        short.try_cast("decimal(38,17)").cast("string")
    )
    plain = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_extract(short, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(short, r"E(-?\d+)$", 1)
    scientific = F.concat(
        mantissa, F.when(exponent.startswith("-"), F.lit("e")).otherwise(F.lit("e+")), exponent
    )
    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(d), "NaN")
        .when(size == float("inf"), F.when(d > 0, "Infinity").otherwise("-Infinity"))
        .when(d == 0, "0")
        .when((size < 1e-6) | (size >= 1e21), scientific)
        .otherwise(plain)
    )


def _bytes_or_null(n: Column) -> Column:
    # Kept free of nested conditions: shared parts are then computed once and the
    # generated code stays small enough to be compiled for several columns at once.
    n = n.cast("double")
    d = F.when((n > 0) & (n < INFINITY), n)
    power = sum(((d >= float(1024**i)).cast("int") for i in range(1, len(BYTE_UNITS))), F.lit(1))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), power)
    steps = pick([1, 100, 100, 100, 100]).cast("long")
    scaled = F.floor(d / pick([float(1024**i) for i in range(len(BYTE_UNITS))]) * steps + 0.5).cast("long")
    decimals = F.substr(F.concat(F.lit("."), F.lpad((scaled % steps).cast("string"), 2, "0")), F.lit(1), pick([0, 3, 3, 3, 3]))
    whole = F.floor(scaled / steps).cast("string")
    return F.concat(whole, decimals, F.lit(" "), pick(BYTE_UNITS))


def format_bytes(n: Column) -> Column:
    return F.coalesce(_bytes_or_null(n), F.lit("0 B"))


def format_speed(bytes_per_second: Column) -> Column:
    return F.coalesce(F.concat(_bytes_or_null(bytes_per_second), F.lit("/s")), F.lit(DASH))


def _two_digits(n: Column) -> Column:
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(2)), F.lit("0"))


def format_hms(seconds: Column) -> Column:
    """``MM:SS``, or ``HH:MM:SS`` from one hour on."""
    total = F.when(_finite(seconds), F.greatest(F.lit(0).cast("long"), js_round(seconds)))
    hours = F.floor(total / 3600).cast("long")
    minutes, rest = (_two_digits(F.floor(part).cast("long")) for part in (total % 3600 / 60, total % 60))
    head = F.when(hours > 0, F.concat(_two_digits(hours), F.lit(":"))).otherwise("")
    return F.coalesce(F.concat(head, minutes, F.lit(":"), rest), F.lit(DASH))


def _minutes(d: Column) -> Column:
    return F.floor(d / 60).cast("long")


def _ceil_text(d: Column) -> Column:
    return F.ceil(d).cast("long").cast("string")


def format_eta(seconds: Column) -> Column:
    """Remaining time; the seconds part may read 60, as in the client."""
    n = seconds.cast("double")
    d = F.when((n >= 0) & (n < INFINITY), n)
    kind = (d >= 60).cast("int") + (d >= 3600).cast("int") + 1
    pick = lambda *values: F.element_at(F.array(*values), kind)
    m, up = _minutes(d), lambda x: F.ceil(x).cast("long")
    lead = pick(up(d), m, _minutes(m)).cast("string")
    tail = pick(F.lit(0).cast("long"), up(d % 60), m % 60).cast("string")
    long_text = F.when(kind > 1, F.concat(tail, pick(F.lit(""), F.lit("s"), F.lit("m")))).otherwise("")
    return F.coalesce(F.concat(lead, pick(F.lit(" sec"), F.lit("m "), F.lit("h ")), long_text), F.lit(DASH))


def job_eta_text(remaining: Column) -> Column:
    """The job list's variant: ``Xm Ys`` or ``Ys``, null when unknown."""
    m = _minutes(remaining)
    tail = F.concat(_ceil_text(remaining % 60), F.lit("s"))
    return F.when(m > 0, F.concat(m.cast("string"), F.lit("m "), tail)).otherwise(tail)


def format_percent(value: Column) -> Column:
    return F.concat(js_round(value).cast("string"), F.lit("%"))


def match_percent(similarity: Column) -> Column:
    return F.concat(to_fixed(similarity * 100, 1), F.lit("% match"))


def title_case(s: Column) -> Column:
    """Upper-case the first ASCII letter of each word; leave the rest alone."""
    pieces = F.split(F.replace(s, F.lit("_"), F.lit(" ")), r"(?<=\W)(?=\w)")
    head = lambda p: F.substring(p, 1, 1)
    lifted = F.transform(
        pieces,
        lambda p: F.when(
            head(p).rlike("^[a-z]"), F.concat(F.upper(head(p)), F.substr(p, F.lit(2)))
        ).otherwise(p),
    )
    return F.array_join(lifted, "")


def to_iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def days_ago(as_of: Column, days: int) -> Column:
    return F.date_format(F.date_sub(as_of.cast("date"), days), "yyyy-MM-dd")


def _display(iso: Column, pattern: str) -> Column:
    shown = F.date_format(F.try_to_timestamp(iso), pattern)
    return F.when(iso.isNull() | (iso == ""), DASH).otherwise(F.coalesce(shown, iso))


def format_date(iso: Column) -> Column:
    return _display(iso, "MMM d, yyyy")


def format_date_time(iso: Column) -> Column:
    return _display(iso, "MMM d, yyyy, hh:mm a")


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def safe_file_name(base: Column) -> Column:
    cleaned = F.substring(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), 1, 80)
    return F.when(cleaned == "", "export").otherwise(cleaned)


def csv_escape(v: Column) -> Column:
    text = F.coalesce(v.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def _lines(*lines: Column) -> Column:
    """Join lines, leaving out the null ones (empty lines stay)."""
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _segment(r: dict[str, Column]) -> Column:
    start = F.coalesce(r["context_start_hms"], to_fixed(r["context_start"], 2))
    end = F.coalesce(r["context_end_hms"], to_fixed(r["context_end"], 2))
    both = r["context_start"].isNotNull() & r["context_end"].isNotNull()
    return F.when(both, F.concat(F.lit("Segment: "), start, F.lit(" - "), end))


def _row(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


_RESULT_COLUMNS = (
    "query", "video_name", "media_type", "timestamp_hms", "context_start", "context_end",
    "context_start_hms", "context_end_hms", "similarity", "retrieval_stage", "context_reason",
    "context_frames", "context_summary", "context_text",
)


def _label(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _present(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def context_text() -> Column:
    """Evidence block over the columns of a search result."""
    r = _row(*_RESULT_COLUMNS)
    has_frames = F.size(r["context_frames"]) > 0
    frame_lines = F.array_join(
        F.transform(r["context_frames"], lambda f: F.concat(F.lit("  "), f["timestamp_hms"])), "\n"
    )
    summary = _lines(F.lit(""), F.lit(RULE), F.lit("AI SUMMARY"), F.lit(""), r["context_summary"], F.lit(RULE))
    return _lines(
        F.lit(RULE),
        F.lit("RETRIEVED EVIDENCE"),
        F.lit(""),
        _label("Media", r["video_name"]),
        F.lit(""),
        F.concat(F.lit('Query: "'), r["query"], F.lit('"')),
        _label("Match", r["timestamp_hms"]),
        _segment(r),
        _label("Relevance", to_fixed(r["similarity"], 2)),
        F.when(has_frames, F.concat(F.lit("Representative frames:\n"), frame_lines)),
        F.when(_present(r["context_reason"]), _label("Reason", r["context_reason"])),
        _label("Source", r["video_name"]),
        F.lit(RULE),
        F.when(_present(r["context_summary"]), summary),
    )


def result_plain_text() -> Column:
    r = _row(*_RESULT_COLUMNS)
    shown = F.array_join(F.transform(r["context_frames"], lambda f: f["timestamp_hms"]), ", ")
    return _lines(
        _label("Query", r["query"]),
        _label("Media", r["video_name"]),
        _label("Type", r["media_type"]),
        _label("Timestamp", r["timestamp_hms"]),
        _segment(r),
        _label("Relevance", to_fixed(r["similarity"], 2)),
        _label("Retrieval Stage", r["retrieval_stage"]),
        F.when(_present(r["context_reason"]), _label("Reason", r["context_reason"])),
        F.when(F.size(r["context_frames"]) > 0, _label("Representative frames", shown)),
        F.lit(""),
        F.lit("Context:"),
        F.coalesce(r["context_text"], context_text()),
    )


def saved_context_text() -> Column:
    """Saved-context block over ``saved_contexts`` columns; blank lines are dropped."""
    start, end = to_fixed(F.col("context_start"), 2), to_fixed(F.col("context_end"), 2)
    return _lines(
        F.lit(RULE),
        _label("Media", F.col("filename")),
        F.concat(F.lit('Query: "'), F.col("query"), F.lit('"')),
        _label("Match", F.col("timestamp_hms")),
        F.concat(F.lit("Segment: "), start, F.lit(" - "), end),
        _label("Relevance", to_fixed(F.col("score"), 2)),
        F.lit(RULE),
    )


def reason_text(frame_id: Column, raw_cosine: Column, n_frames: Column) -> Column:
    """Grounded reason: only measured fields, nothing generated."""
    return F.concat(
        F.lit("Matched frame "), frame_id,
        F.lit(" with raw cosine "), to_fixed(raw_cosine, 4),
        F.lit("; "), n_frames.cast("string"), F.lit(" context frame(s) in the segment."),
    )


def _json_text(value: Column) -> Column:
    """A quoted JSON string, or null."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _json_number(value: Column) -> Column:
    """JSON has no NaN and no infinities: they become null, as in a script engine."""
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.coalesce(F.when(finite, js_number(value)), F.lit("null"))


def _json_object(**members: Column) -> Column:
    parts = []
    for n, (name, value) in enumerate(members.items()):
        parts += [F.lit(("{" if n == 0 else ",") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def result_json() -> Column:
    """The 12-key export object, keys in fixed order, nulls kept, numbers as a script prints them."""
    frames = F.transform(
        F.col("context_frames"),
        lambda f: _json_object(
            frame_id=_json_text(f["frame_id"]), timestamp=_json_number(f["timestamp"]),
            timestamp_hms=_json_text(f["timestamp_hms"]), frame_url=_json_text(f["frame_url"]),
        ),
    )
    return _json_object(
        query=_json_text(F.col("query")),
        media=_json_text(F.col("video_name")),
        media_type=_json_text(F.col("media_type")),
        timestamp=_json_number(F.col("timestamp")),
        start=_json_number(F.col("context_start")),
        end=_json_number(F.col("context_end")),
        score=_json_number(F.col("similarity")),
        frame_id=_json_text(F.col("frame_id")),
        retrieval_stage=_json_text(F.col("retrieval_stage")),
        context_frames=F.coalesce(F.concat(F.lit("["), F.array_join(frames, ","), F.lit("]")), F.lit("null")),
        reason=_json_text(F.col("context_reason")),
        context=_json_text(F.coalesce(F.col("context_text"), context_text())),
    )


# Fixed value: the header of an export.
CSV_HEADER = "query,media,media_type,timestamp,start,end,score,reason"


def result_csv() -> Column:
    cells = [
        F.col("query"), F.col("video_name"), F.col("media_type"), js_number(F.col("timestamp")),
        js_number(F.col("context_start")), js_number(F.col("context_end")),
        js_number(F.col("similarity")), F.col("context_reason"),
    ]
    return F.concat_ws(",", *[csv_escape(c) for c in cells])
