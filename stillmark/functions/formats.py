"""Display and exchange formats: durations, sizes, bands, versions, dates, data URLs, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit names, labels and thresholds of score bands, log modules by operation prefix.
UNITS = ["B", "KB", "MB", "GB", "TB"]
UNKNOWN_DURATION = "未知"
SCORE_LABELS = [(0.92, "很相似"), (0.84, "较相似"), (0.76, "有些相似")]
LOWEST_LABEL = "相似度较低"
SCORE_COLORS = [(0.84, "text-ok"), (0.76, "text-warn")]
LOWEST_COLOR = "text-muted"
LOG_MODULES = [
    ("^search_", "search"),
    ("^videos_import|^folders_add|^folders_rescan$", "import"),
    ("^videos_reindex", "indexer"),
    ("media_tools|ffmpeg", "media"),
    ("^watcher_|^folders_set_enabled", "watcher"),
]
OTHER_MODULE = "library"
PROBE_STEP, PROBE_ERROR, UNREADABLE, FAILED = "探测媒体", "ffprobe 失败", "FFmpeg 无法读取该文件或其片段", "失败："


def duration(seconds: Column) -> Column:
    """``H:MM:SS`` or ``M:SS`` of the rounded seconds; the unknown label for null, not finite or not above 0."""
    total = F.floor(seconds + 0.5).cast("long")
    h, m, s = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s)))
    unknown = seconds.isNull() | F.isnan(seconds) | (seconds <= 0) | (seconds == float("inf"))
    return F.when(unknown, F.lit(UNKNOWN_DURATION)).otherwise(text)


def file_size(size: Column) -> Column:
    """Units of 1024: whole numbers for bytes and from 100 up, else one decimal; null or not above 0 is ``0 B``."""
    power = sum((F.when(size >= 1024**k, 1).otherwise(0) for k in range(1, len(UNITS))), F.lit(0))
    value = size / F.pow(F.lit(1024.0), power)
    number = F.when((power == 0) | (value >= 100), F.floor(value + 0.5).cast("string")).otherwise(F.format_string("%.1f", value))
    return F.when(size.isNull() | (size <= 0), F.lit("0 B")).otherwise(F.concat_ws(" ", number, F.element_at(F.array(*map(F.lit, UNITS)), power + 1)))


def percent(share: Column) -> Column:
    """A share as whole percent, cut to 0..100."""
    return F.concat(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 100 + 0.5).cast("string"), F.lit("%"))


def _band(score: Column, bands: list[tuple[float, str]], rest: str) -> Column:
    out = F
    for least, name in bands:
        out = out.when(score >= least, name)
    return out.otherwise(rest)


def score_label(score: Column) -> Column:
    return _band(score, SCORE_LABELS, LOWEST_LABEL)


def score_color(score: Column) -> Column:
    return _band(score, SCORE_COLORS, LOWEST_COLOR)


def version_parts(version: Column) -> Column:
    """Leading digits of each dotted part after an optional v; a part without digits is 0."""
    return F.transform(F.split(F.regexp_replace(F.trim(version), "^[vV]", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("long"), F.lit(0).cast("long")))


def is_newer(latest: Column, current: Column) -> Column:
    """Part by part, missing parts count as 0; the first difference decides."""
    pairs = F.zip_with(version_parts(latest), version_parts(current), lambda a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))
    return F.coalesce(F.try_element_at(F.filter(pairs, lambda d: d != 0), F.lit(1)) > 0, F.lit(False))


def file_stamp(ms: Column) -> Column:
    """UTC ``YYYYMMDDTHHMMSSZ`` (the session's zone must be UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyyMMdd'T'HHmmss'Z'")


def data_url(data: Column, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(data), r"\s", ""))


def decode_data_url(url: Column) -> Column:
    """The bytes of a base64 data URL; null if the part before the first comma doesn't say base64, or nothing follows."""
    head, comma = F.substring_index(url, ",", 1), F.instr(url, ",")
    body = F.substring(url, comma + 1, F.length(url))
    return F.when((comma > 0) & F.contains(head, F.lit("base64")), F.try_to_binary(body, F.lit("base64")))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]", " ")


def failure_message(step: Column, error: Column) -> Column:
    """What an import failure says; an unreadable file has words of its own."""
    return F.when((step == PROBE_STEP) & F.startswith(error, F.lit(PROBE_ERROR)), F.lit(UNREADABLE)).otherwise(F.concat(step, F.lit(FAILED), error))


def event_json(kind: Column, **payload: Column) -> Column:
    """A tagged event as one line of JSON; fields that are null are left out."""
    return F.to_json(F.struct(kind.alias("type"), *[c.alias(k) for k, c in payload.items()]))


def guarded(json: Column, schema: str) -> Column:
    """JSON by a schema; null unless it is an object of that shape with finite numbers."""
    fields = T.StructType.fromDDL(schema).fields
    parsed = F.from_json(json, schema, {"mode": "PERMISSIVE"})
    sound = F.startswith(F.trim(json), F.lit("{")) & F.try_parse_json(json).isNotNull()
    for f in fields:
        value = parsed[f.name]
        if f.dataType in (T.DoubleType(), T.FloatType()):
            sound = sound & (value.isNull() | (~F.isnan(value) & (F.abs(value) < float("inf"))))
        if not f.nullable:
            sound = sound & value.isNotNull()
    return F.when(sound, parsed)


def log_line(ts: Column, level: Column, module: Column, event: Column, details: Column) -> Column:
    head = F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS xxx"), F.lit("] ["), F.upper(level), F.lit("] ["), module, F.lit("] "), one_line(event))
    return F.when(F.coalesce(details, F.lit("")) == "", head).otherwise(F.concat(head, F.lit(" | "), one_line(details)))


def module_of(operation: Column) -> Column:
    """The log module of a command: the first rule that its name meets."""
    out = F
    for pattern, module in LOG_MODULES:
        out = out.when(operation.rlike(pattern), module)
    return out.otherwise(OTHER_MODULE)


def progress_frames(line: Column) -> Column:
    """The frame counter of a decoder's progress line; null for other lines."""
    return F.regexp_extract(line, r"^frame=\s*(\d+)\s*$", 1).try_cast("long")
