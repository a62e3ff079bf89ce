"""Which seconds of a video to look at: uniform and scene plans, refinement, resume and decode choices."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

SEEK_BATCH = 32
FULL_SCAN_FRAMES = 48
FORCED_SEEK_SECONDS, FORCED_SEEK_FRAMES = 1800, 400
REFINE_SIDE = 4
THUMBNAIL_SHARE, THUMBNAIL_WINDOW = 0.12, 2.0
# Extensions of files that hold all of a video.
SELF_CONTAINED = "mp4 mkv avi webm flv wmv mpg mpeg ts m2ts".split()


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def uniform_plan(duration: Column, interval: Column) -> Column:
    """Midpoints of segments of ``interval`` seconds, the last one shortened; [0] for very short or unknown durations."""
    d, i = duration.cast("double"), interval.cast("double")
    segment = lambda k: (k * i + F.least(k * i + i, d)) / 2
    inside = lambda t: F.greatest(F.lit(0.05), F.least(t, F.greatest(F.lit(0.05), d - 0.05)))
    points = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(d / i).cast("int"), F.lit(1)) - 1), lambda k: inside(segment(k.cast("double"))))
    return F.when(~_finite(d) | (d <= 0.5), F.array(F.lit(0.0))).otherwise(points)


def scene_plan(scenes: Column, duration: Column, interval: Column) -> Column:
    """Cuts, at least half a second apart, bound the shots; each shot gives the midpoints of equal parts of at most
    ``interval`` seconds. Without finite cuts the uniform plan."""
    cuts = F.array_sort(F.filter(scenes, _finite))
    d = F.when(_finite(duration) & (duration > 0.5), duration).otherwise(F.element_at(cuts, -1) + 5.0)
    i = interval.cast("double")

    def keep(acc: Column, t: Column) -> Column:
        fits = (t > 0.05) & (t < d - 0.05) & (t - F.element_at(acc, -1) > 0.5)
        return F.when(fits, F.concat(acc, F.array(t))).otherwise(acc)

    edges = F.concat(F.aggregate(cuts, F.array(F.lit(0.0)), keep), F.array(d))
    shots = F.arrays_zip(F.slice(edges, F.lit(1), F.size(edges) - 1).alias("a"), F.slice(edges, F.lit(2), F.size(edges) - 1).alias("b"))

    def midpoints(shot: Column) -> Column:
        length = shot["b"] - shot["a"]
        n = F.greatest(F.lit(1), F.ceil(length / i).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: shot["a"] + (k.cast("double") + 0.5) * length / n)

    return F.when(F.size(cuts) == 0, uniform_plan(duration, interval)).otherwise(F.flatten(F.transform(shots, midpoints)))


def is_full_scan(n_frames: Column, width: Column, height: Column, forced_seek: Column) -> Column:
    """Decode everything rather than seek: large pictures or many frames, unless seeking is forced."""
    large = F.coalesce(width >= 3840, F.lit(False)) | F.coalesce(height >= 2160, F.lit(False))
    return ~forced_seek & (large | (n_frames > FULL_SCAN_FRAMES))


def is_forced_seek(by_scene: Column, duration: Column, n_frames: Column) -> Column:
    return by_scene | F.coalesce(duration > FORCED_SEEK_SECONDS, F.lit(False)) | (n_frames > FORCED_SEEK_FRAMES)


def planned_ms(plan: Column) -> Column:
    return F.transform(plan, lambda t: F.floor(t * 1000 + 0.5).cast("long"))


def resume_index(saved: Column, plan: Column, full_scan: Column) -> Column:
    """How many planned frames are done: all saved ones if they are exactly the plan's first, else none."""
    fits = F.size(saved) <= F.size(plan)
    same = saved == F.slice(planned_ms(plan), F.lit(1), F.size(saved))
    return F.when(~full_scan & fits & same, F.size(saved)).otherwise(0)


def refine_times(duration: Column, n_frames: Column, hit: Column) -> Column:
    """The hit and four seconds on either side, nearest first, within the video and at least 0.05 s apart."""
    known = F.coalesce(duration > 0, F.lit(False))
    gap = F.when(known & (n_frames > 0), duration / n_frames).otherwise(10.0)
    step = F.greatest(F.lit(1.0), F.least(gap / 2, F.lit(15.0))) / REFINE_SIDE
    raw = F.array(hit, *[hit + step * (sign * k) for k in range(1, REFINE_SIDE + 1) for sign in (-1, 1)])
    upper = F.when(known, duration).otherwise(float("inf"))
    usable = F.transform(F.filter(raw, lambda t: _finite(t) & (t < upper)), lambda t: F.greatest(t, F.lit(0.0)))

    def keep(acc: Column, t: Column) -> Column:
        return F.when(F.exists(acc, lambda x: F.abs(x - t) < 0.05), acc).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(usable, F.array().cast("array<double>"), keep)


def thumbnail_window(duration: Column, n_frames: Column, by_scene: Column) -> Column:
    wide = F.greatest(duration / n_frames / 2 + 1, F.lit(THUMBNAIL_WINDOW))
    return F.when(~by_scene & (n_frames > 0) & _finite(duration) & (duration > 0), wide).otherwise(THUMBNAIL_WINDOW)


def effective_mode(override: Column, default: Column) -> Column:
    """A video's own sampling mode before the general one; anything but scene is uniform."""
    return F.when(F.coalesce(override, default) == "scene", "scene").otherwise("uniform")


def scene_cache_key(path: Column, threshold: float, video: Column, tool: Column) -> Column:
    """What cached cuts hold for: rule version, threshold, and path, size and time (ns) of the video and of the decoder.

    ``video`` and ``tool`` are structs of these; null for a file whose parts lie elsewhere (playlists) and for unknown ones.
    """
    alone = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1)).isin(*SELF_CONTAINED)
    bits = struct.unpack("<q", struct.pack("<d", threshold))[0]
    key = F.to_json(F.struct(F.lit(1).alias("version"), F.lit(bits).alias("threshold"), video.alias("video"), tool.alias("tool")))
    return F.when(alone & video.isNotNull() & tool.isNotNull(), key)


def valid_scene_times(cached: Column) -> Column:
    """The cached cuts, or null unless all are finite, not negative and in order; an empty list is valid."""
    times = F.from_json(cached, "array<double>")
    sound = F.forall(times, lambda t: _finite(t) & (t >= 0)) & (F.size(times) == F.coalesce(F.json_array_length(cached), F.lit(-1)))
    ordered = F.forall(F.zip_with(F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0))), lambda a, b: a <= b), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.when(times.isNotNull() & sound & ordered, times)
