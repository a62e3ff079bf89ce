"""Media folders, playlists, probes and frames. Programs that decode are given as functions; they run on executors."""

from __future__ import annotations

import functools
import itertools
import os
import pathlib
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import fingerprint, paths
from ..operators.shared import saved

# Extensions, names and directories that a scan treats specially.
VIDEO_EXTENSIONS = "mp4 mkv avi mov wmv flv webm m4v mpg mpeg ts m2ts rmvb rm 3gp vob ogv m3u8".split()
IMAGE_EXTENSIONS = "jpg jpeg png webp bmp gif avif".split()
NON_VIDEO_EXTENSIONS = (
    "txt md log nfo pdf doc docx xls xlsx ppt pptx jpg jpeg png gif bmp webp avif svg ico heic mp3 wav flac aac ogg opus wma m4a cue "
    "srt ass ssa vtt sub idx lrc zip rar 7z tar gz bz2 xz iso exe dll msi app deb rpm so dylib json xml yaml yml toml ini cfg conf csv "
    "db sqlite sqlite3 db-wal db-shm bak tmp part html htm css js jsx tsx py rs java c cpp h url lnk desktop"
).split()
PLAIN_NAMES = ["readme", "license", "makefile", "changelog"]
SKIPPED_DIRECTORIES = ["$recycle.bin", "system volume information", "node_modules", ".git", "windows", "program files", "program files (x86)", "programdata", "appdata"]
MAX_DEPTH = 24
PROBE = "streams array<struct<duration:string,width:long,height:long,codec_name:string>>, format struct<duration:string>"


def is_candidate(name: Column) -> Column:
    """Could this file be a video? Known extensions and none are, unless the name says otherwise; unknown ones are probed."""
    base = paths.file_name(name)
    ext = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    never = F.coalesce(base, F.lit("")).isin("") | F.startswith(base, F.lit(".")) | F.lower(base).isin(*PLAIN_NAMES)
    return ~never & (~F.contains(base, F.lit(".")) | ext.isin(*VIDEO_EXTENSIONS) | ~ext.isin(*NON_VIDEO_EXTENSIONS))


def has_extension(path: Column, extensions: list[str]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin(*extensions)


LISTED = "path string, name string, is_dir boolean, size long, mtime_ms long, text string"
PLAYLIST_BYTES, LISTED_TOGETHER = 2 << 20, 5000


def _entries(folder: str):
    """(path, name, is_dir, size, mtime_ms, playlist text) of a directory. Links are passed over, and so is what goes while
    it is looked at; a directory that can't be listed is an error, a playlist that can't be read has no text."""
    import pyarrow.fs as pafs

    def text(name, size, read):
        if not name.lower().endswith(".m3u8") or size > PLAYLIST_BYTES:
            return None
        try:
            return read().decode()
        except (OSError, UnicodeDecodeError):
            return None

    plain = lambda x: x.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    if "://" in folder:
        fs, inside = pafs.FileSystem.from_uri(folder)
        scheme = folder[: folder.index("://") + 3]
        host = folder[len(scheme) :].split("/", 1)[0] if scheme[:-3] in ("hdfs", "viewfs") else ""
        for e in fs.get_file_info(pafs.FileSelector(inside)):
            is_dir, size = e.type == pafs.FileType.Directory, e.size or 0
            read = lambda e=e: fs.open_input_stream(e.path).read()
            yield scheme + host + e.path, e.base_name, is_dir, size, (e.mtime_ns or 0) // 1_000_000, text(e.base_name, size, read)
        return
    with os.scandir(folder) as found:
        for e in found:
            try:
                if e.is_symlink() or not (e.is_dir() or e.is_file()):
                    continue
                stat = e.stat()
            except FileNotFoundError:
                continue
            read = lambda e=e: pathlib.Path(e.path).read_bytes()
            yield plain(e.path), plain(e.name), e.is_dir(), stat.st_size, stat.st_mtime_ns // 1_000_000, None if e.is_dir() else text(e.name, stat.st_size, read)


def _listing(batches):
    arrow = pa.schema([("path", pa.string()), ("name", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("mtime_ms", pa.int64()), ("text", pa.string())])
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows = _entries(folder)
            while some := list(itertools.islice(rows, LISTED_TOGETHER)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), arrow)], schema=arrow)


def scan_folder(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, size, mtime_ms of the candidate files below ``root``, a folder that all executors see; else it is an error.

    Directories are listed by tasks, level by level, so the driver holds none of them; no contents but those of playlists are
    read. Links, levels below 24 and some system directories are left out, and so are files that a playlist of the same
    scan names; a playlist that isn't UTF-8 names none.
    """
    root = re.sub(r"^file:/*", "/", root)
    root = root.rstrip("/") or "/"
    if not _is_folder(root):
        raise NotADirectoryError(f"no directory, or not readable: {root}")
    level = spark.createDataFrame([(root,)], "path string")
    levels = []
    for _ in range(MAX_DEPTH + 1 if recursive else 1):
        levels.append(saved(level.repartition("path").mapInArrow(_listing, LISTED), "scan-level"))
        level = levels[-1].where(F.col("is_dir") & ~F.lower("name").isin(*SKIPPED_DIRECTORIES)).select("path")
        if level.isEmpty():
            break
    files = functools.reduce(DataFrame.unionByName, levels).where(~F.col("is_dir"))
    found = files.where(is_candidate(F.col("path"))).select("path", "size", "mtime_ms")
    return without_playlist_parts(found, playlist_parts(files.where(F.col("text").isNotNull()).select("path", "text")))


def _is_folder(path: str) -> bool:
    import pyarrow.fs as pafs

    if "://" not in path:
        return os.path.isdir(path)
    fs, inside = pafs.FileSystem.from_uri(path)
    return fs.get_file_info(inside).type == pafs.FileType.Directory


def playlist_parts(lists: DataFrame) -> DataFrame:
    """part (full path) of every relative file that a playlist (path, text) names; other texts name none."""
    line = F.explode(F.split("text", r"\r?\n")).alias("line")
    rows = lists.where(F.startswith("text", F.lit("#EXTM3U"))).select(paths.dir_name(F.col("path")).alias("folder"), line).withColumn("line", F.trim("line"))
    named = F.when(F.startswith("line", F.lit("#")), F.regexp_extract("line", r'URI="([^"]*)"', 1)).otherwise(F.col("line"))
    outside = (F.col("named") == "") | F.contains("named", F.lit("://")) | F.startswith("named", F.lit("data:")) | F.col("named").rlike(r"^[\\/]")
    joined = paths.fold_dots(F.concat("folder", F.lit("/"), "named"))
    return rows.withColumn("named", named).where(~outside).select(joined.alias("part")).distinct()


def without_playlist_parts(found: DataFrame, parts: DataFrame) -> DataFrame:
    return found.join(parts, F.col("path") == F.col("part"), "left_anti")


def parse_probe(json: Column) -> Column:
    """duration, width, height, video_codec from a probe's JSON, and ``error`` if there is no picture or no duration.

    The stream's duration counts before the file's; both must be finite and above 0.
    """
    parsed = F.from_json(json, PROBE)
    stream = F.try_element_at(parsed["streams"], F.lit(1))

    def seconds(c: Column) -> Column:
        d = c.try_cast("double")
        return F.when(~F.isnan(d) & (d > 0) & (d < float("inf")), d)

    duration = F.coalesce(seconds(stream["duration"]), seconds(parsed["format"]["duration"]))
    picture = (F.coalesce(stream["width"], F.lit(0)) > 0) & (F.coalesce(stream["height"], F.lit(0)) > 0)
    error = F.when(parsed.isNull(), "unreadable").when(stream.isNull(), "no picture").when(~picture | duration.isNull(), "no size or duration")
    return F.struct(F.when(error.isNull(), duration).alias("duration"), F.when(error.isNull(), stream["width"]).alias("width"), F.when(error.isNull(), stream["height"]).alias("height"), F.when(error.isNull(), stream["codec_name"]).alias("video_codec"), error.alias("error"))


def probe(files: DataFrame, run: Callable[[str], str]) -> DataFrame:
    """files (path) with ``info`` from ``run(path)``, which gives a probe's JSON on the executors."""

    @F.pandas_udf("string")
    def output(path):
        return path.map(run)

    return files.withColumn("info", parse_probe(output("path")))


def parse_times(log: Column) -> Column:
    """All finite pts_time values of a decoder's log, in order of appearance."""
    values = F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:\s*([-+0-9.eE]+|nan|inf)"), 1), lambda t: t.try_cast("double"))
    return F.filter(values, lambda t: t.isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf")))


def parse_scenes(log: Column) -> Column:
    return F.array_sort(parse_times(log))


def parse_size(log: Column) -> Column:
    """width and height of the last ``s:WxH``; null if there is none."""
    found = F.try_element_at(F.regexp_extract_all(log, F.lit(r"\bs:(\d+x\d+)"), 1), F.lit(-1))
    return F.when(found.isNotNull(), F.struct(F.substring_index(found, "x", 1).cast("long").alias("width"), F.substring_index(found, "x", -1).cast("long").alias("height")))


def images(spark: SparkSession, path: str, decode: Callable[[bytes], object] | None = None) -> DataFrame:
    """path and ``image`` struct (as Spark's image source has it) of the pictures that can be decoded; others give no row.

    Without ``decode`` these are the kinds that Spark reads. ``decode(content)`` gives an RGB array, or None, on the executors:
    for webp, avif and whatever else a library there knows.
    """
    if decode is None:
        return spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("path"), "image")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(has_extension(F.col("path"), IMAGE_EXTENSIONS)).select("path", "content")
    schema = "path string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rgb = decode(content)
                except Exception:  # a broken picture is left out, as Spark's own source does
                    rgb = None
                if rgb is not None:
                    image = {"origin": name, "height": rgb.shape[0], "width": rgb.shape[1], "nChannels": 3, "mode": 16, "data": rgb[:, :, ::-1].tobytes()}
                    yield pa.RecordBatch.from_pylist([{"path": name, "image": image}], schema=arrow)

    return files.mapInArrow(run, schema)


def decode_frames(plan: DataFrame, decode: Callable[[str, list[float], bool], Iterable[tuple[float, object]]]) -> DataFrame:
    """plan (video_id, path, seconds array, full_scan) to fingerprinted frames.

    ``decode(path, seconds, full_scan)`` yields (time, RGB array). When seeking, a frame's time is the planned one. A
    decoder that gives another number of frames than planned fails the task, so no half video is committed.
    """
    schema = f"video_id long, frame_index long, time_ms long, {fingerprint.SIGNATURE}"

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for i, (time, pixels) in enumerate(decode(row["path"], row["seconds"], row["full_scan"])):
                    t = time if row["full_scan"] else row["seconds"][i]
                    out.append({"video_id": row["video_id"], "frame_index": i, "time_ms": int(t * 1000 + 0.5), **fingerprint.signature(pixels)})
                if not row["full_scan"] and len(out) != len(row["seconds"]):
                    raise ValueError(f"{row['path']}: {len(out)} of {len(row['seconds'])} frames")
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return plan.select("video_id", "path", "seconds", "full_scan").mapInArrow(run, schema)


def decode_batches(plan: DataFrame, decode: Callable[[str, list[float], bool], Iterable[tuple[float, object]]]) -> DataFrame:
    """plan (video_id, path, seconds, full_scan, first) to the fingerprinted frames of each row, numbered from ``first``.

    A row is a batch of seeks, or a whole video if it is scanned: all its frames come, or one row with ``error`` and nothing
    else, so one broken file doesn't stop the others.
    """
    schema = f"video_id long, frame_index long, time_ms long, {fingerprint.SIGNATURE}, error string"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def frames(row: dict) -> list[dict]:
        out = []
        for i, (time, pixels) in enumerate(decode(row["path"], row["seconds"], row["full_scan"])):
            t = time if row["full_scan"] else row["seconds"][i]
            out.append({"video_id": row["video_id"], "frame_index": row["first"] + i, "time_ms": int(t * 1000 + 0.5), **fingerprint.signature(pixels)})
        if not row["full_scan"] and len(out) != len(row["seconds"]):
            raise ValueError(f"{len(out)} of {len(row['seconds'])} frames")
        return out

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    out = frames(row)
                except Exception as error:  # whatever a decoder raises is the file's failure
                    out = [{"video_id": row["video_id"], "error": f"{type(error).__name__}: {error}"}]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return plan.select("video_id", "path", "seconds", "full_scan", "first").mapInArrow(run, schema)
