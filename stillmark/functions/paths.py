"""Path columns: normal form, keys, parts, containment and short display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[\\/]"


def _windows(p: Column) -> Column:
    return p.rlike(r"^[A-Za-z]:|^\\\\")


def normalize_path(p: Column) -> Column:
    """No trailing separators, roots kept; Windows paths with backslashes only."""
    slashed = F.when(_windows(p), F.translate(p, "/", "\\")).otherwise(p)
    stripped = F.regexp_replace(slashed, r"(?<=.)[\\/]+$", "")
    return F.when(stripped.rlike(r"^[A-Za-z]:$"), F.concat(stripped, F.lit("\\"))).otherwise(stripped)


def path_key(p: Column) -> Column:
    """Comparison key: Unix paths as they are, Windows paths in lower case."""
    return normal_key(normalize_path(p))


def normal_key(n: Column) -> Column:
    """The key of a path in normal form already."""
    return F.when(_windows(n), F.lower(n)).otherwise(n)


def file_name(p: Column) -> Column:
    return F.regexp_extract(p, r"([^\\/]*)$", 1)


def dir_name(p: Column) -> Column:
    """Up to the last separator; the root for what stands in it, empty without any separator."""
    parent = F.regexp_extract(p, r"^(.*)[\\/][^\\/]*$", 1)
    return F.when((parent == "") & p.rlike(r"^[\\/]"), F.substring(p, 1, 1)).otherwise(parent)


def extension(p: Column) -> Column:
    """Lower case with its dot; empty for dot-files and names without a dot."""
    return F.lower(F.regexp_extract(file_name(p), r"^.+(\.[^.]*)$", 1))


def separator(p: Column) -> Column:
    return F.when(_windows(p), F.lit("\\")).otherwise(F.lit("/"))


def is_under(path: Column, directory: Column) -> Column:
    """Strictly inside: bounded by a separator, and not the directory itself."""
    base = F.when(directory.rlike(r"[\\/]$"), directory).otherwise(F.concat(directory, separator(directory)))
    return F.startswith(path, base) & (path != base)


def contains(root: Column, directory: Column) -> Column:
    """Like ``is_under``, and a root contains itself."""
    return (root == directory) | is_under(directory, root)


def ancestors(path: Column) -> Column:
    """Every enclosing directory, outermost first, without the path itself; a Windows drive's root keeps its backslash."""
    windows = _windows(path)
    parts = F.when(windows, F.split(path, SEPARATORS)).otherwise(F.split(path, "/"))

    def first(n: Column) -> Column:
        joined = F.replace(F.array_join(F.slice(parts, F.lit(1), n), "\u0000"), F.lit("\u0000"), separator(path))
        return F.when((n == 1) & F.startswith(path, F.lit("/")), F.lit("/")).when((n == 1) & windows, F.concat(joined, F.lit("\\"))).otherwise(joined)

    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), first)


def fold_dots(path: Column) -> Column:
    """A path with slashes without ``.``, ``..`` and empty parts; what would go above the first part stays there."""

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        skipped = (part == ".") | ((part == "") & (F.size(acc) > 0))
        return F.when(part == "..", up).when(skipped, acc).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def depth(path: Column) -> Column:
    return F.size(F.split(path, SEPARATORS)) - 1


def short_dir(path: Column, roots: Column) -> Column:
    """The directory of ``path`` below the first root that holds it (empty in the root itself), with a separator behind
    it; elsewhere the directory, cut to its last two parts if it has more. Windows paths compare in any case."""
    unix = F.startswith(path, F.lit("/"))
    sep = F.when(unix, F.lit("/")).otherwise(F.lit("\\"))
    fold = lambda c: F.when(unix, c).otherwise(F.lower(c))

    def holds(r: Column) -> Column:
        return F.startswith(fold(path), fold(r)) & (r.rlike(r"[\\/]$") | F.substring(path, F.length(r) + 1, F.lit(1)).rlike(r"[\\/]"))

    root = F.try_element_at(F.filter(roots, holds), F.lit(1))
    below = F.regexp_replace(F.substring(path, F.length(root) + 1, F.length(path)), r"^[\\/]+", "")
    inner = F.regexp_extract(below, r"^(.*)[\\/][^\\/]*$", 1)
    inside = F.when(below.rlike(SEPARATORS), F.concat(inner, sep)).otherwise("")
    directory = dir_name(path)
    parts = F.split(directory, SEPARATORS)
    outside = F.when(directory == "/", "/").when(F.size(parts) > 2, F.concat(F.lit("…"), sep, F.array_join(F.slice(parts, -2, 2), "\u0000"), sep))
    outside = F.replace(outside, F.lit("\u0000"), sep)
    rest = F.when(directory == "", "").otherwise(F.concat(directory, sep))
    return F.when(root.isNotNull(), inside).otherwise(F.coalesce(outside, rest))


def short_path(path: Column, roots: Column) -> Column:
    return F.concat(short_dir(path, roots), file_name(path))
