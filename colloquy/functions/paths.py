"""Paths and projects as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path parts that don't name a project.
DULL_PARTS = ("home", "Users", "root", "mnt", "c", "C:", "src", "work", "projects", "repos", "code", "dev", "Documents", "Desktop")


def to_posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def fold_path(path: Column, any_case: bool) -> Column:
    """For comparison: forward slashes, no trailing one, lower case where the file system ignores case."""
    out = F.regexp_replace(to_posix(path), r"(?<=.)/+\z", "")
    return F.lower(out) if any_case else out


def relative_to_root(path: Column, root: Column, any_case: bool = False) -> Column:
    """A path below root without it, or a relative path as it is; null for other absolute paths, UNC paths, ``..``
    segments, line breaks and more than 400 characters."""
    p = F.regexp_replace(to_posix(path), r"^\./", "")
    base, own = fold_path(F.coalesce(root, F.lit("")), any_case), fold_path(p, any_case)
    below = (base != "") & own.startswith(F.concat(base, F.lit("/")))
    rest = F.when(below, F.substr(p, F.length(base) + 2)).otherwise(p)
    bad = (
        path.isNull() | (F.length(path) > 400) | path.rlike(r"[\r\n]") | to_posix(path).startswith("//") | rest.rlike(r"(^|/)\.\.(/|\z)")
        | rest.rlike(r"^(/|[A-Za-z]:)") | (rest == "")
    )
    return F.when(~bad, rest)


def project_of_path(path: Column) -> Column:
    """The last two parts of a path that can name a project."""
    parts = F.filter(F.split(to_posix(path), "/"), lambda x: (x != "") & ~x.isin(*DULL_PARTS))
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/"))


def project_of_encoded(name: Column) -> Column:
    """``--a-b-c--`` directory names: their last three parts."""
    parts = F.filter(F.split(name, "-"), lambda x: x != "")
    return F.when(name.startswith("-") & (F.size(parts) > 0), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), "/"))


def basename(path: Column) -> Column:
    return F.substring_index(to_posix(path), "/", -1)


def parent(path: Column, levels: int = 1) -> Column:
    parts = F.split(to_posix(path), "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - levels, F.lit(0))), "/")
