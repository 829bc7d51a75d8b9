"""Functions of paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ext_of(path: Column) -> Column:
    """Lower-case extension without its dot; empty for names that only begin with one."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]+)$", 1))


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def under(path: Column, folder: str) -> Column:
    """Below folder, by a half-open range that a sorted Parquet scan prunes: 0 is the byte after /."""
    base = folder.rstrip("/")
    return (path >= f"{base}/") & (path < f"{base}0")


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def ancestors(path: Column) -> Column:
    """Every folder above a path, / left out."""
    parts = F.split(path, "/")
    n = F.size(parts) - 2
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))).otherwise(F.array().cast("array<string>"))


def mtime_day(mtime: Column) -> Column:
    return F.greatest(F.floor(mtime / 86400).cast("bigint"), F.lit(0).cast("bigint"))


def ignored(path: Column, rules: list[str]) -> Column:
    """gitignore-like rules, later ones first: names or globs anywhere, ! takes back, / at the end for folders."""
    out = F.lit(False)
    for rule in rules:
        back, body = rule.startswith("!"), rule.lstrip("!").strip("/")
        glob = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else ("\\" + c if not c.isalnum() else c) for c in body)
        hit = path.rlike(f"(^|/){glob}" + ("/" if rule.endswith("/") else "(/|$)"))
        out = F.when(hit, F.lit(not back)).otherwise(out)
    return out
