"""Paths, lines, globs and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, or null."""
    found = F.regexp_extract(file_name(path), r".\.([^.]+)$", 1)
    return F.lower(F.when(found != "", found))


def lines(text: Column) -> Column:
    """Lines; one line end at the very end adds no line, and an empty text has none."""
    body = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\n\z", "")
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(body, "\n", -1))


def collapsed(text: Column) -> Column:
    """Blanks shrunk to one, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def glob(path: Column, pattern: str) -> Column:
    """One star: prefix and suffix; several: contains what is left without stars; none: equals or ends with."""
    if pattern.count("*") == 1:
        a, b = pattern.split("*")
        return path.startswith(a) & path.endswith(b) & (F.length(path) >= len(a) + len(b))
    if "*" in pattern:
        return path.contains(pattern.replace("*", ""))
    return (path == pattern) | path.endswith(pattern)


def wanted(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Excludes win; without includes everything else is wanted."""
    out = F.lit(not include)
    for p in include:
        out = out | glob(path, p)
    for p in exclude:
        out = out & ~glob(path, p)
    return out


#: Definitions whose names count as identifiers of a file (fixed values).
IDENTIFIERS = r"(?U)(?:class|interface|function|def|fn|const|let|var)[^\S\n]+(\w+)"


def identifiers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIERS), F.lit(1))))


def slice_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, from 1, both included."""
    return F.array_join(F.slice(lines(text), first, F.greatest(F.lit(0), last - first + 1)), "\n")


def csv_cell(x: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.rlike('[",\n]'), quoted).otherwise(x)


def markup_cell(x: Column) -> Column:
    out = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
