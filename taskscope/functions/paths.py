"""Path expressions over posix paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import HTTP_ROUTE_PATTERN
from .text import pattern


def posix(col: Column) -> Column:
    return F.regexp_replace(col, r"\\", "/")


def basename(col: Column) -> Column:
    return F.regexp_extract(col, r"([^/]*)/*$", 1)


def dirname(col: Column) -> Column:
    """Directory of a path; the empty string at the root."""
    return F.when(col.contains("/"), F.regexp_replace(col, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(col: Column) -> Column:
    """Last extension with its dot; empty for none and for dotfiles."""
    return F.regexp_extract(basename(col), r"^.+?(\.[^.]*)$", 1)


def join(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))


def normalize(col: Column) -> Column:
    """Resolve ``.`` and ``..``; null when the path leaves the root or is absolute."""
    parts = F.filter(F.split(col, "/+"), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)
        ).otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.array_join(stack, "/")
    return F.when(col.startswith("/") | joined.startswith("..") | (joined == ""), F.lit(None)).otherwise(joined)


def ancestors(col: Column) -> Column:
    """Every directory from the root (``""``) down to and including ``col``."""
    parts = F.filter(F.split(col, "/+"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def search_text(col: Column) -> Column:
    """The path followed by its words: separators and camel case become spaces."""
    words = F.regexp_replace(col, r"\.[^.]+$", "")
    words = F.regexp_replace(words, r"[._/-]+", " ")
    words = F.regexp_replace(words, r"([a-z])([A-Z])", "$1 $2")
    return F.concat(col, F.lit(" "), words)


def has_http_route(prompt: Column) -> Column:
    return prompt.rlike(pattern(HTTP_ROUTE_PATTERN))


def _points(col: Column, table: list[tuple[str, int]]) -> Column:
    total = F.lit(0)
    for regex, value in table:
        total = total + F.when(col.rlike(regex), value).otherwise(0)
    return total


def priority(path: Column) -> Column:
    """How likely a path is first-party application source."""
    return _points(
        F.lower(path),
        [
            (r"/src/", 20),
            (r"/modules/", 20),
            (r"\.controller\.", 15),
            (r"\.service\.", 10),
            (r"\.module\.", 8),
            (r"/node_modules/|/dist/|/build/|/coverage/|/\.next/", -100),
        ],
    )


def route_bonus(path: Column, prompt: Column) -> Column:
    points = _points(F.lower(path), [(r"\.controller\.(tsx?|jsx?)$", 120), (r"\.module\.(tsx?|jsx?)$", 40)])
    return F.when(has_http_route(prompt), points).otherwise(0)


def neighbour_score(path: Column, prompt: Column) -> Column:
    base = _points(
        F.lower(path),
        [
            (r"\.controller\.(tsx?|jsx?)$", 80),
            (r"\.service\.(tsx?|jsx?)$", 70),
            (r"\.module\.(tsx?|jsx?)$", 60),
            (r"/dto/|\.dto\.", 45),
            (r"\.repository\.", 35),
            (r"\.spec\.|\.test\.", 20),
        ],
    )
    return F.lit(580) + base + route_bonus(path, prompt)


def is_module_neighbour(path: Column, prompt: Column) -> Column:
    value = F.lower(path)
    return (
        value.rlike(r"\.(spec|test)\.")
        | value.rlike(r"(controller|service|module|repository|resolver|handler|guard|dto|schema|mapper|presenter)\.(tsx?|jsx?)$")
        | value.rlike(r"/dto/.*\.(tsx?|jsx?)$")
        | (has_http_route(prompt) & value.rlike(r"\.(controller|module)\.(tsx?|jsx?)$"))
    )


def module_root(path: Column) -> Column:
    """``.../src/modules/X`` or ``.../modules/X``; null outside a module."""
    nested = F.regexp_extract(path, r"^(.*?src/modules/[^/]+)", 1)
    plain = F.regexp_extract(path, r"^(.*?modules/[^/]+)", 1)
    return F.when(nested != "", nested).when(plain != "", plain)
