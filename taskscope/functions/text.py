"""Text expressions: accent folding, tokenizers, word-boundary patterns.

All of them are column expressions, so they run inside the scan stage with no
shuffle and no Python worker.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from .. import constants as C

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def pattern(regex: str) -> str:
    r"""Give ``\b`` its ASCII meaning on every Java version.

    Next to a literal letter or digit one look to the other side is enough.
    """
    parts = regex.split(r"\b")
    out = parts[0]
    for before, after in zip(parts, parts[1:]):
        opens = re.match(r"[A-Za-z0-9_](?![*?{])", after)
        closes = re.search(r"(?:^|[^\\])[A-Za-z0-9_]$", before)
        out += f"(?<!{_WORD})" if opens else f"(?!{_WORD})" if closes else _BOUNDARY
        out += after
    return out


def matches(col: Column, regex: str, ignore_case: bool = False) -> Column:
    return col.rlike(("(?i)" if ignore_case else "") + pattern(regex))


def any_of(col: Column, regexes: list[str], ignore_case: bool = False) -> Column:
    """True when any of the patterns is found, as one alternation."""
    return matches(col, "|".join(f"(?:{r})" for r in regexes), ignore_case)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every Latin letter that is a base letter plus combining marks under NFD."""
    src, dst = [], []
    for block in (range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        for code in block:
            folded = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
            if folded != chr(code) and len(folded) == 1:
                src.append(chr(code))
                dst.append(folded)
    return "".join(src), "".join(dst)


def fold_accents(col: Column) -> Column:
    src, dst = _accent_table()
    folded = F.regexp_replace(F.translate(col, src, dst), "[̀-ͯ]", "")
    return F.when(F.octet_length(col) > F.length(col), folded).otherwise(col)


def each(name: str) -> Column:
    """A computed array column, to be exploded.

    Spark tests an exploded column for emptiness as early as the scan, which would
    compute the array twice; an expression over it is left alone.
    """
    return F.filter(name, lambda x: x.isNotNull())


def clean(col: Column) -> Column:
    """Null-safe text."""
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Remove surrounding whitespace of every kind."""
    return F.btrim(col, F.lit(" \t\n\r\f\u000b"))


def normalize(col: Column) -> Column:
    """Lower-case words of ``[a-z0-9]+`` separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(clean(col)), "[^a-z0-9]+", " "))


def squash(col: Column) -> Column:
    return F.trim(F.regexp_replace(clean(col), r"\s+", " "))


# Separators that do not stand between two letters or digits.
_LOOSE_SEPARATORS = r"(?<![a-z0-9._-])[._-]++|[._-]++(?![a-z0-9])"


def _runs(text: Column, regex: str) -> Column:
    """All matches, in order; to look for a class of few characters is several times as fast as to split at all others."""
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def _joined(text: Column, first: str, second: str) -> Column:
    """The two words as one; a text without them meets no pattern."""
    whole = lambda t: F.when(t.contains(first) & t.contains(second), F.regexp_replace(t, rf"{first}\s+{second}", f"{first}-{second}")).otherwise(t)
    return F.element_at(F.transform(F.array(text), whole), 1)


def _rule_tokens(col: Column) -> Column:
    text = fold_accents(F.lower(clean(col)))
    for first, second in C.PHRASE_JOINS:
        text = _joined(text, first, second)
    words = _runs(F.regexp_replace(text, _LOOSE_SEPARATORS, " "), "[a-z0-9_.-]+")

    def with_parts(word: Column) -> Column:
        return F.when(
            word.contains(".") | word.contains("-") | word.contains("_"),
            F.concat(F.array(word), F.split(word, "[_.-]+")),
        ).otherwise(F.array(word))

    return F.filter(
        F.flatten(F.transform(words, with_parts)), lambda w: (F.length(w) > 1) & ~w.isin(C.RULE_STOP_WORDS)
    )


def _catalog_tokens(col: Column) -> Column:
    return F.filter(F.split(normalize(col), " "), lambda w: (F.length(w) > 2) & ~w.isin(C.CATALOG_STOP_WORDS))


def _file_tokens(col: Column) -> Column:
    text = F.regexp_replace(F.lower(clean(col)), "[^a-z0-9/._-]+", " ")
    return F.array_distinct(
        F.filter(F.split(text, r"[\s/._-]+"), lambda w: (F.length(w) >= 3) & ~w.isin(C.FILE_STOP_WORDS))
    )


def _eval_tokens(col: Column) -> Column:
    return F.filter(F.split(F.lower(clean(col)), "[^a-z0-9@.-]+"), lambda w: F.length(w) > 2)


def _graph_terms(col: Column) -> Column:
    return F.filter(
        _runs(fold_accents(F.lower(clean(col))), "[a-z0-9]+"),
        lambda w: (F.length(w) > 2) & ~w.isin(C.GRAPH_STOP_WORDS),
    )


def _words(col: Column) -> Column:
    return F.filter(F.split(normalize(col), " "), lambda w: w != "")


_PROFILES = {
    "rule": _rule_tokens,
    "words": _words,
    "catalog": _catalog_tokens,
    "file": _file_tokens,
    "eval": _eval_tokens,
    "graph": _graph_terms,
}


def tokenize(col: Column, profile: str = "rule") -> Column:
    """Tokens of a text as ``ARRAY<STRING>``, in order, under one of six profiles."""
    return _PROFILES[profile](col)


def first_pattern(col: Column, table: list[tuple[str, str]], default: str, ignore_case: bool = False) -> Column:
    """Label of the first pattern of ``table`` that matches."""
    out = None
    for label, regex in table:
        cond = matches(col, regex, ignore_case)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def numbered_lines(col: Column) -> Column:
    """Lines of a text, without the line terminator."""
    return F.split(clean(col), "\r?\n")


def literal_array(values: list[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def literal_map(table: dict[str, list[str]]) -> Column:
    pairs: list[Column] = []
    for key, values in table.items():
        pairs += [F.lit(key), literal_array(values)]
    return F.create_map(*pairs)


def weight(col: Column, table: dict[str, float]) -> Column:
    """Numeric weight of a label; 0 for an unknown one."""
    out = None
    for key, value in table.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(0 if all(isinstance(v, int) for v in table.values()) else 0.0)


def clamp01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def half_up(col: Column, digits: int = 0) -> Column:
    return F.round(col, digits)
