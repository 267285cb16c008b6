"""Fragments of the SQL twins. They restate the semantics; the operators never use them."""

from __future__ import annotations

from .. import constants as C


def in_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def str_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_tokens(expr: str) -> str:
    text = f"strip_accents(lower({expr}))"
    for a, b in C.PHRASE_JOINS:
        text = f"regexp_replace({text}, '{a}\\s+{b}', '{a}-{b}', 'g')"
    words = (
        f"list_transform(regexp_split_to_array({text}, '[^a-z0-9_.-]+'), "
        "lambda w: regexp_replace(regexp_replace(w, '^[._-]+', ''), '[._-]+$', ''))"
    )
    parts = "list_filter(regexp_split_to_array(w, '[_.-]+'), lambda p: p <> '')"
    return (
        f"list_filter(flatten(list_transform({words}, lambda w: CASE WHEN len({parts}) > 1 THEN list_concat([w], {parts}) ELSE [w] END)), "
        f"lambda z: length(z) > 1 AND z NOT IN {in_list(C.RULE_STOP_WORDS)})"
    )


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^a-z0-9]+'), lambda w: w <> '')"


def normalized(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '[^a-z0-9]+', ' ', 'g'))"


def catalog_tokens(expr: str) -> str:
    return f"list_filter({words(expr)}, lambda w: length(w) > 2 AND w NOT IN {in_list(C.CATALOG_STOP_WORDS)})"


def file_tokens(expr: str) -> str:
    """Distinct, in no particular order."""
    return (
        f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({expr}), '[^a-z0-9/._-]+', ' ', 'g'), '[\\s/._-]+'), "
        f"lambda w: length(w) >= 3 AND w NOT IN {in_list(C.FILE_STOP_WORDS)}))"
    )


def eval_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^a-z0-9@.-]+'), lambda w: length(w) > 2)"


def graph_terms(expr: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(strip_accents(lower({expr})), '[^a-z0-9]+'), "
        f"lambda w: length(w) > 2 AND w NOT IN {in_list(C.GRAPH_STOP_WORDS)})"
    )


def alias_table() -> str:
    """(token, alias) rows."""
    rows = [f"('{t}', '{a}')" for t, aliases in C.TOKEN_ALIASES.items() for a in aliases]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) v(token, alias))"


def contains_any(expr: str, values) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{v}')" for v in values) + ")"


def case_first(expr: str, table, default: str, flags: str = "") -> str:
    """Label of the first matching pattern."""
    opts = f", '{flags}'" if flags else ""
    whens = " ".join(f"WHEN regexp_matches({expr}, {quote(p)}{opts}) THEN '{label}'" for label, p in table)
    return f"CASE {whens} ELSE '{default}' END"


def weight(expr: str, table: dict) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"
