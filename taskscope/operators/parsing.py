"""Line-grain parsing of texts, done inside the row.

A text is cut in lines, every line is tagged, and the tagged lines are joined
again so that one linear pattern finds the blocks. Nothing is shuffled: a
corpus of any size is parsed in its scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions import paths
from ..functions.skew import top_n
from ..functions.text import (
    any_of, clean, each, first_pattern, literal_array, matches, normalize, numbered_lines, pattern, squash, strip, tokenize,
)

# Control characters that tag lines; they are removed from the input first.
_MARK, _END, _CLOSE = "\u0001", "\u0002", "\u0003"


def _plain(col: Column) -> Column:
    return F.regexp_replace(clean(col), "[\u0001-\u0003]", " ")


def _shift(col: Column) -> Column:
    """The array moved one place to the right, with a null in front."""
    return F.slice(F.concat(F.array(F.lit(None)), col), F.lit(1), F.size(col))


def _let(value: Column, body) -> Column:
    """Bind ``value`` once, so that a lambda inside ``body`` does not compute it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- written rules ------------------------------------------------------------

_BULLET = r"^\s{0,3}([-*+]|\d+[.)])\s+|^#{1,6}\s+"
_SOURCE = r"^## Source:\s+(.+)$"


def _line_kind(line: Column) -> Column:
    """S source, X flush, B bullet or heading, P prose. First characters decide before any pattern."""
    bare = strip(line)
    first = F.substring(bare, 1, 1)
    bullet = first.isin("-", "*", "+", "#", *"0123456789") & line.rlike(_BULLET)
    return (
        F.when(bare == "", "X")
        .when(bare.startswith("## Source:") & bare.rlike(_SOURCE), "S")
        .when(bare.startswith("---") & bare.rlike(r"^-{3,}$"), "X")
        .when(bullet, "B")
        .otherwise("P")
    )


def _clean_rule(col: Column) -> Column:
    out = F.regexp_replace(col, r"^\s{0,3}[-*+]\s+", "")
    out = F.regexp_replace(out, r"^\s{0,3}\d+[.)]\s+", "")
    return strip(F.regexp_replace(out, r"^#+\s+", ""))


def parse_rules(
    docs: DataFrame, text: str = "text", default_source: str = "unknown", only_actionable: bool = False
) -> DataFrame:
    """Rules of written documents, one row per rule, in document order.

    Bullets, numbered items and headings of at least 4 characters are one rule
    each; consecutive prose lines fold into one rule of at least 20 characters.
    The first of several rules with the same source and lower-cased content wins.
    Adds ``rule_id``, ``source_path``, ``content`` and ``pos`` (from 0), numbered after
    dropping rules without an instruction when ``only_actionable``.
    """
    keep = [c for c in docs.columns if c != text]
    lines = docs.withColumn("_lines", numbered_lines(_plain(F.col(text)))).drop(text)
    kinds = lines.withColumn("_kinds", F.transform("_lines", _line_kind))
    zipped = kinds.withColumn(
        "_zip", F.arrays_zip(F.col("_lines").alias("line"), F.col("_kinds").alias("kind"), _shift(F.col("_kinds")).alias("before"))
    )

    def piece(z: Column) -> Column:
        kind = z["kind"]
        folds = (kind == "P") & (z["before"] == "P")
        body = (
            F.when(kind == "P", strip(z["line"]))
            .when(kind == "B", _clean_rule(z["line"]))
            .when(kind == "X", "")
            .otherwise(strip(F.regexp_extract(strip(z["line"]), _SOURCE, 1)))
        )
        return F.concat(F.when(folds, " ").otherwise(F.concat(F.lit(_MARK), kind)), body)

    joined = zipped.select(*keep, F.array_join(F.transform("_zip", piece), "").alias("_joined"))

    def rule(segment: Column, source: Column) -> Column:
        kind, rest = F.substring(segment, 1, 1), F.substring(segment, 2, 2147483647)
        wide = rest.contains("  ") | rest.contains("\t")
        prose = F.when(wide, F.regexp_replace(rest, r"\s+", " ")).otherwise(rest)
        marked = F.substring(prose, 1, 1).isin("-", "*", "+", "#", " ", *"0123456789")
        folded = F.when((kind == "P") & marked, _clean_rule(prose)).when(kind == "P", strip(prose)).otherwise(rest)
        return F.struct(source.alias("source"), kind.alias("kind"), folded.alias("content"))

    def section(body: Column, index: Column) -> Column:
        return _let(
            F.split(body, _MARK),
            lambda segments: _let(
                F.when(index == 0, F.lit(default_source)).otherwise(F.element_at(segments, 1)),
                lambda source: F.transform(F.slice(segments, F.lit(2), F.size(segments)), lambda s: rule(s, source)),
            ),
        )

    found = F.filter(
        F.flatten(F.transform(F.split("_joined", _MARK + "S"), section)),
        lambda r: F.length(r["content"]) >= F.when(r["kind"] == "P", 20).otherwise(4),
    )
    keyed = joined.select(
        *keep,
        F.array_sort(
            F.transform(
                found,
                lambda r, i: F.struct(
                    F.concat(r["source"], F.lit(":"), F.lower(r["content"])).alias("key"),
                    i.alias("at"), r["source"].alias("source"), r["content"].alias("content"),
                ),
            )
        ).alias("_sorted"),
    )
    firsts = keyed.select(
        *keep,
        F.array_sort(
            F.transform(
                F.filter(
                    F.zip_with("_sorted", _shift(F.col("_sorted")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                    lambda z: z["b"].isNull() | (z["a"]["key"] != z["b"]["key"]),
                ),
                lambda z: F.struct(z["a"]["at"].alias("at"), z["a"]["source"].alias("source"), z["a"]["content"].alias("content")),
            )
        ).alias("_rules"),
    )
    rules = each("_rules")
    if only_actionable:
        rules = F.filter(rules, lambda r: ~is_environment_rule(r["content"]) & ~is_documentation_only(r["content"]))
    return firsts.select(*keep, F.posexplode(rules).alias("pos", "_rule")).select(
        *keep,
        F.concat(F.lit("r"), (F.col("pos") + 1).cast("string")).alias("rule_id"),
        F.col("_rule.source").alias("source_path"),
        F.col("_rule.content").alias("content"),
        "pos",
    )


def is_environment_rule(content: Column) -> Column:
    text = clean(content)
    lower = F.lower(text)
    # every pattern needs one of these, which is cheaper to look for
    likely = (
        lower.contains("command") | lower.contains("sequence") | lower.contains("context") | lower.contains("prefix")
        | (lower.contains("su") & lower.contains("-"))
    )
    return likely & any_of(text, C.ENVIRONMENT_RULE_PATTERNS, ignore_case=True)


def is_file_reference(content: Column) -> Column:
    value = F.regexp_replace(strip(clean(content)), r"^[-*+]\s+", "")
    return (value != "") & ~F.regexp_replace(value, "^@", "").rlike(r"\s") & value.rlike("(?i)" + C.FILE_REFERENCE_PATTERN)


def is_documentation_only(content: Column) -> Column:
    """Content that carries no instruction of its own."""
    value = F.regexp_replace(strip(clean(content)), r"^#+\s+", "")
    value = strip(F.regexp_replace(value, r"^\*\*(.*)\*\*$", "$1"))
    lower = F.lower(value)
    tools = sum((F.when(lower.contains(t), 1).otherwise(0) for t in C.TOOL_REFERENCE_TOKENS), F.lit(0))
    table = (
        (F.regexp_count(value, F.lit(r"\|")) >= 4)
        & matches(lower, r"\btool\b") & matches(lower, r"\buse\s+when\b") & (tools >= 2)
    )
    tokens = tokenize(value)
    heading = (
        (F.length(value) <= 80) & ~value.rlike("[`.:;]") & (F.size(tokens) <= 4)
        & ~F.arrays_overlap(tokens, literal_array(C.ACTION_TOKENS))
    )
    return (
        (value == "") | value.rlike("^<!--.*-->$") | is_file_reference(value)
        | any_of(value, C.DOCUMENTATION_HEADINGS, ignore_case=True) | table | heading
    )


# --- SQL statements -----------------------------------------------------------


def split_sql(files: DataFrame, text: str = "text") -> DataFrame:
    """Statements of SQL files with the line each starts on.

    ``--`` comments are removed; a statement runs to the end of the line that
    holds its semicolon, so two statements on one line stay together; trailing
    text without a semicolon is a statement too. Adds ``stmt``, ``line``, ``ord``.
    """
    keep = [c for c in files.columns if c != text]
    numbered = F.array_join(
        F.transform(
            numbered_lines(_plain(F.col(text))),
            lambda l, i: F.concat(F.lit(_MARK), (i + 1).cast("string"), F.lit(_END), F.regexp_replace(l, "--.*$", "")),
        ),
        "\n",
    )
    parts = F.filter(
        F.transform(
            F.regexp_extract_all(numbered, F.lit(r"[^;]*;[^\n]*|[^;]+"), F.lit(0)),
            lambda s: F.struct(
                squash(F.regexp_replace(s, f"{_MARK}\\d+{_END}", "")).alias("stmt"),
                F.regexp_extract(s, f"{_MARK}(\\d+){_END}[^\\S\\n]*[^\\s{_MARK}]", 1).try_cast("int").alias("line"),
            ),
        ),
        lambda p: p["stmt"] != "",
    )
    return files.select(*keep, F.posexplode(parts).alias("ord", "_p")).select(
        *keep, F.col("_p.stmt").alias("stmt"), F.col("_p.line").alias("line"), "ord"
    )


# --- data model schema files --------------------------------------------------

_ATTRIBUTE = r"@@?[A-Za-z_][\w.]*(\([^)]*\))?"
_FIELD = r"^([A-Za-z_]\w*)\s+([A-Za-z_]\w*)(\[\])?(\?)?\s*(.*)$"


def parse_schema_blocks(files: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of schema files: ``kind``, ``name``, ``line`` and ``body`` (numbered lines)."""
    keep = [c for c in files.columns if c != text]
    lines = F.filter(
        F.transform(
            numbered_lines(_plain(F.col(text))),
            lambda l, i: F.struct((i + 1).cast("string").alias("n"), strip(F.regexp_replace(l, "//.*$", "")).alias("t")),
        ),
        lambda l: l["t"] != "",
    )
    tagged = F.array_join(F.transform(lines, lambda l: F.concat(F.lit(_MARK), l["n"], F.lit(_END), l["t"])), "")
    closed = F.regexp_replace(tagged, f"{_MARK}\\d+{_END}\\}}(?={_MARK}|$)", _CLOSE)
    head = f"{_MARK}(\\d+){_END}(datasource|generator|model|enum|type|view)\\s+([A-Za-z_]\\w*)\\s*\\{{"
    blocks = F.regexp_extract_all(closed, F.lit(head + f"[^{_CLOSE}]*"), F.lit(0))
    rows = files.select(*keep, F.explode(blocks).alias("_block"))
    body = F.transform(
        F.slice(F.split("_block", _MARK), F.lit(3), F.size(F.split("_block", _MARK))),
        lambda l: F.struct(
            F.substring_index(l, _END, 1).cast("int").alias("line"), F.substring_index(l, _END, -1).alias("text")
        ),
    )
    return rows.select(
        *keep,
        F.regexp_extract("_block", head, 2).alias("kind"),
        F.regexp_extract("_block", head, 3).alias("name"),
        F.regexp_extract("_block", head, 1).cast("int").alias("line"),
        body.alias("body"),
    )


def schema_models(blocks: DataFrame) -> DataFrame:
    """One row per model, type or view, with its fields and block attributes as arrays."""
    keep = [c for c in blocks.columns if c not in ("kind", "name", "line", "body")]

    def field(l: Column) -> Column:
        return F.struct(
            l["line"].alias("line"),
            l["text"].alias("text"),
            F.regexp_extract(l["text"], _FIELD, 1).alias("name"),
            F.regexp_extract(l["text"], _FIELD, 2).alias("type"),
            (F.regexp_extract(l["text"], _FIELD, 3) != "").alias("is_list"),
            (F.regexp_extract(l["text"], _FIELD, 4) != "").alias("is_optional"),
            F.regexp_extract_all(F.regexp_extract(l["text"], _FIELD, 5), F.lit(_ATTRIBUTE), F.lit(0)).alias("attributes"),
        )

    return blocks.where(F.col("kind").isin("model", "type", "view")).select(
        *keep, "kind", "name", "line",
        F.filter("body", lambda l: l["text"].startswith("@@")).alias("block_attributes"),
        F.transform(
            F.filter("body", lambda l: ~l["text"].startswith("@@") & l["text"].rlike(_FIELD)), field
        ).alias("fields"),
    )


def schema_fields(models: DataFrame) -> DataFrame:
    keep = [c for c in models.columns if c not in ("fields", "block_attributes", "kind", "name", "line")]
    return models.select(*keep, "kind", F.col("name").alias("model"), F.explode(each("fields")).alias("_f")).select(
        *keep, "kind", "model", F.col("_f.name").alias("field"), F.col("_f.type").alias("type"),
        F.col("_f.is_list").alias("is_list"), F.col("_f.is_optional").alias("is_optional"),
        F.col("_f.attributes").alias("attributes"), F.col("_f.line").alias("line"), F.col("_f.text").alias("text"),
    )


def schema_block_attributes(models: DataFrame) -> DataFrame:
    keep = [c for c in models.columns if c not in ("fields", "block_attributes", "kind", "name", "line")]
    return models.select(*keep, F.col("name").alias("model"), F.explode(each("block_attributes")).alias("_a")).select(
        *keep, "model", F.col("_a.text").alias("text"), F.col("_a.line").alias("line")
    )


def schema_enums(blocks: DataFrame) -> DataFrame:
    keep = [c for c in blocks.columns if c not in ("kind", "name", "line", "body")]
    values = F.transform("body", lambda l: F.element_at(F.split(l["text"], r"\s+"), 1))
    return blocks.where(F.col("kind") == "enum").select(*keep, "name", "line", values.alias("values"))


def schema_options(blocks: DataFrame, kind: str = "datasource") -> DataFrame:
    """``provider`` and ``url`` of datasource (or generator) blocks."""
    keep = [c for c in blocks.columns if c not in ("kind", "name", "line", "body")]

    def option(key: str) -> Column:
        hits = F.filter("body", lambda l: strip(F.substring_index(l["text"], "=", 1)) == key)
        hits = F.filter(hits, lambda l: l["text"].contains("="))
        text = F.element_at(F.transform(hits, lambda l: l["text"]), -1)
        value = strip(F.regexp_extract(text, r"^[^=]*=(.*)$", 1))
        return F.when(F.size(hits) > 0, F.regexp_replace(value, "^[\"']|[\"']$", ""))

    return blocks.where(F.col("kind") == kind).select(
        *keep, "name", "line", option("provider").alias("provider"), option("url").alias("url")
    )


# --- catalog documents --------------------------------------------------------

_FRONTMATTER = r"^---\s*\r?\n([\s\S]*?)\r?\n---\s*(?:\r?\n|$)"


def _strip_frontmatter(col: Column) -> Column:
    return F.regexp_replace(col, _FRONTMATTER.replace("([", "(?:["), "")


def frontmatter_field(text: Column, key: str) -> Column:
    """Value of the last ``key:`` line of the front matter; null when absent."""
    block = F.regexp_extract(text, _FRONTMATTER, 1)
    values = F.regexp_extract_all(block, F.lit(rf"(?m)^{key}:[^\S\n]*(.*)$"), F.lit(1))
    last = F.regexp_replace(strip(F.element_at(values, -1)), "^[\"']|[\"']$", "")
    return F.when(F.size(values) > 0, last)


def _paragraphs(body: Column) -> Column:
    return F.split(body, r"\n\s*\n")


def _first_nonblank(parts: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(parts, lambda p: p != ""), F.lit(1)), F.lit(""))


def parse_catalog_docs(docs: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """Name, description and metadata lists of catalog documents.

    The sections of a document go to metadata fields by their heading; the first
    matching heading pattern decides. Adds ``name``, ``description`` and ``meta``.
    """
    keep = [c for c in docs.columns if c != text]
    body = _plain(_strip_frontmatter(clean(F.col(text))))
    first = _first_nonblank(F.transform(_paragraphs(body), lambda p: squash(F.regexp_replace(p, r"(?m)^#+\s*", ""))))
    described = F.coalesce(F.nullif(frontmatter_field(clean(F.col(text)), "description"), F.lit("")), first)
    named = F.coalesce(
        F.nullif(frontmatter_field(clean(F.col(text)), "name"), F.lit("")), paths.basename(paths.dirname(F.col(path)))
    )

    def tag(line: Column) -> Column:
        return (
            F.when(line.rlike(r"^#{1,6}\s+.+$"), F.concat(F.lit(_MARK + "H"), strip(F.regexp_replace(line, r"^#{1,6}\s+", ""))))
            .when(line.rlike(r"^[-*]\s+.+$"), F.concat(F.lit(_MARK + "I"), strip(F.regexp_replace(line, r"^[-*]\s+", ""))))
            .otherwise(F.concat(F.lit(_MARK + "P"), line))
        )

    def item(raw: Column) -> Column:
        out = F.regexp_replace(F.substring(raw, 2, 2147483647), r"^\[[ xX]\]\s+", "")
        return strip(F.regexp_replace(out, "^`|`$", ""))

    lines = F.filter(F.transform(numbered_lines(body), strip), lambda l: l != "")
    joined = F.array_join(F.transform(lines, tag), "")
    sectioned = docs.select(
        *keep, named.alias("name"), truncate_description(described).alias("description"),
        F.split(joined, _MARK + "H").alias("_raw"),
    )

    def section(raw: Column) -> Column:
        parts = F.split(raw, _MARK)
        rest = F.slice(parts, F.lit(2), F.size(parts))
        items = F.concat(F.filter(rest, lambda p: p.startswith("I")), F.filter(rest, lambda p: p.startswith("P")))
        return F.struct(
            first_pattern(normalize(F.element_at(parts, 1)), C.SECTION_FIELDS, "").alias("field"),
            F.filter(F.transform(items, item), lambda v: v != "").alias("items"),
        )

    sections = sectioned.withColumn(
        "_sections", F.transform(F.slice("_raw", F.lit(2), F.size("_raw")), section)
    ).drop("_raw")

    def values(field: str) -> Column:
        return F.flatten(F.transform(F.filter("_sections", lambda s: s["field"] == field), lambda s: s["items"]))

    evidence = values("evidence")
    evidence_files = F.filter(evidence, lambda v: v.rlike(C.FILE_PATTERN_HINT))
    evidence_deps = F.filter(evidence, lambda v: ~v.rlike(C.FILE_PATTERN_HINT))
    empty = F.array().cast("array<string>")
    by_field = {
        "intent": values("intent"),
        "positive_prompts": F.array_distinct(values("positive_prompts")),
        # section order inside one list follows the document only per heading kind
        "files": F.array_distinct(F.concat(evidence_files, values("files"))),
        "dependencies": F.array_distinct(evidence_deps),
        "workflows": values("workflows"),
        "related_skills": F.array_distinct(values("related_skills")),
        "depends_on": F.array_distinct(values("depends_on")),
        "provides": F.array_distinct(values("provides")),
        "requires": F.array_distinct(values("requires")),
        "suggested_files": F.array_distinct(values("files")),
    }
    return sections.select(
        *keep, "name", "description",
        F.struct(*[by_field.get(f, empty).alias(f) for f in C.META_FIELDS]).alias("meta"),
    )


def truncate_description(col: Column) -> Column:
    return squash(col)


def infer_meta(name: Column, description: Column) -> Column:
    """Metadata suggested by keywords of the name and description, as a struct."""
    text = normalize(F.concat_ws(" ", clean(name), clean(description)))
    empty = F.array().cast("array<string>")
    lists = {}
    for field in C.META_FIELDS:
        parts = [
            F.when(matches(text, regex), literal_array(adds[field])).otherwise(empty)
            for regex, adds in C.METADATA_INFERENCE
            if field in adds
        ]
        lists[field] = F.concat(*parts) if parts else empty
    return F.struct(*[lists[f].alias(f) for f in C.META_FIELDS])


def merge_meta(*metas: Column) -> Column:
    """Union of metadata structs, field by field, first occurrence first."""
    empty = F.array().cast("array<string>")

    def merged(field: str) -> Column:
        together = F.concat(*[F.coalesce(m[field], empty) for m in metas])
        return F.array_distinct(F.filter(F.transform(together, strip), lambda v: v != ""))

    return F.struct(*[merged(f).alias(f) for f in C.META_FIELDS])


def parse_workflow_docs(docs: DataFrame, text: str = "text", path: str = "path", min_bytes: int = 0) -> DataFrame:
    """Name, title, description and agent chain of workflow documents."""
    keep = [c for c in docs.columns if c != text]
    raw = clean(F.col(text))
    body = _strip_frontmatter(raw)
    stem = F.regexp_replace(paths.basename(F.col(path)), r"\.md$", "")
    title = strip(F.regexp_extract(body, r"(?m)^#\s+(.+?)\s*$", 1))
    from_file = F.array_join(
        F.transform(F.split(stem, "[-_]+"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2147483647))),
        " ",
    )
    titles = F.filter(
        F.transform(
            F.regexp_extract_all(body, F.lit(r"(?m)^#{3,4}\s+(.+?)\s*$"), F.lit(1)),
            lambda t: strip(F.regexp_replace(t, r"^\d+\.\s*", "")),
        ),
        lambda t: t != "",
    )
    known = literal_array(C.AGENT_NAMES)
    quoted = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?i)`([a-z][a-z0-9-]*(?:-agent)?)`"), F.lit(1)),
        lambda n: F.regexp_replace(F.lower(n), "-agent$", ""),
    )
    # a plain search of the lower-cased text comes before each pattern
    named = _let(F.lower(body), lambda low: F.filter(
        F.array(*[F.when(low.contains(n) & matches(body, rf"\b{n}\b", ignore_case=True), n) for n in C.AGENT_NAMES]), lambda n: n.isNotNull()
    ))
    chain = F.array_distinct(F.concat(F.filter(quoted, lambda n: F.array_contains(known, n)), named))
    # the paragraphs that keep something when cleaned; only the first of them is cleaned
    told = F.get(F.filter(_paragraphs(body), lambda p: p.rlike(r"[^\s*_`#>-]") & ~p.rlike(r"^\s*#")), F.lit(0))
    first = squash(F.regexp_replace(F.regexp_replace(told, r"(?m)^#+\s*", ""), "[*_`#>-]", ""))
    parsed = docs.where(F.octet_length(raw) >= min_bytes).select(
        *keep, stem.alias("name"), F.coalesce(F.nullif(title, F.lit("")), from_file).alias("title"),
        titles.alias("_titles"), chain.alias("chain"), first.alias("_first"),
    )
    parts = F.filter(
        F.array(
            F.col("title"), F.array_join("_titles", ", "),
            F.when(
                F.size("chain") > 0,
                F.concat(F.lit("delegates to "), F.array_join("chain", ", "), F.lit(" agents")),
            ).otherwise(""),
            F.col("_first"),
        ),
        lambda p: p != "",
    )
    # as elements of an array, so that the test of the description is not pushed down with all that it is made of
    row = F.struct("name", "title", truncate_description(F.array_join(parts, " — ")).alias("description"), "chain")
    out = parsed.select(*keep, F.explode(F.filter(F.array(row), lambda r: r["description"] != "")).alias("_r"))
    return out.select(*keep, "_r.*")


# --- mentions and identifiers -------------------------------------------------

_IMPORT = r"""\bimport\s+(?:[^'"]+\s+from\s+)?['"][^'"]+['"]|\brequire\(\s*['"][^'"]+['"]\s*\)"""


def import_specifiers(col: Column) -> Column:
    """Relative module specifiers a source text imports or requires."""
    found = F.transform(
        F.regexp_extract_all(clean(col), F.lit(pattern(_IMPORT)), F.lit(0)),
        lambda m: F.regexp_extract(m, r"""['"]([^'"]+)['"]""", 1),
    )
    return F.array_distinct(F.filter(found, lambda s: s.startswith(".")))


def extract_imports(files: DataFrame, text: str = "text") -> DataFrame:
    keep = [c for c in files.columns if c != text]
    return files.select(*keep, F.explode(import_specifiers(F.col(text))).alias("specifier"))


_EXT = "tsx?|jsx?|mjs|cjs|json|md|sql|py"
_SEGMENT = r"[A-Za-z0-9_.()\[\]@~:,-]+"


def _clean_mention(col: Column) -> Column:
    out = F.regexp_replace(col, rf"(?i)\.({_EXT})\(\d+(?:,\d+)?\)[),.;:]*$", ".$1")
    out = F.regexp_replace(out, rf"(?i)\.({_EXT}):\d+(?::\d+)?[),.;:]*$", ".$1")
    return F.regexp_replace(out, r"[),.;:]+$", "")


def path_mentions(prompt: Column) -> Column:
    """Paths named in a prompt, in order.

    The text is cut at whitespace first: no path spans a space, and it keeps the
    path pattern linear on long runs without a slash.
    """
    tokens = F.filter(
        F.split(F.regexp_replace(clean(prompt), r"/\s+", "/"), r"\s+"),
        lambda t: t.contains("/"),
    )
    found = F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit(rf"{_SEGMENT}(?:/{_SEGMENT})+"), F.lit(0))))
    return F.filter(F.transform(found, _clean_mention), lambda p: p != "")


def file_mentions(prompt: Column) -> Column:
    """Distinct bare file names named in a prompt, in order."""
    runs = F.filter(F.split(clean(prompt), r"[^A-Za-z0-9_.-]+"), lambda t: t.contains("."))
    regex = pattern(rf"\b[A-Za-z0-9_.-]+\.(?:{_EXT}|prisma)\b")
    found = F.flatten(F.transform(runs, lambda t: F.regexp_extract_all(t, F.lit(regex), F.lit(0))))
    return F.array_distinct(F.transform(found, lambda p: paths.basename(_clean_mention(p))))


def mentions(tasks: DataFrame, prompt: str = "prompt") -> DataFrame:
    """One row per path or file name mentioned: ``kind`` (path/file), ``mention``, ``pos``."""
    keep = [c for c in tasks.columns if c != prompt]
    kinds = F.concat(
        F.transform(path_mentions(F.col(prompt)), lambda m, i: F.struct(F.lit("path").alias("kind"), m.alias("mention"), i.alias("pos"))),
        F.transform(file_mentions(F.col(prompt)), lambda m, i: F.struct(F.lit("file").alias("kind"), m.alias("mention"), i.alias("pos"))),
    )
    return tasks.select(*keep, F.explode(kinds).alias("_m")).select(*keep, "_m.kind", "_m.mention", "_m.pos")


# Words of two capitals or more, and letters or digits with separators between. A run of letters or digits ends where no
# word goes on, so it is never given back; neither is a part that is joined, as each of a greedy repeat would be a frame of
# Java's stack. A part ends where no underscore follows: an underscore that joins belongs to the part.
_CAMEL = r"[A-Z](?<![A-Za-z0-9_][A-Z])[a-z0-9]*+[A-Z][A-Za-z0-9]*+(?![A-Za-z0-9_])"
_UNDERSCORED = "(?:_[A-Za-z0-9]++)"
_PARTS = rf"(?:[-.][A-Za-z0-9]++{_UNDERSCORED}*+(?!_))"
_JOINED = rf"(?<![A-Za-z0-9_])[A-Za-z0-9]++(?:{_UNDERSCORED}++(?!_){_PARTS}*+|(?!_){_PARTS}++)"


def identifiers(col: Column) -> Column:
    """Backticked, camel-case and separator-joined identifiers, in that order."""
    text = clean(col)
    return F.concat(
        F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(_CAMEL), F.lit(0)),
        F.regexp_extract_all(text, F.lit(_JOINED), F.lit(0)),
    )


def phrases(col: Column, limit: int | None = None) -> Column:
    """Adjacent word pairs of a text; the first ``limit`` where it is set."""
    head = tokenize(col, "graph")
    if limit is not None:
        head = F.slice(head, 1, limit + 1)

    def pairs(words: Column) -> Column:
        n = F.greatest(F.size(words) - 1, F.lit(0))
        return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))

    return _let(head, pairs)


def hint_tokens(manifests: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct words of the given manifest columns, per repository."""
    text = F.concat_ws(" ", *[F.col(c) for c in columns])
    return manifests.select("repo", F.explode(F.array_distinct(tokenize(text, "words"))).alias("token")).distinct()


def ids_in_text(outputs: DataFrame, ids: DataFrame, limit: int = 3) -> DataFrame:
    """Known ids mentioned in free text: distinct, first seen first, at most ``limit``."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    tokens = F.array_distinct(F.filter(F.transform(F.split("text", "[^A-Za-z0-9_.@-]+"), key), lambda t: t != ""))
    words = outputs.select("output_id", F.posexplode(tokens).alias("seen", "_key"))
    hits = words.join(ids.select("id", key(F.col("id")).alias("_key")), "_key")
    return top_n(hits, ["output_id"], [F.col("seen"), F.col("id")], limit, rank="place").select("output_id", "id", "place")


def log_counts(text: Column) -> Column:
    """``failed`` and ``passed`` test counts of a run log, as a struct; null without a summary."""
    plain = F.regexp_replace(clean(text), "\u001b\\[[0-9;]*[A-Za-z]", "")
    regex = r"Tests\s+(?:(\d+)\s+failed\s*\|\s*)?(\d+)\s+passed"
    passed = F.regexp_extract(plain, regex, 2)
    failed = F.regexp_extract(plain, regex, 1)
    number = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(passed != "", F.struct(number(failed).alias("failed"), number(passed).alias("passed")))


# --- runtime payloads ---------------------------------------------------------


def _payload_strings(payload: Column) -> Column:
    """``(key, value)`` of every string value of a JSON text, in order; none where the text isn't JSON."""
    masked = F.replace(F.replace(clean(payload), F.lit("\\\\"), F.lit(_END)), F.lit('\\"'), F.lit(_MARK))
    # a key with its string value, a key of another value (dropped), or a bare string
    found = F.regexp_extract_all(masked, F.lit(r'"[^"]*"\s*:\s*"[^"]*"|"[^"]*"\s*:|"[^"]*"'), F.lit(0))
    pairs = F.filter(found, lambda p: ~p.endswith(":"))

    def unmask(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit(_MARK), F.lit('\\"')), F.lit(_END), F.lit("\\\\"))

    def decoded(c: Column) -> Column:
        # escapes are read as JSON reads them
        plain = F.replace(F.replace(c, F.lit(_MARK), F.lit('"')), F.lit(_END), F.lit("\\"))
        return F.when(c.contains("\\") | c.contains(_END), F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), unmask(c), F.lit('"]')), "array<string>"), 0), plain)).otherwise(plain)

    valid = F.try_parse_json(payload).isNotNull()
    return F.transform(
        F.when(valid, pairs).otherwise(F.array().cast("array<string>")),
        lambda p: F.struct(
            decoded(F.regexp_extract(p, r'^"([^"]*)"\s*:', 1)).alias("key"),
            decoded(F.regexp_extract(p, r'"([^"]*)"$', 1)).alias("value"),
        ),
    )


_SIGNALS = [rf"(?i)\b{w}\b" for w in C.SIGNAL_WORDS]
_SIGNAL = "(?i)" + "|".join(rf"\b{w}\b" for w in C.SIGNAL_WORDS)


def signals_in(values: Column) -> Column:
    """Distinct signal words in an array of texts, as written there."""
    per_value = F.transform(values, lambda v: F.array(*[F.regexp_extract(v, pattern(p), 0) for p in _SIGNALS]))
    return F.array_distinct(F.filter(F.flatten(per_value), lambda s: s != ""))


def extract_signals(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``signals``, ``tool_signals`` and ``command_signals`` found in a JSON payload."""
    with_pairs = events.withColumn("_pairs", _payload_strings(F.col(payload)))
    hit = lambda v: v.rlike(pattern(_SIGNAL))

    def under(keys: list[str]) -> Column:
        chosen = F.filter("_pairs", lambda p: p["key"].isin(keys) & hit(p["value"]))
        return F.array_distinct(F.transform(chosen, lambda p: p["value"]))

    values = F.transform("_pairs", lambda p: p["value"])
    return with_pairs.select(
        *events.columns, signals_in(values).alias("signals"), under(C.TOOL_SIGNAL_KEYS).alias("tool_signals"),
        under(C.COMMAND_SIGNAL_KEYS).alias("command_signals"),
    )


def tool_calls(lines: DataFrame, server: str, line: str = "line") -> DataFrame:
    """Tool-call events of a JSON-RPC line stream; works on batch and streaming input."""
    message = F.from_json(line, "method STRING, params STRUCT<name: STRING>")
    keep = [c for c in lines.columns if c != line]
    tool = F.coalesce(F.nullif(F.col("_m.params.name"), F.lit("")), F.lit("unknown"))
    return (
        lines.withColumn("_m", message)
        .where(F.col("_m.method") == "tools/call")
        .select(*keep, F.lit(server).alias("server"), tool.alias("tool"), F.concat_ws(".", F.lit(server), tool).alias("tool_name"))
    )
