"""File candidates for tasks: mentions, names, modules, text, vectors, manifests; and their fusion."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .. import constants as C
from ..functions import paths
from ..functions.skew import contains_join, top_n
from ..functions.text import half_up, literal_array, matches, tokenize

CANDIDATE = ["task_id", "path", "score", "source", "reasons"]


def _candidate(df: DataFrame, score: Column, source: str, reason: Column) -> DataFrame:
    return df.select("task_id", "path", score.cast("double").alias("score"), F.lit(source).alias("source"), F.array(reason).alias("reasons"))


# --- paths named in a prompt --------------------------------------------------


def resolve_mentions(mentions: DataFrame, files: DataFrame, packages: DataFrame, limit: int = 6) -> DataFrame:
    """Existing files a mentioned path stands for.

    ``mentions(task_id, repo, mention, pos)``, ``files(repo, path)``,
    ``packages(repo, dir)`` of the workspace packages below the root. A path is tried
    as it is, as a directory with an index file and with its extension missing;
    only when nothing exists it is tried below every workspace package.
    """
    relative = F.regexp_replace("mention", r"^\.?/", "")
    clean = mentions.where(~F.col("mention").contains("://") & ~relative.startswith("..")).withColumn("_p", paths.normalize(relative))
    clean = clean.where(F.col("_p").isNotNull())
    base = F.col("_p")
    options = [base, *[F.concat(base, F.lit("/" + f)) for f in C.DIRECTORY_INDEX_FILES]]
    completed = F.when(
        paths.extension(base) == "", F.array(*[F.concat(base, F.lit(e)) for e in C.COMPLETION_EXTENSIONS])
    ).otherwise(F.array().cast("array<string>"))
    tried = clean.select("task_id", "repo", "_p", "pos", F.posexplode(F.concat(F.array(*options), completed)).alias("_rank", "path"))
    known = files.select("repo", "path").distinct()
    direct = tried.join(known, ["repo", "path"]).select("task_id", "repo", "_p", "path", "pos", "_rank")
    open_ = clean.join(direct.select("task_id", "_p").distinct(), ["task_id", "_p"], "left_anti")
    prefixed = (
        open_.join(packages.select("repo", "dir").distinct(), "repo")
        .select("task_id", "repo", "_p", "pos", F.concat("dir", F.lit("/"), "_p").alias("path"), F.lit(100).alias("_rank"))
        .join(known, ["repo", "path"], "left_semi")
    )
    every = direct.unionByName(prefixed.select("task_id", "repo", "_p", "path", "pos", "_rank"))
    firsts = every.groupBy("task_id", "repo", "path").agg(F.min(F.struct("pos", "_rank", "path")).alias("_o"))
    ranked = top_n(firsts, ["task_id"], [F.col("_o")], limit)
    return ranked.select(
        "task_id", "repo", "path", (1000 - (F.col("rank") - 1) * 0.01).alias("score"), F.lit("prompt-path").alias("source"),
        F.array(F.lit("explicit-path-mentioned")).alias("reasons"),
    )


def by_basename(names: DataFrame, files: DataFrame, tasks: DataFrame, limit: int = 12) -> DataFrame:
    """Files with a mentioned base name, best path first.

    ``names(task_id, repo, mention, pos)``, ``files(repo, path)``, ``tasks(task_id, prompt)``.
    """
    keyed = files.where(~F.col("path").rlike(_excluded(C.LOOKUP_EXCLUDED_DIRS))).select("repo", "path", paths.basename(F.col("path")).alias("mention"))
    hits = names.join(keyed, ["repo", "mention"]).join(tasks.select("task_id", "prompt"), "task_id")
    per_name = top_n(hits, ["task_id", "mention"], [F.desc(paths.priority(F.col("path"))), F.col("path")], limit, rank="_at")
    ranked = top_n(per_name, ["task_id"], [F.col("pos"), F.col("_at")], limit)
    score = paths.route_bonus(F.col("path"), F.col("prompt")) + 900
    return _candidate(ranked, score, "prompt-filename", F.lit("explicit-filename-mentioned"))


def _excluded(dirs: list[str]) -> str:
    return r"(^|/)(" + "|".join(d.replace(".", r"\.") for d in dirs) + ")/"


def neighbours(seeds: DataFrame, files: DataFrame, tasks: DataFrame, limit: int = 12) -> DataFrame:
    """Files of the modules the seeds belong to.

    ``seeds(task_id, repo, path)``, ``files(repo, path)``, ``tasks(task_id, prompt)``.
    """
    roots = seeds.select("task_id", "repo", paths.module_root(F.col("path")).alias("root")).where(F.col("root").isNotNull()).distinct()
    members = files.select("repo", "path", paths.module_root(F.col("path")).alias("root")).where(F.col("root").isNotNull())
    hits = roots.join(members, ["repo", "root"]).join(tasks.select("task_id", "prompt"), "task_id")
    fit = hits.where(paths.is_module_neighbour(F.col("path"), F.col("prompt")))
    scored = fit.withColumn("_s", paths.neighbour_score(F.col("path"), F.col("prompt")))
    ranked = top_n(scored, ["task_id"], [F.desc("_s"), F.col("path")], limit)
    return _candidate(ranked, F.col("_s"), "module-neighbor", F.lit("same-module"))


def schema_candidates(tasks: DataFrame, files: DataFrame, packages: DataFrame, by_name: int = 6) -> DataFrame:
    """Schema files for tasks that mention schema fields: 820 per way the file is found; ``by_name`` of a repository are found by name alone."""
    asked = tasks.where(matches(F.col("prompt"), C.SCHEMA_HINT_PATTERN)).select("task_id", "repo")
    found = files.where(paths.basename(F.col("path")) == "schema.prisma").select("repo", "path")
    fixed = found.where(F.col("path").isin("prisma/schema.prisma", "schema.prisma"))
    inside = packages.select("repo", F.concat("dir", F.lit("/prisma/schema.prisma")).alias("path")).distinct().join(found, ["repo", "path"], "left_semi")
    named = top_n(found, ["repo"], [F.desc(paths.priority(F.col("path"))), F.col("path")], by_name).drop("rank")
    ways = fixed.unionByName(inside).unionByName(named).groupBy("repo", "path").agg(F.count("*").alias("n"))
    return _candidate(asked.join(ways, "repo"), F.col("n") * 820, "schema-hint", F.lit("status-time-fields-mentioned"))


def manifest_candidates(tasks: DataFrame, manifests: DataFrame, limit: int = 6) -> DataFrame:
    """Package manifests for tasks that want to run or build the project.

    ``manifests(repo, path)``. Only the root, the first manifests by path and those
    whose folder the task names can be chosen, so no other pair is built.
    """
    tokens = F.array_distinct(tokenize(F.col("prompt")))
    asked = tasks.select("task_id", "repo", tokens.alias("_t")).where(
        F.arrays_overlap("_t", literal_array(C.RUN_INTENT_WORDS)) & F.arrays_overlap("_t", literal_array(C.PROJECT_INTENT_WORDS))
    )
    folder = paths.basename(paths.dirname(F.col("path")))
    listed = manifests.select("repo", "path", folder.alias("folder"), (F.col("path") == "package.json").alias("root"))
    head = top_n(listed, ["repo"], [F.desc("root"), F.col("path")], 2 * limit).drop("rank")
    some = asked.join(head, "repo").select("task_id", "path", "root", F.array_contains("_t", F.col("folder")).alias("named"))
    words = asked.select("task_id", "repo", F.explode("_t").alias("folder"))
    named = words.join(listed.where(~F.col("root")), ["repo", "folder"]).select("task_id", "path", "root", F.lit(True).alias("named"))
    every = some.unionByName(named).groupBy("task_id", "path").agg(F.max("root").alias("root"), F.max("named").alias("named"))
    order = [F.desc(F.when(F.col("root"), 100).when(F.col("named"), 80).otherwise(0)), F.col("path")]
    ranked = top_n(every, ["task_id"], order, limit)
    score = F.when(F.col("root"), F.lit(50.0)).otherwise(
        F.when(F.col("named"), 35).otherwise(20) - (F.col("rank") - 1) * 0.01
    )
    return _candidate(ranked, score, "manifest", F.lit("project-manifest"))


# --- text and vectors ---------------------------------------------------------


#: Bytes of the prompts and the best files of one block of tasks, and of the files of one slice.
_PROMPT_BYTES, _FILE_BYTES = 1 << 20, 8 << 20
#: Bytes of the counts that a task holds at once: those of some files of its slice for its block.
_COUNT_BYTES = 32 << 20
#: Letters of a token that are compared as one number.
_EXACT = 12


def _text_counts(k: int, held: int):
    """Numpy helper shipped by value with the tasks."""

    def spans(starts, at):
        """Places of the entries of ``at`` in a list cut at ``starts``, and how many each has."""
        sizes = starts[at + 1] - starts[at]
        return np.arange(sizes.sum()) + np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes), sizes

    def starts_of(sizes):
        return np.append(0, np.cumsum(np.asarray(sizes, np.int64)))

    def contained(words, tokens):
        """Numbers of the tokens inside each word, as a list cut at word starts; all words are gone through at once."""
        text = "\n".join(words)
        letters = np.zeros(256, np.uint8)
        letters[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = np.arange(1, 37)
        # up to _EXACT letters are one number, in which only the end of a word has the digit 0
        number = lambda digits, at, n: sum(digits[at + j].astype(np.int64) * 37 ** (n - 1 - j) for j in range(n))
        digits = letters[np.frombuffer((text + "\n" * _EXACT).encode(), np.uint8)]
        heads = number(digits, np.arange(len(text)), 3)
        by_size: dict[int, dict[str, list[int]]] = {}
        for i, t in enumerate(tokens):
            by_size.setdefault(min(len(t), _EXACT), {}).setdefault(t[:_EXACT], []).append(i)
        places, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n, starts in by_size.items():
            some = letters[np.frombuffer("".join(starts).encode(), np.uint8)]
            at = np.arange(len(starts)) * n
            wanted = np.zeros(37 ** 3, bool)
            wanted[number(some, at, 3)] = True
            values = number(some, at, n)
            order, place = np.argsort(values), np.flatnonzero(wanted[heads])
            value = number(digits, place, n)
            which = np.searchsorted(values[order], value)
            same = values[order][np.minimum(which, len(values) - 1)] == value
            place, which, groups = place[same], order[which[same]], list(starts.values())
            if n < _EXACT:
                places.append(place)
                found.append(np.array([g[0] for g in groups])[which])
            else:
                longer = [(i, t) for i, g in zip(place.tolist(), which.tolist()) for t in groups[g] if text.startswith(tokens[t], i)]
                places.append(np.array([i for i, _ in longer], np.int64))
                found.append(np.array([t for _, t in longer], np.int64))
        begins = starts_of([len(w) + 1 for w in words])
        word = np.searchsorted(begins, np.concatenate(places), side="right") - 1
        order = np.argsort(word, kind="stable")
        return starts_of(np.bincount(word, minlength=len(words))), np.concatenate(found)[order]

    def best(q: pa.Table, x: pa.Table) -> pa.Table:
        """The ``k`` best files of ``x`` for each task of ``q``, first by path among equals; all files for a task of ``several`` repositories."""
        words_type = pa.list_(q.schema.field("tokens").type.value_type)
        if not q.num_rows or not x.num_rows:
            return pa.table([q["task_id"][:0], x["path"][:0], pa.array([], pa.int64()), pa.array([], words_type)], names=["task_id", "path", "score", "tokens"])
        listed, counts = q["tokens"].to_pylist(), q["counts"].to_pylist()
        place = {t: i for i, t in enumerate(sorted(set().union(*listed)))}
        names, n_tasks, n_tokens = list(place), len(listed), len(place)
        own = [np.array([place[t] for t in ts], np.int64) for ts in listed]
        by_token = np.argsort(flat := np.concatenate([*own, np.empty(0, np.int64)]), kind="stable")
        asks, weights = np.repeat(np.arange(n_tasks), list(map(len, own)))[by_token], np.array([c for cs in counts for c in cs], float)[by_token]
        ask_starts = np.searchsorted(flat[by_token], np.arange(n_tokens + 1))

        # rows of a path are one file
        paths_ = x["path"].to_pylist()
        order = sorted(range(len(paths_)), key=lambda i: (paths_[i] is not None, paths_[i] or ""))
        fresh = np.array([not n or paths_[i] != paths_[order[n - 1]] for n, i in enumerate(order)])
        heads, file_of, n_files = np.array(order)[fresh], np.cumsum(fresh) - 1, int(fresh.sum())

        # a word is numbered when it is met, and its tokens are looked up once
        words = defaultdict()
        words.default_factory = words.__len__
        find, number = re.compile("[a-z0-9]{3,}").findall, words.__getitem__
        hay = x["hay"]
        rows = [np.fromiter(map(number, set(find(hay[i].as_py()))), np.int64) for i in order]
        bases = x["name"].to_pylist()
        bases = [np.fromiter(map(number, set(find(bases[i] or ""))), np.int64) for i in heads]
        word_starts, in_word = contained(list(words), names)
        met, met_starts = np.concatenate([*rows, np.empty(0, np.int64)]), starts_of(np.bincount(file_of, weights=list(map(len, rows)), minlength=n_files))
        base, base_starts = np.concatenate([*bases, np.empty(0, np.int64)]), starts_of(list(map(len, bases)))

        def points(files):
            """Points of each token in each of some files."""
            out = np.zeros((len(files), n_tokens), np.uint8)
            for some, cuts, value in ((met, met_starts, 4), (base, base_starts, 7)):
                at, each = spans(cuts, files)
                row, word = np.repeat(np.arange(len(files)), each), some[at]
                at, each = spans(word_starts, word)
                out[np.repeat(row, each), in_word[at]] = value
            return out

        n_best, several = min(k, n_files), np.flatnonzero(q["several"].to_numpy())
        top, more = np.full((n_tasks, n_best), -1, np.int64), []
        hits = np.append(0, np.cumsum(np.diff(word_starts)[met]))[met_starts]
        cost = np.cumsum(32 * np.diff(hits) + 25 * len(flat) + 32 * n_tasks + n_tokens)
        for files in np.split(np.arange(n_files), np.flatnonzero(np.diff(cost // held)) + 1):
            some = points(files)
            file, token = np.nonzero(some)
            at, each = spans(ask_starts, token)
            cell = asks[at] * len(files) + np.repeat(file, each)
            score = np.bincount(cell, weights[at] * np.repeat(some[file, token], each), n_tasks * len(files)).reshape(n_tasks, -1).astype(np.int64)
            if len(several):
                t, f = np.nonzero(score[several])
                more.append((several[t], files[f], score[several[t], f]))
            # one number that orders by score, then by path
            top = np.concatenate([top, score * n_files + (n_files - 1 - files)], axis=1)
            top = np.partition(top, top.shape[1] - n_best, axis=1)[:, -n_best:]
        top[several] = -1
        task, at = np.nonzero(top >= n_files)
        task, file, score = map(np.concatenate, zip((task, n_files - 1 - top[task, at] % n_files, top[task, at] // n_files), *more))

        reasons: list = [None] * len(task)
        by_file = np.argsort(file, kind="stable")
        step = max(1, held // max(1, n_tokens))
        for first in range(0, len(by_file), step):
            some = by_file[first:first + step]
            files, row = np.unique(file[some], return_inverse=True)
            found = points(files) > 0
            for i, r in zip(some, row):
                reasons[i] = [names[t] for t in np.sort(own[task[i]][found[r, own[task[i]]]])[:5]]
        columns = [q["task_id"].take(pa.array(task)), x["path"].take(pa.array(heads[file])), pa.array(score, pa.int64()), pa.array(reasons, words_type)]
        return pa.table(columns, names=["task_id", "path", "score", "tokens"])

    return best


def _one_row(index: DataFrame, large: DataFrame, tokens: DataFrame) -> DataFrame:
    """``index(repo, path, hay, name)`` where a path of ``large`` is one row, whose text is the tokens found in its rows."""
    same = [index["repo"] == large["repo"], index["path"].eqNullSafe(large["path"])]
    rest, many = index.join(F.broadcast(large), same, "left_anti"), index.join(F.broadcast(large), same, "left_semi")
    # A token is one run of letters and digits, so it lies inside one word of a text:
    # tokens are matched with the distinct words once, not with every text.
    words = many.select("repo", "path", "name", F.explode(F.array_distinct(F.regexp_extract_all("hay", F.lit("[a-z0-9]{3,}"), F.lit(0)))).alias("word"))
    inside = contains_join(words.select("word").distinct(), "word", tokens.select("token").distinct(), "token").select("word", "token")
    hits = words.join(inside, "word").groupBy("repo", "path", "name").agg(F.array_join(F.collect_set("token"), " ").alias("hay"))
    return rest.unionByName(hits)


def text_match(
    tasks: DataFrame, index: DataFrame, limit: int = 10, prompt_bytes: int = _PROMPT_BYTES, file_bytes: int = _FILE_BYTES, held_bytes: int = _COUNT_BYTES,
) -> DataFrame:
    """Indexed files whose path or text contains task tokens: 4 per token, 3 more in the base name.

    ``tasks(task_id, repo, prompt)``, ``index(repo, path, text)``. Rows of a task add up, rows of a path are one file. Of each
    repository the tasks are cut in blocks and the files in slices, both bounded in bytes; each cell of a block and a slice
    counts some files at a time, and returns only its best rows, so that no row is made for each pair of a task and a file.
    """
    tokens = tasks.where(F.col("repo").isNotNull()).select("task_id", "repo", F.explode(tokenize(F.col("prompt"), "file")).alias("token"))
    asked = tokens.groupBy("repo", "task_id", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("repo", "task_id").agg(F.collect_list(F.struct("token", "n")).alias("_t"))
    asked = asked.select("repo", "task_id", F.col("_t.token").alias("tokens"), F.col("_t.n").alias("counts"), (F.count(F.lit(1)).over(Window.partitionBy("task_id")) > 1).alias("several"))
    files = index.where(F.col("repo").isNotNull()).select("repo", "path", F.lower(F.concat_ws(" ", "path", "text")).alias("hay"), F.lower(paths.basename(F.col("path"))).alias("name"))

    # repositories and paths above the bytes of a cell are few, as many as there are such cells at most
    length = index.where(F.col("repo").isNotNull()).groupBy("repo", "path").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("_n"))
    files = _one_row(files, length.where(F.col("_n") > file_bytes).select("repo", "path"), tokens)
    cells = lambda n, most: F.ceil(F.sum(n) / most)
    blocks = asked.groupBy("repo").agg(cells(F.octet_length(F.array_join("tokens", " ")) + 8 * limit, prompt_bytes).alias("blocks")).where("blocks > 1")
    slices = length.groupBy("repo").agg(cells(F.col("_n"), file_bytes).alias("slices")).where("slices > 1")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(n, F.lit(1)) - 1))
    one_of = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1)))

    def cut(df: DataFrame, b: Callable[..., Column], b_of: tuple, s: Callable[..., Column], s_of: tuple) -> DataFrame:
        sized = df.join(F.broadcast(blocks), "repo", "left").join(F.broadcast(slices), "repo", "left")
        return sized.withColumn("b", b(*b_of, F.col("blocks"))).withColumn("s", s(*s_of, F.col("slices"))).drop("blocks", "slices")

    left, right = cut(asked, one_of, ("task_id",), every, ()), cut(files, every, (), one_of, ("path",))
    best = _text_counts(limit, held_bytes)
    schema = StructType([tasks.schema["task_id"], index.schema["path"], StructField("score", LongType()), StructField("tokens", ArrayType(StringType()))])

    found = left.groupBy("repo", "b", "s").cogroup(right.groupBy("repo", "b", "s")).applyInArrow(best, schema)
    # a task of several repositories may meet a path in each
    scored = found.groupBy("task_id", "path").agg(F.sum("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("_tokens"))
    ranked = top_n(scored, ["task_id"], [F.desc("score"), F.col("path")], limit)
    return _candidate(ranked, F.col("score"), "indexed-file-text", F.concat(F.lit("indexed-file-text:"), F.array_join(F.slice("_tokens", 1, 5), ",")))


_PAIRS = "query_id {q}, id {i}, similarity double"


#: Bytes of the vectors of one block of queries, and of one slice of the index.
_BLOCK_BYTES, _SLICE_BYTES = 4 << 20, 8 << 20
#: Bytes of the similarities that a task holds at once: some queries of its block against its slice.
_HELD_BYTES = 32 << 20
#: Rows of a slice whose best one stands for them when the bar is sought.
_GROUP = 64


def _kernels(k: int, held: int):
    """Numpy helpers shipped by value with the tasks."""

    def by_length(vectors) -> list:
        """Rows of each vector length, as one matrix for each."""
        sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
        return [(rows, np.concatenate([vectors[r] for r in rows]).astype(np.float64).reshape(len(rows), n)) for n in np.unique(sizes) if len(rows := np.flatnonzero(sizes == n)) and n]

    def unit(x):
        norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)

    def first_of_level(row, sims, at, ids, n):
        """The first ``n`` by id of the rows that are level for a query."""
        order = np.lexsort((ids[at], sims, row))
        row, at, sims = row[order], at[order], sims[order]
        heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (sims[1:] != sims[:-1])))
        nth = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
        return row[nth < n], at[nth < n]

    def best(query_ids, q, ids, x) -> Iterator[pd.DataFrame]:
        """Best ``k`` rows of ``x`` for each row of ``q`` and every row level with the last of them, some queries at a time.

        Two vectors are compared over the length of the shorter one.
        """
        slices = [(at, m, {m.shape[1]: unit(m)}) for at, m in by_length(x)]
        step, n = max(1, held // (8 * len(ids))), min(k, len(ids))
        ordered, groups = not pd.isna(ids).any(), len(ids) // _GROUP
        for first in range(0, len(q), step):
            some = q[first:first + step]
            sims = None
            for at_q, a in by_length(some):
                for at_x, b, units in slices:
                    size = min(a.shape[1], b.shape[1])
                    if size not in units:
                        units[size] = unit(b[:, :size])
                    found = unit(a[:, :size]) @ units[size].T
                    if found.shape == (len(some), len(ids)):
                        sims = found
                    else:
                        sims = np.zeros((len(some), len(ids))) if sims is None else sims
                        sims[np.ix_(at_q, at_x)] = found
            sims = np.zeros((len(some), len(ids))) if sims is None else sims
            # the n-th best of the heads of groups is no better than the n-th best row
            tops = sims[:, :groups * _GROUP].reshape(len(some), groups, _GROUP).max(axis=2) if groups >= n else sims
            # scores are compared after rounding to 3 decimals, so the bar leaves room for ties
            bar = np.partition(tops, tops.shape[1] - n, axis=1)[:, tops.shape[1] - n] - 4e-3
            row, at = np.nonzero(sims >= bar[:, None])
            if ordered and len(row) > 4 * n * len(some):
                # of rows level with one another only the first can be among the best
                row, at = first_of_level(row, sims[row, at], at, ids, n)
            yield pd.DataFrame({"query_id": query_ids[first:first + step][row], "id": ids[at], "similarity": sims[row, at]})

    return best


def _parts(df: DataFrame, limit: int) -> int:
    """How many parts keep the vectors of each below ``limit`` bytes."""
    return max(1, -(-(df.agg(F.sum(F.size("vector") * 8)).first()[0] or 0) // limit))


def similarity_top_k(
    queries: DataFrame, index: DataFrame, k: int, min_score: float = 0.0, block_bytes: int = _BLOCK_BYTES, slice_bytes: int = _SLICE_BYTES, held_bytes: int = _HELD_BYTES,
) -> DataFrame:
    """Exact ``k`` most similar index rows per query: ``score = (cosine + 1) / 2``, 3 decimals.

    ``queries(query_id, vector)``, ``index(id, vector)``; a vector of norm 0 has similarity 0. Queries are cut in
    blocks and the index in slices, both bounded in bytes, and each task compares one block with one slice, some queries at
    a time so that its similarities are bounded too, and returns only its best rows. The exact scan costs queries x index.
    """
    schema = _PAIRS.format(q=queries.schema["query_id"].dataType.simpleString(), i=index.schema["id"].dataType.simpleString())
    best = _kernels(k, held_bytes)
    blocks, slices = _parts(queries, block_bytes), _parts(index, slice_bytes)
    number = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    left = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("b")).withColumn("s", F.explode(number(slices)))
    right = index.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(slices)).alias("s")).withColumn("b", F.explode(number(blocks)))

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        return pd.concat(best(q["query_id"].to_numpy(), q["vector"].to_numpy(), x["id"].to_numpy(), x["vector"].to_numpy()))

    pairs = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(compare, schema)
    score = half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("similarity") + 1) / 2)), 3)
    scored = pairs.select("query_id", "id", score.alias("score")).where(F.col("score") >= min_score)
    return top_n(scored, ["query_id"], [F.desc("score"), F.col("id")], k)


def vector_candidates(queries: DataFrame, index: DataFrame, limit: int = 10, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Files by vector similarity of at least 0.45, scored ``round(10 * similarity)``.

    ``embed`` adds ``vector`` to inputs that come without one, from whatever columns they have.
    """
    if embed is not None:
        queries, index = (df if "vector" in df.columns else embed(df) for df in (queries, index))
    best = similarity_top_k(queries, index, limit, min_score=0.45).withColumnRenamed("query_id", "task_id").withColumnRenamed("id", "path")
    return _candidate(best, F.round(F.col("score") * 10), "embedding", F.concat(F.lit("file-embedding:"), F.format_number("score", 2)))


# --- fusion -------------------------------------------------------------------


def merge_candidates(*parts: DataFrame) -> DataFrame:
    """One row per task and path: scores added, reasons united, import-graph wins the label.

    Otherwise the last source in argument order gives the label.
    """
    tagged = [p.select(*CANDIDATE).withColumn("_at", F.lit(i)) for i, p in enumerate(parts)]
    every = tagged[0]
    for part in tagged[1:]:
        every = every.unionByName(part)
    # A path comes from each source once or a few times, which bounds the lists.
    grouped = every.groupBy("task_id", "path").agg(
        F.sum("score").alias("score"), F.max_by("source", "_at").alias("_last"),
        F.max(F.col("source") == "import-graph").alias("_imported"),
        F.sort_array(F.collect_set(F.struct("_at", "reasons"))).alias("_r"),
    )
    return grouped.select(
        "task_id", "path", "score", F.when(F.col("_imported"), "import-graph").otherwise(F.col("_last")).alias("source"),
        F.array_distinct(F.flatten(F.transform("_r", lambda r: r["reasons"]))).alias("reasons"),
    )


def merge_graph_hits(hits: DataFrame) -> DataFrame:
    """Search hits of a code graph per task and path: ``1 + score`` each.

    ``hits(task_id, path, query, score)``; paths that leave the repository are dropped.
    """
    inside = hits.withColumn("path", paths.normalize(F.col("path"))).where(F.col("path").isNotNull())
    return inside.groupBy("task_id", "path").agg(
        F.sum(1 + F.coalesce("score", F.lit(0.0))).alias("score"),
        F.array_sort(F.collect_set(F.concat(F.lit("graph:"), "query"))).alias("reasons"),
    )


def fuse_graph(graph: DataFrame, candidates: DataFrame, limit: int = 3) -> DataFrame:
    """Graph hits come first at ``100 + 10 * graph + existing``; then the other candidates."""
    g = graph.select("task_id", "path", F.col("score").alias("_g"), F.col("reasons").alias("_gr"))
    both = candidates.join(g, ["task_id", "path"], "full_outer")
    none = F.array().cast("array<string>")
    fused = both.select(
        "task_id", "path",
        F.when(F.col("_g").isNotNull(), 100 + F.col("_g") * 10 + F.coalesce("score", F.lit(0.0))).otherwise(F.col("score")).alias("score"),
        F.when(F.col("_g").isNotNull(), "graph").otherwise(F.coalesce("source", F.lit("heuristic"))).alias("source"),
        F.array_distinct(F.concat(F.coalesce("_gr", none), F.coalesce("reasons", none))).alias("reasons"),
    )
    return top_n(fused, ["task_id"], [F.desc("score"), F.col("path")], limit)
