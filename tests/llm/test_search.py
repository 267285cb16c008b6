"""Source divergence, nearest neighbours and tokenizer alignment against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taskscope.llm import alignment, divergence, neighbours

from .cases import LONG, ODD, odd_docs, rows_of

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- source divergence


def brute_divergence(rows, least, top):
    """rows: (text, lang, source); every share of every kept term, whether it occurs or not."""
    n, docs, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, sources in groups.items():
        kept = [w for (g, w), d in docs.items() if g == lang and d >= least]
        share = {}
        for s in sources:
            total = sum(n[lang, s, w] for w in kept)
            share[s] = {w: 1 + 10**9 * (n[lang, s, w] + 2) // (total + 2 * len(kept)) for w in kept}
        whole = {w: sum(n[lang, s, w] for s in sources) for w in kept}
        q = {w: 1 + 10**9 * (whole[w] + 2) // (sum(whole.values()) + 2 * len(kept)) for w in kept}
        for s in sources:
            pairs = [(sum(f(share[s][w], share[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(f(share[s][w], q[w]), w) for w in kept if n[lang, s, w] and share[s][w] > q[w]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return sorted(out, key=str)


def divergence_rows(n, sources, seed):
    random.seed(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "日本", "x", "I", "common"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    rows = [(" ".join(random.choice(words[: 10 + 17 * (k % 7)]) for _ in range(random.randint(0, 40))), random.choice(["en", "de"]), f"s{random.randint(0, sources)}") for k in range(n)]
    return rows + rows[: n // 3] + [("common common", "en", "s0")] * n + [(None, None, None), ("", "fr", "s1"), (None, "fr", "s2"), ("only here", "it", "s1"), ("123 _", "it", "s2"), (LONG, "en", None)]


@pytest.mark.parametrize("block", [64, 3])
@pytest.mark.parametrize("rows", [[], [(None, None, None)], divergence_rows(300, 9, 1), divergence_rows(80, 40, 2)])
def test_divergence(spark, rows, block, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CELL", 500)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for c in ("doc_id", "term", "n", "docs", "digest", "copies", "p", "q", "slice", "value"):
        docs = docs.selectExpr("*", f"'clash' AS `{c}`")
    got = divergence.audit(docs, least=3, top=10)
    assert rows_of(got, "lang", "source", "part", "item", "value", "rank") == brute_divergence(rows, 3, 10)


def test_divergence_shares_are_exact_beyond_64_bits(spark):
    big = 3 * 10**12
    got = spark.range(1).select(divergence._share(F.lit(big), F.lit(7 * 10**12 + 1)).alias("p")).first().p
    assert got == 1 + 10**9 * (big + 2) // (7 * 10**12 + 1)


# --- nearest neighbours


def brute_nearest(rows, k, every):
    size = max((len(v) for _, v in rows if v), default=0)
    good = [(i, np.array([*v, *[0.0] * (size - len(v))], float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for at, (i, q) in enumerate(good):
        if i is not None and i % every == 0:
            found = sorted(((-float(q @ x), j is None, j or 0) for b, (j, x) in enumerate(good) if b != at))[:k]
            out.append((i, [(None if none else j, -s) for s, none, j in found]))
    return out


def listed(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {i: [x[1:] for x in sorted(v, key=lambda x: x[0])] for i, v in got.items()}


def vectors_of(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("id", "vector", "block", "row", "rank", "score", "query_id", "asked", "chain"):
        table = table.selectExpr("*", f"'clash' AS `{c}`")
    return table


def test_nearest_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (None, [3.0, 0.0]), (8, [2.0]), (9, [-1e3, 5.0]), (40, [0.0, nan]), (10, [0.1, 0.2, 0.3])]
    got = listed(neighbours.nearest(vectors_of(spark, rows)))
    want = dict(brute_nearest(rows, 20, 20))
    assert got.keys() == want.keys() == {0, 20}
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], rtol=1e-12)
    assert neighbours.nearest(vectors_of(spark, [])).count() == 0
    assert neighbours.nearest(vectors_of(spark, [(1, [1.0])])).count() == 0


def cloud(kind, n=3000, d=24):
    r = np.random.default_rng(5)
    if kind == "even":
        return r.standard_normal((n, d))
    x = r.standard_normal((40, d))[r.integers(0, 40, n)] + 0.1 * r.standard_normal((n, d))
    if kind == "lengths":
        x *= r.uniform(0.1, 3, (n, 1))
    if kind == "copies":
        x[::3] = x[0]  # a third of all rows is one vector
    return x


@pytest.mark.parametrize("kind", ["even", "groups", "lengths", "copies"])
def test_nearest_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    monkeypatch.setattr(neighbours, "QUERIES", 64)
    monkeypatch.setattr(neighbours, "CHAIN", 2)
    x = cloud(kind)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = listed(neighbours.nearest(vectors_of(spark, rows)))
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hits = total = 0
    for i in range(0, len(x), 20):
        order = np.lexsort((np.arange(len(x)), -s[i]))[:20]
        assert len(got[i]) == 20 and i not in [j for j, _ in got[i]]
        assert np.allclose([v for _, v in got[i]], s[i][[j for j, _ in got[i]]], rtol=1e-12)
        hits += sum(1 for _, v in got[i] if v >= s[i][order[-1]] - 1e-12)
        total += 20
    assert hits >= 0.97 * total


# --- tokenizer alignment


def brute_alignment(rows):
    coder, sp = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coder.encode_special_tokens = True
    alphabet = alignment._byte_alphabet()
    sides, count = [], Counter()
    for _, text in rows:
        a, b = [], []
        if text:
            a = [(i, bytes(alphabet[c] for c in coder.id_to_token(i))) for i in coder.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a, b = [], []
        groups, i, j = [], 0, 0
        while i < len(a):
            g, n, m = ([], []), 0, 0
            while not g[0] or n != m:
                if n <= m:
                    g[0].append(a[i][0])
                    n, i = n + len(a[i][1]), i + 1
                else:
                    g[1].append(b[j][0])
                    m, j = m + len(b[j][1]), j + 1
            groups.append(g)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(links.keys())
        sides.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, sides, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            i, a, b, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    "It's we'll can't I'd.", "a  b   c\n\nd \n e\t\tf\r\ng", "x  y   z　w", "▁under▁score", "<|endoftext|> and <s> </s> <unk> <0x41>", "日本語のテキスト。終わり", "naïve café ÉCOLE×÷ œuvre", "éà combining",
    "😀😀 👩‍👩‍👧 flags 🇩🇪", "12345 3.14 a1b2 ²³", "_x_ __init__ foo.bar(baz)|qux", " leading and trailing ", " ", "\n", "\u0000 \u0007", "a" * 700, " " * 300, "=" * 500 + " " + "-=" * 300, "«guillemets» “quotes” …", "a.\nB,\nC!\n\nD:\nÉ", "Ωμέγα привет مرحبا", " x \u0085 y", "x . , ; y",
]


def test_alignment_of_odd_rows(spark):
    rows = ODD + [(100 + k, t) for k, t in enumerate(HARD)] + [(200, "the same"), (200, "the same"), (201, "The  same")]
    got = alignment.report(odd_docs(spark, rows), BYTES, PIECES)
    assert rows_of(got, *ALIGNED) == brute_alignment(rows)
    assert alignment.report(odd_docs(spark, []), BYTES, PIECES).count() == 0


def test_alignment_of_random_texts(spark, monkeypatch):
    random.seed(8)
    parts = ["the", "Of", "a", " ", "  ", "\n", "\n\n", ".", ",", "!!", "é", "ñ", "'s", "'", "日本", "1", "22", "_", "|", ")", "(", " ", " ", "😀", "ing", "tion", "X", "×", "\t", "-", "́", "²"]
    rows = [(k, "".join(random.choice(parts) for _ in range(random.randint(1, 120)))) for k in range(400)]
    monkeypatch.setattr(alignment, "_BATCH", 5000)
    got = alignment.report(odd_docs(spark, rows), BYTES, PIECES)
    assert rows_of(got, *ALIGNED) == brute_alignment(rows)
