"""The operators that use DataFrame operations only: sharding, exact dedup, URL filters, components."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from taskscope.llm import components, duplicates, shards, urls

from .cases import ODD, odd_docs, rows_of

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_classes(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(_FOLD)].append(i)
    last = {t: max(v, key=lambda x: (x is not None, x or 0)) for t, v in groups.items()}
    return sorted(((i, last[k], len(groups[k]), i == last[k], hashlib.sha256(k.encode()).hexdigest()) for i, t in rows for k in [(t or "").translate(_FOLD)]), key=str)


@pytest.mark.parametrize("rows", [ODD, [], [(k, "É a" if k % 3 else "É A") for k in range(50)]])
def test_exact_dedup(spark, rows):
    assert rows_of(duplicates.report(odd_docs(spark, rows))) == brute_classes(rows)


def test_exact_dedup_compares_bytes_when_digests_collide(spark):
    weak = duplicates.classes(odd_docs(spark), digest=lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 8, "0")))
    assert rows_of(weak, "id", "keep_id", "group_size") == sorted((r[:3] for r in brute_classes(ODD)), key=str)


def test_exact_dedup_survivors_keep_columns(spark):
    docs = odd_docs(spark)
    out = duplicates.survivors(docs)
    assert out.columns == docs.columns
    want = {(i, t) for i, t in ODD if (i, t) in {(1, None)} or any(r[0] == i and r[3] and hashlib.sha256((t or "").translate(_FOLD).encode()).hexdigest() == r[4] for r in brute_classes(ODD))}
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == Counter({(i, t or "") for i, t in want})


def least_capacity(sizes, k):
    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            n, at = (n + 1, s) if at + s > c else (n, at + s)
        return n <= k

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("rows", [ODD, [], [(k, "x" * 5000 if k % 3 == 0 else "y" * (k * 37 % 300) + str(k)) for k in range(400)]])
def test_shards(spark, rows):
    got = shards.shard(odd_docs(spark, rows), salts=4).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.id, r["size"], r.crc) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots, total = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        total[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    groups = Counter()
    for _, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += size(t)
    if rows:
        assert max(total.values()) == least_capacity([groups[k] for k in sorted(groups)], 24)
        # texts tell groups by size and checksum here
        where = defaultdict(set)
        for r in got:
            where[r["size"], r.crc].add(r.shard)
        assert all(len(v) == 1 for v in where.values())


def test_one_huge_group_leaves_no_shard_empty(spark):
    rows = [(k, "x" * 5000 if k % 3 == 0 else f"text {k}") for k in range(300)]
    assert shards.shard(odd_docs(spark, rows)).select("shard").distinct().count() == 24


def test_components(spark):
    random.seed(4)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(250)] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(600, 640)] + [(7, 7), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    want = {x: find(x) for x in up}
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: r for x, r in want.items() if x != r}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


PAGES = [
    (1, "http://a.NET/x", None), (2, "http://b.org/q", "<LINK href='http://a.net/x#f' rel=canonical>"), (3, "http://b.org/fr/1", '<link rel="canonical" href="http://a.net/x">'),
    (4, "http://c.example.net/en/1", None), (5, None, "<link rel=canonical href=http://a.net/x>"), (6, "nothing", None),
    (7, "http://p.edu", '<meta http-equiv="refresh" content="0; url=/r?a=1&amp;b=2">'), (8, "http://p.edu/r?a=1&b=2", '<link rel="canonical" href="//q.example.com/de/1">'),
    (9, "http://p.edu/z", ""), (10, "https://net?x/", ""), (11, "http://xorg/fr/", None), (12, "http://org/fr/", None), (13, "http://d.edu/a/b", "<link rel=canonical href=c>"),
    (14, "http://d.edu/a/c", "<link rel=canonical href=http://e.example.com/de/>"), (14, "http://d.edu/a/c", None),
    (15, "http://g.edu/", "<link rel=canonical href=http://f.net/><meta http-equiv=refresh content='5;URL=http://org/fr/x'>"),
]


MORE = [
    (21, "http://k.edu/1", '<link rel="alternate canonical" href="http://a.net/1">'), (22, "http://k.edu/2", "<!-- <link rel=canonical href=http://ok.edu/> --><LINK REL='Canonical  x' HREF = 'http://a.net/1' >"),
    (23, "http://k.edu/3", "<link rel=canonical><link rel=canonical title='a>b' href=http://a.net/2>"), (24, "http://k.edu/4", "<link rel=canonical href=http://k.edu/5><link rel=canonical href=http://a.net/4>"),
    (25, "http://k.edu/5", None), (26, "http://k.edu/6", "<link rel=noncanonical href=http://a.net/><link data-rel=canonical href=http://a.net/><linkrel=canonical href=http://a.net/>"),
    (27, "http://k.edu/7", "<script>'<link rel=canonical href=http://a.net/>'</script><style><link rel=canonical href=http://a.net/></style>"), (28, "http://k.edu/8", "<!-- open <link rel=canonical href=http://a.net/>"),
    (29, "http://k.edu/9", '<meta content="0;url=http://k.edu/1" http-equiv="Refresh"><meta name=x content="url=http://z.edu/">'), (30, "http://k.edu/10", "<meta http-equiv=refresh content='5; URL=\"http://a.net/q\"'>"),
    (31, "http://k.edu/" + "long/" * 40000, "x" * 300000 + "<link rel='canonical' href='http://a.net/'>"), (32, "http://k.edu/11", "<link rel=canonical href=it's.html>"),
]


def test_every_link_of_a_page_counts(spark):
    pages = spark.createDataFrame(MORE, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.verdicts(pages).collect()}
    assert got == {i: "allow" if i in (26, 27, 28, 32) else "block" for i, *_ in MORE}


def test_url_twin(spark, tmp_path):
    import duckdb

    from taskscope.llm import queries

    rows = PAGES + MORE
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    columns = ["page_id", "host", "path", "rule", "verdict"]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL['op10_url_filters']})").fetchall()
    assert rows_of(urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")), *columns) == sorted(want, key=str)


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'c' AS host", "'c' AS key", "'c' AS rule", "'c' AS root")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.verdicts(pages).collect()}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("b.org", "/q", None, "allow"), 3: ("b.org", "/fr/1", "org/fr/", "allow"), 4: ("c.example.net", "/en/1", "example.net/en/", "allow"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("p.edu", "", None, "block"), 8: ("p.edu", "/r", None, "block"), 9: ("p.edu", "/z", None, "allow"),
        10: ("net", "", None, "allow"), 11: ("xorg", "/fr/", None, "allow"), 12: ("org", "/fr/", "org/fr/", "allow"), 13: ("d.edu", "/a/b", None, "block"),
        14: ("d.edu", "/a/c", None, "block"), 15: ("g.edu", "/", None, "allow"),
    }
    assert urls.verdicts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
