"""The operators that run numpy in tasks, against plain versions of what they compute."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from taskscope.llm import decontamination, near_duplicates, pieces, quality, secrets, substrings, toxicity
from taskscope.llm import tokens as T

from .cases import ODD, SCHEMA, odd_docs, rows_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- substring dedup


def brute_repeats(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[k:k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k:k + size])] > 1:
                gone[k:k + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [[], ODD, ODD + [(20, "q " * 50), (21, "a b c d"), (22, "x a b c d"), (23, "a b c d")]])
def test_substrings(spark, rows):
    got = substrings.removal_report(odd_docs(spark, rows), 3)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows, 3)


def test_substrings_across_many_batches(spark, monkeypatch):
    random.seed(3)
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(k, " ".join(random.choice("abcdefgh") + str(random.randint(0, 9)) for _ in range(80)) + (" " + shared if k % 3 == 0 else "")) for k in range(300)]
    got = substrings.removal_report(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert rows_of(got) == brute_repeats(rows, 35)


def thue_morse(n, letters="ab"):
    """A word and its complement that have the same value as polynomials modulo a power of two, whatever the base."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_substrings_of_words_that_plain_hashes_confuse(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(34)) + " " + w) for n in (1024, 2048) for k, w in enumerate(thue_morse(n), n)]
    got = substrings.removal_report(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(got) == brute_repeats(rows, 35) and all(r[2] == 0 for r in rows_of(got))
    data, offsets = T.flat(pa.array([w for n in (1024, 2048, 4096) for w in thue_morse(n)]))
    for fields in (T.FIELDS, T.OTHERS):
        assert len(set(T.hashes(data, offsets[:-1], offsets[1:], fields).tolist())) == 6
    same = [[hash_ for hash_ in T.hashes(data, offsets[:-1], offsets[1:])[[2, 3]][np.array(w) % 2]] for w in ([bin(k).count("1") for k in range(2048)], [bin(k).count("1") + 1 for k in range(2048)])]
    a, b = (T.windows(np.array(w, np.uint64), np.array([0, 2048]), 2048)[0][0] for w in same)
    assert a != b


def test_substrings_confirm_windows_by_a_second_hash(spark, monkeypatch):
    """A first hash of three values flags nearly all windows; the second one alone decides then."""
    random.seed(12)
    rows = [(f"id{k}", " ".join(random.choice("abcd") for _ in range(random.randint(0, 30)))) for k in range(60)] + [(None, "a b c d e f"), ("x", "a b c d e f"), ("x", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    weak, real = substrings._hashed, T.windows

    def hashed(size, ranges, fields, again):
        run = weak(size, ranges, fields, again)

        def poor(batches):
            if not again:
                T.windows = lambda tokens, first, n, f=T.FIELDS: (lambda found, at: (found % np.uint64(3), at))(*real(tokens, first, n, f))
            try:
                yield from run(batches)
            finally:
                T.windows = real

        return poor

    monkeypatch.setattr(substrings, "_hashed", hashed)
    got = substrings.removal_report(docs, 5)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows, 5)


# --- sentencepiece


def check_pieces(texts):
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Encoder(pieces.load(MODEL))
    ids, rows = coder.encode(texts)
    decoded = pieces.decode(coder.v, ids, rows)
    for k, t in enumerate(texts):
        want = sp.encode(t or "")
        assert ids[rows[k]:rows[k + 1]].tolist() == want, t
        assert decoded[k] == sp.decode(want)


def test_pieces_of_a_slice_take_bounded_memory():
    import tracemalloc

    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(pieces._SLICE // 9))
    coder = pieces.Encoder(pieces.load(MODEL))
    tracemalloc.start()
    coder.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6


def test_pieces_equal_the_library():
    check_pieces([w for n in (1024, 2048) for w in thue_morse(n)])
    check_pieces(["", None, " ", "  a", "a  b\t\nc ", "ﬁ①Ａ", "\u0000x", "▁a", "a▁▁b", "日本 語", " " * 37, " " * 5000 + "ab", "a" * 3000, "=-" * 500, "<s></s><0x41>", "​x"])
    random.seed(1)
    kinds = ["abcde ", "the andtio ", "   ▁a", "aaab ", "\n\t x", "éèçßñ ", "日本語中😀 ", "=-_*#. "]
    for _ in range(60):
        check_pieces(["".join(random.choice(random.choice(kinds)) for _ in range(random.randint(0, 60))) for _ in range(50)])


def test_pieces_in_spark(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, len(e := sp.encode(t or "")), sha(",".join(map(str, e))), sha(sp.decode(e))) for i, t in ODD]
    assert rows_of(pieces.digests(odd_docs(spark), MODEL)) == sorted(want, key=str)
    assert pieces.digests(odd_docs(spark, []), MODEL).count() == 0


# --- secrets


def brute_spans(text):
    out = []
    for k, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text, re.I | re.A if r.ignore_case else 0):
            skip = re.match(r.head, m.group(), re.I | re.A).end() if r.head else 0
            if len(m.group()) - skip >= r.least:
                out.append((m.start(), k, m.end()))
    return [(secrets.RULES[k].kind, a, b) for a, k, b in sorted(out)]


def test_secrets_equal_plain_matching(spark):
    random.seed(5)
    parts = [
        "token", "secret", "password", "api_key", "apikey", "=", " ", ":", "'", '"', "a1b2c3d4", "deadbeef", "AKIA", "ABCD1234EFGH", "\n", "é", ",", "xyz-_./+", "ghp_", "A" * 36,
        "xoxb-12345678901", "eyJabc", ".", "-----BEGIN RSA PRIVATE KEY-----", "http://", "u:", "pw@", "PassWord",
    ]
    texts = [None, "", "token = secret = password=abcdefgh", "AKIAAKIA" + "A1" * 10, "é password: 'hunter22x' ñ", "0a" * 50000 + " token=" + "q" * 5000]
    texts += ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).selectExpr("*", "1 AS spans", "2 AS id")
    got = {r.id: [tuple(s) for s in r.spans] for r in secrets.find_secrets(docs).collect()}
    assert got == {k: brute_spans(t or "") for k, t in enumerate(texts)}


def test_secret_report(spark):
    rows = ODD + [(40, "é password: 'hunter22x' AKIA" + "B" * 16 + " " + "0f" * 12)]
    out = {r.doc_id: r for r in secrets.report(odd_docs(spark, rows)).collect()}
    assert (out[40].n_assign, out[40].n_access, out[40].n_hex) == (1, 1, 1)
    assert out[40].spans == "assign:2:22,access:24:44,hex:45:69" and out[40].base_sha256 == sha(out[40].spans)
    assert out[3].spans == "" and out[3].base_sha256 == sha("")
    assert secrets.report(odd_docs(spark, [])).count() == 0


# --- decontamination

ITEMS = [
    (1, "What is the name of the red river that crosses the old town? It is called the Ruby."), (2, "tiny item"), (3, None), (4, ""), (5, "Name the largest of all the moons. Ganymede."),
    (5, "Name the largest of all the moons. Ganymede."), (None, "An item that has no number at all. None."),
]


def test_leaks(spark):
    filler = " ".join(f"w{k % 97}x{k % 31}" for k in range(400))
    rows = ODD + [
        (30, f"{filler} what is THE name of the red river that crosses the old town it is called the ruby {filler}"), (31, "What is the name of the red river that crosses the old town?"),
        (32, "A tiny item, here"), (33, f"{filler} Name the largest of all the moons: Ganymede. {filler}"), (34, "an item that has no number at all none"),
    ]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS id", "2 AS score")
    docs = odd_docs(spark, rows)
    want = [(30, 1), (32, 2), (33, 5), (33, 5), (34, None)]
    assert rows_of(decontamination.find_leaks(docs, items), "id", "item_id") == sorted(want, key=str)
    assert rows_of(decontamination.find_leaks(docs, items, block_bytes=60), "id", "item_id") == sorted(want, key=str)
    kept = decontamination.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id", "text") == sorted(((i, t) for i, t in rows if i not in (30, 32, 33, 34)), key=str)
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0
    assert decontamination.find_leaks(odd_docs(spark, []), items).count() == 0


def test_search_finds_every_item_above_the_threshold(monkeypatch):
    random.seed(2)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(random.choice(vocabulary[:40 if k % 2 else 300]) for _ in range(random.randint(5, 40)))) for k in range(60)]
    index = decontamination.build_index(items)
    number = {int(h): k for k, h in enumerate(index.vocabulary)}
    plain = decontamination.search
    for least in (0.1, 0.3, 0.6):
        for _ in range(20):
            text = " ".join(random.sample(vocabulary, 50) + random.choice(items)[1].split())
            data, offsets = T.flat(pa.array([text]))
            words, _ = decontamination.terms(data, offsets)
            want = set()
            for a in range(0, max(1, len(words) - index.longest), index.longest):
                total = Counter()
                for t in {number[int(w)] for w in words[a:a + 2 * index.longest] if int(w) in number}:
                    for p in range(index.first[t], index.first[t + 1]):
                        total[int(index.items[p])] += float(index.shares[p])
                want |= {(i, round(s, 9)) for i, s in total.items() if s >= least - 1e-9}
            got = set()

            def spy(*args, got=got):
                out = plain(*args)
                got.update((i, round(s, 9)) for i, s in out)
                return out

            monkeypatch.setattr(decontamination, "search", spy)
            decontamination.search_batch(index, data, offsets, least)
            assert got == want


# --- near duplicates


def brute_near(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    names = list(texts)
    sets = []
    for t in names:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        k = min(5, len(w))
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set())
    up = list(range(len(names)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                up[find(a)] = find(b)
    classes = defaultdict(list)
    for k, t in enumerate(names):
        classes[find(k)] += texts[t]
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((i, least(ids)) for ids in classes.values() for i in ids), key=str)


def test_near_duplicates(spark):
    random.seed(6)
    base = [[random.choice("abcdefghij") + str(random.randint(0, 99)) for _ in range(150)] for _ in range(12)]
    rows = list(ODD)
    for k in range(100):
        w = list(base[k % 12])
        for _ in range(random.choice([0, 1, 2, 12])):
            w[random.randrange(len(w))] = "new" + str(random.random())
        rows.append((100 + k, " ".join(w)))
    docs = odd_docs(spark, rows)
    assert rows_of(near_duplicates.report(docs), "doc_id", "class_id") == brute_near(rows)
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {c for _, c in brute_near(rows)}
    assert near_duplicates.report(odd_docs(spark, [])).count() == 0


def test_near_duplicates_of_a_group_without_a_centre(spark):
    """Variants of one template that isn't there itself: nearly all share buckets, few are linked; all pairs judged."""
    random.seed(8)
    template = [f"t{k}" for k in range(104)]
    rows = []
    for i in range(2000):
        w = list(template)
        for k in random.sample(range(4, 100), 2):
            w[k] = f"new{i}_{k}"
        rows.append((i, " ".join(w)))
    number = {}
    sets = [[number.setdefault(tuple(w[j:j + 5]), len(number)) for j in range(100)] for w in (t.split(" ") for _, t in rows)]
    common = np.zeros((len(rows), len(number)), bool)
    for i, s in enumerate(sets):
        common[i, s] = True
    common = common[:, common.sum(axis=0) > 1].astype(np.float32)
    both = common @ common.T
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in np.argwhere(both >= 0.8 * (200 - both) - 1e-6).tolist():
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(rows))}
    assert 1 < len(set(want.values())) < 2000
    got = near_duplicates.report(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert {r.doc_id: r.class_id for r in got.select("doc_id", "class_id").collect()} == want


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for weighted in (False, True):
        x = [f"v{k}" for k in range(200)]
        y = x[:150] + [f"z{k}" for k in range(50)]
        if weighted:
            x, y = [w for w in x for _ in range(1 + int(w[1:]) % 4)], [w for w in y for _ in range(1 + int(w[1:]) % 3)]
        a, b = Counter(x), Counter(y)
        if not weighted:
            a, b = Counter(set(x)), Counter(set(y))
        want = sum((a & b).values()) / sum((a | b).values())
        rng.shuffle(x)
        data, offsets = T.flat(pa.array([" ".join(x), " ".join(y)]))
        found, first = near_duplicates.elements(data, offsets, 1, weighted)
        s = near_duplicates.signatures(found, first, 2000)
        assert abs((s[0] == s[1]).mean() - want) < 0.05


# --- classifiers


def labelled_docs(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.85), (toxicity, "toxic", 0.85)])
def test_classifiers_on_held_out_rows(spark, module, label, least):
    docs, labels = labelled_docs(spark)
    out = module.report(docs, labels)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    truth = {r.doc_id: r[label] for r in labels.collect()}
    got = out.collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    tested = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(tested) >= least


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_stand_odd_tables(spark, module, label):
    one = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "1 AS y", "2 AS text")
    assert all(r.score > 0.999 for r in module.score(odd_docs(spark), module.fit(odd_docs(spark), one, label)).collect())
    both = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (8, 1, 1), (9, 1, 1), (7, 1, 1), (3, 0, 0), (4, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = module.report(odd_docs(spark), both).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in module.score(odd_docs(spark), module.fit(odd_docs(spark), one.limit(0), label)).collect())
    assert module.report(odd_docs(spark, []), both).count() == 0


def plain_kernel(u, z):
    """Common subsequences of three letters, weighted by what they skip."""

    def weighed(unit):
        kinds = [int(toxicity._CLASS[b]) for b in unit]
        found, norm = Counter(), 0.0
        for i in range(len(kinds)):
            for j in range(i + 1, len(kinds)):
                for k in range(j + 1, min(len(kinds), i + toxicity.SPAN)):
                    if kinds[i] and kinds[j] and kinds[k]:
                        found[kinds[i], kinds[j], kinds[k]] += toxicity.DECAY ** (k - i - 2)
                        norm += toxicity.DECAY ** (2 * (k - i - 2))
        return found, max(norm, 1e-12) ** 0.5

    (a, n), (b, m) = weighed(u), weighed(z)
    return sum(w * b[f] for f, w in a.items()) / n / m


def test_margins_equal_direct_kernel_sums():
    rng = np.random.default_rng(2)
    units = [bytes(rng.choice(list(b"aeidot1-. \xc3\xa9"), rng.integers(1, 16))) for _ in range(40)] + [b"idiot", b"ab", b"", b"!?"]
    units = [u for u in units if u]
    marks, alpha = units[:9], rng.standard_normal(9)
    direct = np.array([[plain_kernel(u, z) for z in marks] for u in units])
    assert np.allclose(toxicity.kernel(units, marks), direct, atol=1e-4)
    model = toxicity.Model(toxicity._feature_table(marks, alpha), 0.25, 0.0, 1.0, 0.5)
    assert np.allclose(toxicity._margin(model, units), direct @ alpha + 0.25, atol=1e-3)
    # a document's margin is the largest of its units'
    words = [u for u in units if b" " not in u and len(u) > 1 and len(u) < toxicity._WINDOW]
    data = np.frombuffer(b" ".join(words), np.uint8)
    want = max(sum(a * plain_kernel(u, z) for a, z in zip(alpha, marks, strict=True)) for u in words) + 0.25
    assert abs(model.margins(data, np.array([0, len(data)]))[0] - want) < 1e-3


def test_spaced_letters_of_any_alphabet_are_one_unit():
    def cut(text):
        data = np.frombuffer(text.encode(), np.uint8)
        a, b, _ = toxicity.units(data, np.array([0, len(data)]))
        return [data[x:y].tobytes().decode() for x, y in zip(a, b, strict=True)]

    assert cut("un i m b é c i l ici") == ["un", "i m b é c i l", "ici"]
    assert cut("д у р а к !") == ["д у р а к", "!"] and cut("a – b 😀 c") == ["a", "–", "b", "😀", "c"]
    whole, spaced = "imbécil".encode(), "i m b é c i l".encode()
    assert toxicity.kernel([spaced], [whole])[0, 0] > 0.5


def test_training_reads_a_bounded_sample(spark, monkeypatch):
    rows = [(k, "x" * 1000) for k in range(20)] * 2
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    read = []
    monkeypatch.setattr(toxicity, "train", lambda docs, prior: read.extend(docs))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 7000)
    toxicity.fit(spark.createDataFrame(rows, SCHEMA), labels)
    assert len(read) == 6  # three ids of two rows


def test_quality_scores_equal_means_of_vectors():
    rng = np.random.default_rng(3)
    texts = ["", "one", "Two two TWO, three!", "é ß 日本 " * 30, " ".join(rng.choice(["alpha", "Beta.", "42", "x"], 500))]
    vectors, out, bias = rng.standard_normal((quality.BUCKETS, 4)), rng.standard_normal((4, 2)), np.array([0.3, -0.2])
    data, offsets = T.flat(pa.array(texts))
    found = [np.concatenate(x) for x in zip(*quality.features(data, offsets), strict=True)]
    got = quality.score_batch(quality.Model(vectors @ (out[:, 1] - out[:, 0]), bias[1] - bias[0]), data, offsets)
    for k, score in enumerate(got):
        mine = found[0][(found[1] >= offsets[k]) & (found[1] < offsets[k + 1])]
        z = (vectors[mine].mean(axis=0) if len(mine) else np.zeros(4)) @ out + bias
        assert abs(score - np.exp(z[1]) / np.exp(z).sum()) < 1e-9


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_take_ids_of_any_type(spark, module, label):
    docs = spark.createDataFrame([(f"d{k}", f"plain words {k}" if k % 2 else f"odd stupid idiot {k}") for k in range(40)] + [(None, None)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", 1 - k % 2) for k in range(40)], f"doc_id string, {label} int")
    assert module.score(docs, module.fit(docs, labels)).count() == 41


def test_kernel_stands_gaps_and_inserted_letters():
    words = [b"idiot", b"idxiot", b"id-iot", b"i d i o t", b"1d10t", b"theater"]
    near = toxicity.kernel(words, [b"idiot"])[:, 0]
    assert near[0] > 0.999 and all(x > 0.5 for x in near[1:5]) and near[5] < 0.2
