"""Exact, SimHash, embedding and suffix-array dedup against brute force, and their edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from argusframe.llm import simhash, suffix_dedup
from argusframe.llm._common import connected_components
from argusframe.llm.embedding_dedup import embedding_groups, fit_codes
from argusframe.llm.exact_dedup import exact_dedup, keep_one, text_digest

DOCS = "doc_id long, text string, keep_id string, digest int, salt string, fp string, spans int, n_bytes string, x0 int, id string"


def frame(spark, texts, first=0):
    """Documents with columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, t, "k", 1, "s", "f", 2, "n", 3, "i") for i, t in enumerate(texts, first)], DOCS).repartition(3)


def unite(n, pairs):
    head = list(range(n))
    for a, b in pairs:
        while head[a] != a:
            a = head[a]
        while head[b] != b:
            b = head[b]
        head[max(a, b)] = min(a, b)
    def find(x):
        while head[x] != x:
            x = head[x]
        return x
    return [find(i) for i in range(n)]


TEXTS = ["a", "b", "a", None, "", "A", "x" * 200_000, "x" * 200_000, "a", "b "]


@pytest.mark.parametrize("digest", [text_digest, lambda t: F.lit("same"), lambda t: F.substring(t, 1, 1)])
def test_exact_dedup_compares_content_whatever_the_digest(spark, digest):
    check = (lambda t: F.lit("same")) if digest is not text_digest else None
    options = {"check": check} if check else {}
    got = {r.doc_id: r for r in exact_dedup(frame(spark, TEXTS), digest=digest, **options).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[t or ""].append(i)
    for i, t in enumerate(TEXTS):
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(g), len(g), i == max(g))
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, "n"), (None, "n"), (2, "b")], "doc_id long, text string")
    got = sorted(map(tuple, exact_dedup(df).drop("text_sha256").collect()), key=str)
    assert got == sorted([(None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (None, None, 2, True), (None, None, 2, True), (2, 2, 1, True)], key=str)
    assert exact_dedup(df.limit(0)).collect() == [] and "kept" in exact_dedup(df.limit(0)).columns


def test_keep_one_keeps_columns_and_the_largest_id(spark):
    out = keep_one(frame(spark, TEXTS))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in out.collect()) == [1, 4, 5, 7, 8, 9]


@pytest.mark.parametrize("one_task", [1_000_000, 10])
def test_components(spark, one_task):
    rng = random.Random(0)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(0, i) for i in range(1, 40)] + [(5, 5)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long").repartition(4)
    got = {r.node: r.component for r in connected_components(df, one_task=one_task).collect()}
    head = unite(200, pairs)
    assert got == {i: head[i] for p in pairs if p[0] != p[1] for i in p}
    assert connected_components(df.limit(0), one_task=one_task).collect() == []


@pytest.mark.parametrize("share", [2000, 4])
def test_weighted_joins(spark, share):
    from argusframe.llm._common import join_weighted

    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3, 4, None])], "k long, i long").repartition(5)
    right = spark.createDataFrame([(1, 50, "a"), (2, 3, "b"), (5, 1, "c"), (None, 1, "d")], "k long, n long, v string")
    got = sorted((r.k, r.i, r.v) for r in join_weighted(left, right, ["k"], "n", share).collect())
    assert got == sorted([(1, i, "a") for i in range(50)] + [(2, i, "b") for i in range(50, 53)])
    assert join_weighted(left, right.limit(0), ["k"], "n", share).collect() == []


def test_what_is_written_on_the_way_goes(spark):
    import os

    from argusframe.llm._common import lasting, stored, temporary

    with temporary(spark):
        inner = stored(spark.range(3), "inner")
        kept = lasting(inner, "kept")
        where = [f.removeprefix("file:") for f in inner.inputFiles()]
        assert all(map(os.path.exists, where))
    assert not any(map(os.path.exists, where)) and kept.count() == 3


def test_the_driver_gives_freed_memory_back(spark):
    import re

    from argusframe.llm._common import stored, temporary

    jvm = spark._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"
    outside = lambda: int(re.search(r"RssAnon:\s+(\d+)", open(status).read())[1]) // 1024

    native, size = jvm.org.apache.spark.unsafe.Platform, 1 << 19

    def hold_back():
        """256 MB outside the heap that are used and freed; one block in 50 stays, so that the allocator keeps the others."""
        native.freeMemory(native.allocateMemory(2 * size))  # from now on the arenas serve such blocks
        blocks = [native.allocateMemory(size) for _ in range(512)]
        for b in blocks:
            native.setMemory(b, 1, size)
        for i, b in enumerate(blocks):
            if i % 50:
                native.freeMemory(b)
        return blocks[::50]

    def in_temporary():
        with temporary(spark):
            pass

    in_temporary()
    for use in (lambda: stored(spark.range(3), "inner"), in_temporary):
        kept, before = hold_back(), outside()
        use()
        assert before - outside() > 160
        for b in kept:
            native.freeMemory(b)


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "ÀB c\xa0d e f g", "a b c d " * 50, "x\x1fy z\x0bw v"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("hot", [64, 2])
def test_links_connect_all_within_two_bits(spark, hot):
    rng = random.Random(hot)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:25]:
        for _ in range(12):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    place = {(f - (1 << 64) if f >> 63 else f): i for i, f in enumerate(fps)}
    links = [(place[r.a], place[r.b]) for r in simhash.link_fingerprints(df, hot).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in links)
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert near and unite(len(fps), links) == unite(len(fps), near)


def test_simhash_groups(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [base, base.upper(), base.replace(" ", "\n"), None, "", "alone here", "alone here!", base + " more"]
    got = {r.doc_id: r for r in simhash.simhash_groups(frame(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert [got[i].component_id for i in range(len(texts))] == unite(len(texts), near)
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert simhash.simhash_groups(frame(spark, [])).collect() == []
    out = simhash.keep_one_of_each_group(frame(spark, texts))
    assert {0, 3, 5} <= {r.doc_id for r in out.collect()} and 1 not in {r.doc_id for r in out.collect()}
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_similar_texts_group_beyond_two_bits(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = list(words)
    near[100], near[300] = "changed", "again"
    other = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(frame(spark, [" ".join(w) for w in (words, near, other)])).collect()}
    assert simhash.shingle_similarity(" ".join(words), " ".join(near)) > 0.9
    assert got == {0: 0, 1: 0, 2: 2}


def brute_cosine(ids, vectors, least):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    head = unite(len(ids), zip(*map(list, np.nonzero(near))))
    return {i: (int(n), ids[h]) for i, n, h in zip(ids, near.sum(1), head)}


@pytest.mark.parametrize("block", [512, 16])
def test_embedding_groups(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    v = [(centres[rng.integers(20)] + rng.normal(size=16) * rng.choice([0.05, 0.3])).tolist() for _ in range(260)]
    v += v[:20] + [v[0]] * 20
    ids = list(range(100, 100 + len(v)))
    odd = [(1, None), (2, [0.0] * 16), (3, [float("nan")] * 16), (4, [1.0] * 15), (5, []), (6, [None] + [1.0] * 15), (7, [float("inf")] * 16)]
    df = spark.createDataFrame([*zip(ids, v), *odd], "vec_id long, embedding array<double>").withColumn("rep", F.lit("x")).withColumn("label", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(df, block=block).collect()}
    want = brute_cosine(ids, v, 0.9)
    links, found = sum(n for n, _ in want.values()), sum(got[i][0] for i in ids)
    assert 0.998 * links <= found <= links
    assert sum(got[i] == want[i] for i in ids) >= 0.98 * len(ids)
    assert all(got[i] == (0, i) for i, _ in odd)


def near_pairs(rng, x, cosine):
    """Unit rows at that cosine from those of ``x``."""
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * u / np.linalg.norm(u, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [512, 30])
def test_links_just_above_the_threshold(spark, block):
    """As the query runs: 64 dimensions, its own parameters, planted pairs at cosine 0.9005 to 0.92."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64)) @ np.diag(np.linspace(1, 0.2, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = near_pairs(rng, x[:1200], rng.choice([0.9005, 0.91, 0.92], (1200, 1)))
    below = near_pairs(rng, x[1200:1500], 0.8995)
    v = np.concatenate([x, y, below])
    want = brute_cosine(list(range(len(v))), v, 0.9)
    got = {r.vec_id: r for r in embedding_groups(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>"), block=block).collect()}
    links, found = sum(n for n, _ in want.values()), sum(r.n_links for r in got.values())
    assert links >= 2400 and 0.995 * links <= found <= links
    assert all(r.n_links <= want[i][0] and r.kept == (r.component_id == i) for i, r in got.items())


def test_a_large_group_of_equal_and_near_vectors(spark):
    rng = np.random.default_rng(3)
    one = rng.normal(size=32)
    v = [one.tolist()] * 3000 + [(one + 0.02 * rng.normal(size=32)).tolist() for _ in range(900)] + rng.normal(size=(600, 32)).tolist()
    got = {r.vec_id: r for r in embedding_groups(spark.createDataFrame(list(enumerate(v)), "vec_id int, embedding array<double>").repartition(7)).collect()}
    want = brute_cosine(list(range(len(v))), v, 0.9)
    assert sum(r.n_links for r in got.values()) >= 0.999 * sum(n for n, _ in want.values())
    assert sum(r.component_id == want[i][1] and r.n_links <= want[i][0] for i, r in got.items()) >= len(v) - 3


def test_plan_grows_with_the_logarithm():
    from argusframe.llm.embedding_dedup import fit_plan

    x = np.random.default_rng(0).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plans = [fit_plan(x, n, 0.9, 0.999) for n in (1000, 50_000, 10**7)]
    assert [p.width for p in plans][:2] == [8, 14] and plans[2].width > 14 and all(p.recall >= 0.999 and p.tables <= 62 for p in plans)


def test_embedding_groups_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_groups(df).collect() == []
    one = spark.createDataFrame([(None, [1.0, 2.0]), (3, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embedding_groups(one).collect()), key=str) == sorted([(None, 0, None, True), (3, 0, 3, True)], key=str)
    with pytest.raises(TypeError):
        embedding_groups(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"))


def test_codes_are_balanced():
    x = np.random.default_rng(0).normal(size=(2000, 24)) @ np.random.default_rng(1).normal(size=(24, 24))
    share = fit_codes(x, 24).encode(x).mean(0)
    assert np.abs(share - 0.5).max() < 0.01


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + length] for d in raw for s in range(len(d) - length + 1))
    out = []
    for d in raw:
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs = len([r for r in bytes(gone).split(b"\0") if r])
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out


def planted(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(30, 120))) for _ in range(8)]
    texts = [None, "", "ab" * 60, "z" * 90, "z" * 41]
    for _ in range(n):
        k = rng.random()
        if k < 0.75:
            texts.append("".join(rng.choice(base)[rng.randint(0, 40) :][: rng.randint(20, 90)] + rng.choice(["", "x", f"q{rng.random()}"]) for _ in range(rng.randint(1, 4))))
        else:
            texts.append("".join(rng.choice("abcdefgh") for _ in range(200)))
    return texts


@pytest.mark.parametrize("length, hot, seed", [(40, 4000, 0), (40, 2, 1), (33, 4000, 2), (40, 1, 3)])
def test_repeats_against_brute_force(spark, length, hot, seed):
    texts = planted(seed)
    got = sorted(tuple(r)[1:5] for r in suffix_dedup.remove_repeats(frame(spark, texts), length, crowd=hot).collect())
    want = sorted(brute_repeats(texts, length))
    assert got == want and sum(w[1] for w in want) > 0


def test_repeats_inside_one_long_document(spark, monkeypatch):
    rng = random.Random(3)
    part = "".join(rng.choice("abcdefghij") for _ in range(300))
    text = part + "".join(rng.choice("klmnop") for _ in range(5000)) + part
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 10)  # the long document is then looked at in parts
    docs = [d.encode() for d in (text, part[50:250], "short")]
    doc, place, first, last = suffix_dedup.anchors(docs, 64)
    covered = [set() for _ in docs]
    for d, p, a, z in zip(doc, place, first, last):
        covered[d] |= set(range(a, z + 1))
        assert a <= p <= a + suffix_dedup.span_of(64)
    assert covered == [set(range(max(0, len(d) - 63))) for d in docs]
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(frame(spark, [text, part[50:250], "short"]), 64).collect()}
    assert [got[i] for i in range(3)] == brute_repeats([text, part[50:250], "short"], 64)


def test_repeats_ids_and_columns(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(80))
    df = spark.createDataFrame([(None, text), (1, text), (1, "other " + text), (2, None)], "doc_id long, text string")
    got = sorted((r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df, 40).collect())
    assert got == [(0, 0), (80, 1), (80, 1), (80, 1)]
    docs = frame(spark, [text, "é" + text, None]).withColumn("n_chars", F.lit(5))
    out = suffix_dedup.without_repeats(docs, 40)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars, r.n_bytes) for r in out.collect()} == {0: ("", 0, "n"), 1: ("é", 1, "n"), 2: ("", 0, "n")}
    assert suffix_dedup.remove_repeats(frame(spark, []), 40).collect() == []


@pytest.mark.parametrize("size", [1, 8])
def test_windows_are_sorted_over_all_their_letters(size):
    rng = random.Random(9)
    segments = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 70))).encode() for _ in range(60)]
    segments += [segments[0][3:], b"short", segments[1], b"a" * 50]
    seen = Counter(s[i : i + 20] for s in segments for i in range(len(s) - 19))
    want = [[seen[s[i : i + 20]] > 1 for i in range(max(0, len(s) - 19))] for s in segments]
    wide = segments if size == 1 else [np.frombuffer(s, np.uint8).astype("<u8").tobytes() for s in segments]
    assert [f.tolist() for f in suffix_dedup.repeated_windows(wide, 20, size)] == want


@pytest.mark.parametrize("crowd", [2000, 1])
def test_equal_digests_part_by_content(spark, monkeypatch, crowd):
    texts = planted(4, 60)
    monkeypatch.setattr(suffix_dedup, "_digest", lambda data, seed=0: len(data) % 3)
    got = sorted(tuple(r)[1:5] for r in suffix_dedup.remove_repeats(frame(spark, texts), 40, crowd=crowd).collect())
    assert got == sorted(brute_repeats(texts, 40))


def brute_words(texts, length):
    """Texts without the words of strings of ``length`` that start twice, with the blanks after them."""
    import re

    parts = [list(re.finditer(r"[^ \t\n\x0b\x0c\r]+", t or "")) for t in texts]
    words = [[m[0] for m in p] for p in parts]
    seen = Counter(tuple(w[s : s + length]) for w in words for s in range(len(w) - length + 1))
    out = []
    for t, p, w in zip(texts, parts, words):
        gone = {k for s in range(len(w) - length + 1) if seen[tuple(w[s : s + length])] > 1 for k in range(s, s + length)}
        out.append((t or "")[: p[0].start() if p else None] + "".join((t or "")[m.start() : p[k + 1].start() if k + 1 < len(p) else None] for k, m in enumerate(p) if k not in gone))
    return out


def test_passages_are_told_beside_the_cut(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    short, long_ = prose(55), prose(90)
    texts = [prose(30) + " " + short, short + " " + prose(5), prose(9) + " " + long_, long_, prose(70), None]
    got = {r.doc_id: (r.n_removed, r.n_passage_words) for r in suffix_dedup.remove_repeats(frame(spark, texts), 500, passage=51).collect()}
    assert got == {0: (0, 55), 1: (0, 55), 2: (len(long_), 90), 3: (len(long_), 90), 4: (0, 0), 5: (0, 0)}


def test_words_have_one_digest_beside_long_ones():
    plain = suffix_dedup.word_letters(b"the quick fox")
    for long_ in (b"x" * 4096, b"x" * 4097, b"y" * 70_000):
        mixed = suffix_dedup.word_letters(b"the " + long_ + b" quick\nfox")
        assert mixed[:8] + mixed[16:] == plain and mixed[8:16] == suffix_dedup.word_letters(long_)
    assert suffix_dedup.word_letters(b"") == b""


def brute_told(texts, length):
    """For each text, the number of words in strings of ``length`` words that also start elsewhere."""
    import re

    words = [re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "") for t in texts]
    seen = Counter(tuple(w[s : s + length]) for w in words for s in range(len(w) - length + 1))
    return [len({k for s in range(len(w) - length + 1) if seen[tuple(w[s : s + length])] > 1 for k in range(s, s + length)}) for w in words]


@pytest.mark.parametrize("length, seed", [(51, 0), (51, 1), (8, 2)])
def test_told_passages_against_brute_force(spark, length, seed):
    rng = random.Random(seed)
    prose = lambda n: [rng.choice(["été", "of", "x" * 5000]) if rng.random() < 0.02 else f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [prose(length + k) for k in (0, -1, 1, 9, 200)]
    long_ = prose(3000)
    texts = [None, "", " \n ", "a " * 400, "a b " * 120, " ".join(long_), " ".join(long_[100:260]), "same " + " ".join(passages[0])]
    texts += [" ".join(f"{rng.randrange(10**5)}" for _ in range(150_000)), " ".join(long_[2900:])]  # more than are digested in one go
    for i in range(80):
        own = prose(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            at, part = rng.randint(0, len(own)), rng.choice(passages)
            own[at:at] = part[rng.randint(0, 5) :] if rng.random() < 0.3 else part
        texts.append(rng.choice(["", "\t"]) + rng.choice([" ", "\n", " \x0b "]).join(own))
    texts += texts[-3:]
    # the commonest class has many members that differ
    texts += [" ".join(prose(20) + passages[2] + prose(20)) for _ in range(60)]
    got = {r.doc_id: r.n_passage_words for r in suffix_dedup.remove_repeats(frame(spark, texts).select("doc_id", "text"), 400, passage=length, texts=False).collect()}
    want = brute_told(texts, length)
    assert [got[i] for i in range(len(texts))] == want and 0 < sum(w == 0 for w in want) < len(want)


def test_told_passages_of_rows_without_or_with_the_same_id(spark):
    text = " ".join(f"w{i}" for i in range(55))
    df = spark.createDataFrame([(None, text + " z"), (1, "y " + text), (1, "other"), (2, None), (3, "q " * 51), (3, "q " * 51)], "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, 400, passage=51).collect()
    assert sorted((r.n_bytes, r.n_passage_words) for r in out) == [(0, 0), (5, 0), (102, 51), (102, 51), (len(text) + 2, 55), (len(text) + 2, 55)]
    assert suffix_dedup.remove_repeats(frame(spark, []), 400, passage=51).collect() == []


def test_suffix_query_cuts_400_bytes_and_tells_passages_of_over_50_words(spark, tmp_path):
    """Passages of over 50 words that have under 400 bytes stay, as the contract says, and are told."""
    from argusframe.llm.queries import op10_suffix_dedup

    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(10**4)}" for _ in range(n))
    planted_ = [prose(n) for n in (51, 55, 60, 50, 49)]
    assert all(len(p) < 400 for p in planted_)
    texts = [None, ""] + [f"{prose(rng.randint(5, 60))} {planted_[i % 5]} {prose(rng.randint(5, 60))}" if i < 40 else prose(150) for i in range(60)]
    twin = prose(90)
    texts += [twin, "and " + twin]
    frame(spark, texts).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = op10_suffix_dedup(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert [got[i][:4] for i in range(len(texts))] == brute_repeats(texts, 400)
    assert [i for i in range(len(texts)) if got[i][1]] == [62, 63]
    assert [i for i in range(len(texts)) if got[i][4]] == [i + 2 for i in range(40) if i % 5 < 3] + [62, 63]


@pytest.mark.parametrize("crowd", [2000, 2])
def test_repeated_passages_of_words(spark, crowd):
    rng = random.Random(crowd)
    prose = lambda n: [rng.choice(["été", "the", "of", "x" * 5000]) if rng.random() < 0.02 else f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [prose(n) for n in (60, 51, 50, 49, 51, 300)]
    texts = [None, "", " \n ", "one two"]
    for i in range(90):
        own, k = prose(rng.randint(0, 150)), i % 9
        at = rng.randint(0, len(own))
        if k < 6:
            own[at:at] = passages[k]
        texts.append(rng.choice(["", " ", "\n"]) + rng.choice([" ", "\n", "  "]).join(own) + rng.choice(["", "\n"]))
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(frame(spark, texts), 51, True, crowd=crowd).collect()}
    want = brute_words(texts, 51)
    assert [got[i] for i in range(len(texts))] == want
    planted_, clean = [i for i in range(4, 94) if (i - 4) % 9 in (0, 1, 4, 5)], [i for i in range(4, 94) if (i - 4) % 9 in (2, 3, 6, 7, 8)]
    assert all(got[i] != texts[i] for i in planted_) and all(got[i] == texts[i] for i in clean)


def similar_pairs(texts):
    return [(i, j) for i in range(len(texts)) for j in range(i) if simhash.shingle_similarity(texts[i], texts[j]) >= 0.8]


def test_alike_pairs_by_matrix():
    rng = np.random.default_rng(0)
    part = [np.unique(rng.integers(0, 40, rng.integers(0, 30))).astype("<u8") for _ in range(60)]
    score = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if len(a) or len(b) else 1.0
    got = set(zip(*map(list, simhash.alike_pairs(part[:25], part[25:], 0.5, width=7))))
    assert got == {(i, j) for i in range(25) for j in range(35) if score(part[i], part[25 + j]) >= 0.5} and got


@pytest.mark.parametrize("common, crowd", [(8, 256), (0, 256), (1, 2)])
def test_near_copies_group_whatever_else_is_in_their_buckets(spark, monkeypatch, common, crowd):
    monkeypatch.setattr(simhash, "COMMON", common)
    rng = random.Random(11)
    texts = []
    for _ in range(30):  # families: a first text, and edited copies that are like each other but less like it
        first = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        copy = list(first)
        for k in rng.sample(range(300), 22):
            copy[k] = f"x{rng.randrange(10**6)}"
        again = list(copy)
        for k in rng.sample(range(300), 6):
            again[k] = f"y{rng.randrange(10**6)}"
        texts += [" ".join(w) for w in (first, copy, again)]
    texts += ["same few words here " * n + " ".join(texts[0].split()[:60]) for n in (1, 40)]  # equal sets, other weights
    pairs = similar_pairs(texts)
    assert sum(i % 3 == 2 and j == i - 1 for i, j in pairs) > 10 and (91, 90) in pairs
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(frame(spark, texts), crowd=crowd).collect()}
    fps = [simhash.fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert [got[i] for i in range(len(texts))] == unite(len(texts), pairs + near)


def test_near_copies_group_though_no_key_of_theirs_is_equal(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FARTHEST", -1)  # as if the keys, whose width grows with the corpus, found no pair
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = [w if i % 60 else "changed" for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(near), " ".join(words[::-1])]
    assert similar_pairs(texts) == [(1, 0)]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(frame(spark, texts)).collect()} == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize("crowd", [256, 20])
def test_a_crowd_of_near_copies_around_the_threshold(spark, crowd):
    """One text with edits at random: some pairs are just alike, some just not."""
    rng = random.Random(8)
    first = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        copy = list(first)
        for k in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5])):
            copy[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy[: rng.choice([150, 150, 140, 100])]))
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(100)) for _ in range(20)]
    pairs = similar_pairs(texts)
    assert 300 < len(pairs) < 6000
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(frame(spark, texts), crowd=crowd).collect()}
    assert [got[i] for i in range(len(texts))] == unite(len(texts), pairs)


def test_near_copies_of_other_ids(spark):
    same = spark.createDataFrame([(3, "a b c d e f"), (5, "a b c d e f"), (5, "other words"), (None, "a b c d e f")], "doc_id int, text string")
    got = sorted(map(tuple, simhash.near_duplicate_groups(same).collect()), key=str)
    assert got == [(3, 3), (5, 3), (5, 3), (None, None)]
    with pytest.raises(TypeError):
        simhash.near_duplicate_groups(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
