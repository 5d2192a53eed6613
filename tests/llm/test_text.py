"""Tokenizers, packing and page extraction."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from argusframe.llm import html_text, packing, sentencepieces, token_counts

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

TEXT = st.text(st.sampled_from(list("aB  \n\t'sİΣéÀ漢😀\x85\xa0\x1c~thein.,12²½ǅ  ́ﬁʰ▁<|>")), max_size=60)
ODD = [None, "", " ", "<|endoftext|>", "a<|endoftext|> b", "<s></s>", "▁", "  a  b ", "don't I'LL", "x" * 3000, "\0", "a" * 33 + "é" * 40]


@pytest.fixture(scope="module")
def byte_bpe():
    path = P.path("byte_bpe_50k.json")
    table = token_counts.MergeTable(path)
    return token_counts.Counter(table, table.single_tokens()), tokenizers.Tokenizer.from_file(path)


def test_whole_tokens_are_proved(byte_bpe):
    counter, library = byte_bpe
    assert len(counter.proved) > 49_000
    some = random.Random(0).sample(sorted(counter.proved), 500)
    assert all(len(e.ids) == 1 for e in library.encode_batch(some, add_special_tokens=False))


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_counts_equal_the_library(byte_bpe, text):
    counter, library = byte_bpe
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_long_merges_equal_short_ones(byte_bpe):
    table, rng = byte_bpe[0].table, random.Random(1)
    for _ in range(200):
        parts = [rng.choice("theinaors") for _ in range(rng.randint(1, 30))]
        assert table._merge_long(list(parts)) == table.merge(list(parts))


def test_count_frame(spark, byte_bpe):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "a b", 2)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.count_tokens(df, P.path("byte_bpe_50k.json"), limit=3).collect()}
    for i, t in enumerate(ODD):
        n = len(byte_bpe[1].encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 3)
    assert got[None].n_tokens == 2
    assert token_counts.count_tokens(df.limit(0), P.path("byte_bpe_50k.json")).collect() == []


@pytest.fixture(scope="module")
def pieces():
    path = P.path("piece_bpe_32k.model")
    return sentencepieces.SpanEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_pieces_equal_the_library_and_cover_the_text(pieces, text):
    mine, library = pieces
    ids = library.encode(text, add_bos=True, add_eos=True)
    e = mine.encode(text)
    assert e.ids == ids and mine.decode(ids) == library.decode(ids)
    raw = text.encode()
    assert b"".join(raw[a:z] for a, z in zip(e.begins, e.ends)) == raw
    n, packed, decoded, ends = mine.digests(text)
    assert ends.tolist() == e.ends
    assert n == len(ids)
    assert packed == hashlib.sha256(struct.pack(f"<{n}I", *ids)).hexdigest() and decoded == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=10))
@settings(max_examples=300, deadline=None)
def test_decoding_any_ids(pieces, ids):
    assert pieces[0].decode(ids) == pieces[1].decode(ids)


def test_character_map_takes_the_longest_prefix(pieces):
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(rule.serialized_model_proto())
    import copy

    enc = copy.copy(pieces[0])
    enc.map = sentencepieces.CharacterMap(spec.normalizer_spec.precompiled_charsmap)
    for text in ("ﬁ ① ｶﾞ é é ½ Å", "a　b", "  x  "):
        norm, origin = enc.normalise(text)
        want = rule.normalize(text)
        assert norm.strip("▁") == want.strip("▁")
        assert len(origin) == len(norm.encode()) + 1 and origin == sorted(origin)


def test_piece_frames(spark, pieces):
    path = P.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    library = pieces[1]
    spans = sentencepieces.encode_spans(df, path)
    for r in spans.collect():
        assert r.ids == library.encode(ODD[r.doc_id] or "", add_bos=True, add_eos=True)
    back = {r.doc_id: r.text for r in sentencepieces.decode_ids(spans, path).collect()}
    assert back == {i: library.decode(library.encode(t or "")) for i, t in enumerate(ODD)}
    ends = {r.doc_id: r.ends for r in spans.collect()}
    for r in sentencepieces.round_trip_digests(df, path).collect():
        ids = library.encode(ODD[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and r.ends == ends[r.doc_id]


@pytest.mark.parametrize("text", [t for t in ODD if t] + ["▁ a▁▁b ▁", "  é\U0001f600 x ", "tab\there\n\n new", "ab" * 500])
def test_spans_equal_the_library(pieces, text):
    found = pieces[1].encode(text, return_type="proto").pieces
    want = [(p.id, p.begin, p.end) for p in found]
    e = pieces[0].encode(text, bos=False, eos=False)
    assert list(zip(e.ids, e.begins, e.ends)) == want


def test_digests_of_nothing(spark):
    path = P.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, ids string")
    assert sentencepieces.round_trip_digests(df.limit(0), path).collect() == []


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(P.path("word_bpe_49k.json"))


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_word_ids_equal_the_library(words, text):
    assert words.packed(text) == words.whole(text)


def test_every_plain_character(words):
    for c in map(chr, range(1, words.LAST + 2)):
        for t in (f"a{c}b", f"{c}{c} 1{c}"):
            assert words.packed(t) == words.whole(t)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_plans_place_everything_once(hist, groups):
    bins = packing.plan_bins(hist, 64, groups)
    seen = defaultdict(int)
    for b in bins:
        at = 0
        for length, n, offset in b.items:
            assert offset == at
            at += n * length
            seen[length] += n * b.count
        assert at == 64 - b.free <= 64
    assert dict(seen) == hist
    total = sum(k * n for k, n in hist.items())
    assert sum(b.count for b in bins) <= 2 * -(-total // 64) + 1


def test_plan_is_close_to_the_bound_and_bounded_in_size():
    rng = np.random.default_rng(0)
    hist = dict(zip(*(a.tolist() for a in np.unique(np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2048), return_counts=True))))
    for times in (1, 1000):
        h = {k: n * times for k, n in hist.items()}
        bins = packing.plan_bins(h, 2048)
        least = -(-sum(k * n for k, n in h.items()) // 2048)
        assert sum(b.count for b in bins) <= 1.005 * least + 1
        assert len(packing.plan_rows(bins)) < 12_000


def test_packed_frame(spark, words):
    texts = [*ODD, *["w " * n for n in (1, 2, 3, 10, 50, 90, 200)] * 5]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "a", 1)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack_documents(df, P.path("word_bpe_49k.json"), capacity=32).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        data = words.whole(t or "") + b"\0\0\0\0"
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and [r.start for r in parts] == list(range(0, len(data) // 4, 32))
        assert [r.length for r in parts] == [min(32, len(data) // 4 - r.start) for r in parts]
        assert all(r.ids_crc32 == zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) for r in parts)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 32
    assert packing.pack_documents(df.limit(0), P.path("word_bpe_49k.json")).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li>Home<li>More</ul></nav><div class="cookie-notice">We use <b>cookies</b></div><header>Site</header>
<!-- a comment <p>no</p> --><article class="post"><header><h1>Title &amp; more</h1><span>by x</span></header><p>One
  two&nbsp;<i>th</i>ree<br>four <p>Five &lt;six&gt;<div class="ad">Buy</div><form><p>q</p></form><section id="comments"><p>nice!</p></section>
<ul><li>a<li>b</ul></article><aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_page_blocks():
    lines = html_text.page_lines(PAGE)
    assert [t for t, inside in lines if inside] == ["Title & more", "One two three four", "Five <six>", "a", "b"]
    assert [t for t, inside in lines if not inside] == []


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<script>x", "<!-- x", "<article><p>a &am", "</p></div>", "<p class='x>y", "a < b & c"])
def test_broken_pages_do_not_fail(html):
    html_text.page_lines(html)


def test_broken_pages_keep_their_text():
    assert html_text.page_lines("<article><p>a &am") == [("a &am", True)]
    assert html_text.page_lines("<p>a<p>b") == [("a", False), ("b", False)]


@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_lines_are_a_longest_common_subsequence(a, b):
    got = html_text.common_lines(a, b)
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            size[i + 1][j + 1] = size[i][j] + 1 if a[i] == b[j] else max(size[i][j + 1], size[i + 1][j])
    assert len(got) == size[-1][-1] and got == sorted(set(got))
    it = iter(b)
    assert all(any(a[i] == y for y in it) for i in got)


@pytest.mark.parametrize("parts", [1, 7])
def test_template_lines_go(spark, parts):
    def page(i):
        section = "a" if i % 2 else "b"
        return f"<body><div>Menu of {section}</div><div>unique {i}</div><p>text {i}</p><div>The end</div></body>"

    rows = [(i, f"http://h{i % 3}.x/{'a' if i % 2 else 'b'}/{i}", page(i), "z") for i in range(24)]
    rows += [(None, None, None, "z"), (50, "u", ""), (51, "http://only.x/", page(51), "z"), (0, rows[0][1], rows[0][2], "z")]
    df = spark.createDataFrame([(*r, 1)[:5] if len(r) == 4 else (*r, "z", 1) for r in rows], "page_id long, url string, html string, lines string, host int").repartition(3)
    got = html_text.extract_text(df, parts=parts).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for i in range(24):
        assert text[i] in (f"unique {i}\ntext {i}", f"Menu of b\nunique {i}\ntext {i}\nThe end" if i == 0 else None)
    assert text[None] == "" and text[50] == "" and text[51].startswith("Menu of a")  # nothing to compare with
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_text(df.limit(0)).collect() == []


def test_lines_beside_an_article_stay_unless_shared(spark):
    def page(i):
        return f"<div>Site</div><div>Tools</div><div>story {i}</div><article>teaser</article><div>The end</div>"

    def framed(i):
        return f"<div>Site</div><div>Tools</div><article>teaser<p>story {i}</article><div>The end</div>"

    rows = [(i, f"http://h.x/a/{i}", page(i)) for i in range(6)] + [(i, f"http://g.x/a/{i}", framed(i)) for i in range(6, 12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    text = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert text == {i: f"story {i}\nteaser" if i < 6 else f"teaser\nstory {i}" for i in range(12)}


def brute_texts(rows):
    """Each page against its nearest neighbour by URL path, page by page."""
    import re

    found = {}
    for i, url, html in rows:
        m = re.match(r"(?:\w+://([^/?#]*))?([^?#]*)", url or "")
        lines = html_text.page_lines(html)
        found.setdefault((m[1] or "").lower(), {}).setdefault(tuple(lines), []).append((m[2], i))
    out = {}
    for pages in found.values():
        order = sorted((min(where), lines) for lines, where in pages.items())
        for k, ((path, _), lines) in enumerate(order):
            best, shared = -1, []
            outside = [t for t, main in lines if not main]
            for (other, _), theirs in order[k + 1 : k + 2] + order[max(0, k - 1) : k]:
                alike = 0
                while path.split("/")[alike : alike + 1] == other.split("/")[alike : alike + 1] != []:
                    alike += 1
                if alike > best:
                    best, shared = alike, html_text.common_lines(outside, [t for t, main in theirs if not main])
            keep = [t for n, t in enumerate(outside) if n not in set(shared)]
            text, at = [], 0
            for t, main in lines:
                if main:
                    text.append(t)
                else:
                    if at not in shared:
                        text.append(t)
                    at += 1
            assert [t for t in text if t in keep] or not keep
            for _, i in pages[lines]:
                out[i] = "\n".join(text)
    return out


def test_pages_against_brute_force(spark):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(120):
        host, section = f"h{rng.randrange(4)}.x", rng.choice("abc")
        top = "".join(f"<p>top {k} of {host}</p>" for k in range(rng.randrange(3)))
        end = "".join(f"<div>end {k} of {section}</div>" for k in range(rng.randrange(4)))
        body = "".join(f"<p>line {rng.randrange(400)}</p>" for _ in range(rng.randrange(6)))
        html = top + (f"<article>{body}</article>" if rng.random() < 0.4 else body) + end
        rows.append((i, f"https://{host}/{section}/{rng.randrange(30)}?q={i}" if i % 17 else None, html if i % 23 else None))
    rows += [(200 + i, f"https://h0.x/a/{i}", rows[5][2]) for i in range(20)]  # copies
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html_text.extract_text(df, parts=3).collect()}
    want = brute_texts(rows)
    assert got == want
    plain = {i: "\n".join(t for t, _ in html_text.page_lines(h)) for i, _, h in rows}
    assert sum(got[i] != plain[i] for i in got) > 40  # differencing decides


def test_long_and_deep_pages_end_soon():
    import time

    began = time.time()
    deep = "<div><b>" * 50_000 + "x" + "</i>" * 50_000
    assert html_text.page_lines(deep) == [("x", False)]
    assert len(html_text.page_lines("<p>word word" * 100_000)) == 100_000
    assert html_text.page_lines("<header><b>site</b><h1>Title <i>here</i></h1>rest</header><article><header>by me<h2>Sub</h2></header>text</article>") == [("Sub", True), ("text", True)]
    assert time.time() - began < 30


def test_texts_of_many_megabytes(spark, words, pieces):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdéf") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(vocab) for _ in range(600_000))
    assert len(text.encode()) > 3_000_000
    df = spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string")
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, P.path("byte_bpe_50k.json")).collect()}
    assert got[1] == len(library.encode(text, add_special_tokens=False).ids)
    n = len(words.whole(text)) // 4 + 1
    rows = [r for r in packing.pack_documents(df, P.path("word_bpe_49k.json")).collect() if r.doc_id == 1]
    assert sum(r.length for r in rows) == n and max(r.length for r in rows) == 2048 and len(rows) == -(-n // 2048)
    one = next(r for r in sentencepieces.round_trip_digests(df, P.path("piece_bpe_32k.model")).collect() if r.doc_id == 1)
    assert one.n_tokens == len(pieces[1].encode(text)) + 2 and one.ends[-1] == len(text.encode())
