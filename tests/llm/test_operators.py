"""Operators for training data against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import ann, anchors, graph, html, jaccard, jpeg, langid, media, mixing, packing, quality, sharding, shingles, suffix_dedup
from marlstone.llm.gsaca import suffix_array

WORD, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, id string, rep string, key string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeiou", k=rng.randint(2, 7))) for _ in range(n))


BASE = prose(1, 120)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("a", "o", 2), "en", "a"), (4, None, "en", "b"), (5, "", None, None), (6, "x", "en", "b"), (7, prose(2, 60) + " " + BASE[:300] + " é" + prose(3, 60), "fr", "b"), (8, "12 !! %", "fr", "c"),
    (9, prose(4, 20_000), "fr", "c"), (9, prose(4, 20_000), "fr", "c"), (None, "lone words stay here", "fr", "c"), (11, "ab " * 400, None, "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(x):
    x = [*x, 0]
    assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_dedup_is_exact(spark, docs, empty):
    seen = Counter(w for _, t, *_ in ROWS for b in [(t or "").encode()] for w in {i: b[i : i + 200] for i in range(len(b) - 199)}.values())
    got = {(r["doc_id"], r["n_bytes"]): r for r in suffix_dedup.deduplicate(docs, "doc_id", "text").collect()}
    for i, t, *_ in ROWS:
        data = (t or "").encode()
        hit = np.zeros(len(data), bool)
        for k in range(len(data) - 199):
            if seen[data[k : k + 200]] > 1:
                hit[k : k + 200] = True
        row = got[i, len(data)]
        kept = bytes(np.frombuffer(data, np.uint8)[~hit])
        assert (row["n_removed"], row["kept_sha256"]) == (int(hit.sum()), hashlib.sha256(kept).hexdigest())
        assert row["n_spans"] == int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
    assert suffix_dedup.deduplicate(empty, "doc_id", "text").count() == 0


def test_suffix_dedup_hot_grams(spark):
    rows = [(i, prose(100 + i, 12) + " " + BASE[: 250 + i % 7] + prose(200 + i, 12)) for i in range(12)]
    texts = spark.createDataFrame(rows, "key bigint, text string")
    plain = {r["key"]: suffix_dedup.merged([tuple(s) for s in r["spans"]]) for r in suffix_dedup.repeated_spans(texts).collect()}
    hot = {r["key"]: suffix_dedup.merged([tuple(s) for s in r["spans"]]) for r in suffix_dedup.repeated_spans(texts, hot=2).collect()}
    assert plain == hot and len(plain) == 12


def test_suffix_dedup_hot_grams_differ(spark):
    """Two hot grams between equal surroundings make different strings."""
    rng = random.Random(7)
    near, far, other = [tuple("".join(rng.choices("abcdefgh", k=100)) for _ in range(2)) for _ in range(3)]

    def anchor():
        while True:
            gram = "".join(rng.choices("abcdefgh", k=100))
            if all(100 in anchors.find([(a + gram + b).encode()], 200, 100).at for a, b in (near, far, other)):
                return gram

    one, two = anchor(), anchor()
    rows = list(enumerate([near[0] + one + near[1], far[0] + one + far[1], near[0] + two + near[1], other[0] + two + other[1], other[0] + two + near[0]]))
    seen = Counter(t[k : k + 200] for _, t in rows for k in range(len(t) - 199))
    want = {i: {p for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1 for p in range(k, k + 200)} for i, t in rows}
    texts = spark.createDataFrame(rows, "key bigint, text string")
    for hot in (4096, 1):
        got = {r["key"]: {p for s in r["spans"] for p in range(max(0, s["begin"]), s["end"])} for r in suffix_dedup.repeated_spans(texts, hot=hot).collect()}
        assert got == {i: p for i, p in want.items() if p} and set(got) == {3, 4}


def test_anchors_agree_in_parts():
    data = [prose(9, 2000).encode(), b"", b"a" * 3000, prose(10, 40).encode()]
    one, parts = anchors.find(data, 200, 100), anchors.find(data, 200, 100, part=1500)
    assert sorted(zip(one.text.tolist(), one.at.tolist(), one.gram.tolist(), one.context.tolist())) == sorted(zip(parts.text.tolist(), parts.at.tolist(), parts.gram.tolist(), parts.context.tolist()))


@pytest.mark.parametrize("frequent", [0, 10**9])
def test_linked_sets_share_a_signature(frequent):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, 1 << jaccard.SKETCH_BITS)
    for _ in range(400):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, max(1, n // 12) + 1))):
            b[rng.integers(len(b))] = rng.integers(0, 1 << 63, dtype=np.uint64)
        b = np.unique(b[: len(b) - int(rng.integers(0, 2))]) if len(b) > 4 else b
        if not np.array_equal(a, b) and jaccard.linked(a, b, (85, 100)):
            assert np.isin(jaccard.signatures(a, counts, frequent, (85, 100)), jaccard.signatures(b, counts, frequent, (85, 100))).any()
            size = min(len(jaccard.bitmap(a)), len(jaccard.bitmap(b)))
            differ = int(np.bitwise_count(jaccard.folded(jaccard.bitmap(a), size) ^ jaccard.folded(jaccard.bitmap(b), size)).sum())
            assert differ <= jaccard.most_different(len(a) + len(b), (85, 100))


def test_near_duplicates(spark, docs, empty):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.near_duplicates(docs, "doc_id", "text", 4, (85, 100)).collect()}
    sets = shingles.shingle_sets([t for _, t, *_ in ROWS], 4)
    for (i, *_), s in zip(ROWS, sets):
        reach = [j for (j, *_), o in zip(ROWS, sets) if j is not None and (j == i or len(s) and len(o) and jaccard.linked(s, o, (85, 100)))]
        assert got[i, len(s)] == (min(reach) if i is not None else None)
    assert jaccard.near_duplicates(empty, "doc_id", "text").count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 50: 40}


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    rows = packing.pack(docs, "doc_id", "text", WORD, 64).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 64):
            want[i, p // 64, p, len(ids[p : p + 64]), zlib.crc32(np.array(ids[p : p + 64], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty, "doc_id", "text", WORD).count() == 0


def test_token_ids_of_odd_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    texts = ["don't I'LL <|endoftext|>x a<|startoftext|>", "ΑΣ. İI İstanbul", "é ,,. a.b, 12ab", "\x1c\x85 z", "##tag## (x) \"q\"", None, "%%% ***"]
    for t, ids in zip(texts, packing.token_ids(texts, WORD)):
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]


def test_language(spark, docs, empty):
    train = spark.createDataFrame([(i, text, lang) for i in range(30) for lang, text in (("en", "the cat and the dog went with that"), ("fr", "le chat et les chiens sont avec nous"))], "doc_id bigint, text string, lang string")
    langs, probs = langid.train(train, "doc_id", "text", "lang", PIECES)
    assert langs == ["en", "fr"]
    asked = spark.createDataFrame([(1, "the dogs and cats"), (2, "les chats et le chien"), (3, None), (4, "12 !"), (5, "ab" * 5000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(asked, "doc_id", "text", langs, probs, PIECES).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("en", "fr", "und", "und") and got[5] in langs
    assert langid.identify(docs, "doc_id", "text", *langid.train(empty, "doc_id", "text", "lang", PIECES), PIECES).where("lang_pred <> 'und'").count() == 0


def test_forward_sums_all_segmentations():
    probs = {"a": (0.2, 0.1), "b": (0.3, 0.1), "ab": (0.1, 0.4)}
    got = np.exp(langid.forward("ab", probs, 2, 2, 0.0))
    assert np.allclose(got, [0.2 * 0.3 + 0.1, 0.1 * 0.1 + 0.4])


def test_pieces_of_long_words():
    """Whole runs of letters count, beyond what a float can hold and where letters are no pieces."""
    pieces = ["▁", "a", "ab", "b", "c"]
    for word in ("ab" * 300 + "c", "é" * 200 + "abc", "abc" + "é" * 200):
        w, p, floor = "▁" + word, Fraction(1, 5), Fraction(1e-9)
        arcs = [(i, j, pieces.index(w[i:j])) for j in range(1, len(w) + 1) for i in range(max(0, j - 2), j) if w[i:j] in pieces]
        fwd, bwd = [Fraction(1)] + [Fraction(0)] * len(w), [Fraction(0)] * len(w) + [Fraction(1)]
        for j in range(1, len(w) + 1):
            fwd[j] = fwd[j - 1] * floor + sum(fwd[i] * p for i, k, _ in arcs if k == j)
        for i in range(len(w) - 1, -1, -1):
            bwd[i] = bwd[i + 1] * floor + sum(bwd[j] * p for k, j, _ in arcs if k == i)
        soft = [0.05 + float(sum(fwd[i] * p * bwd[j] for i, j, k in arcs if k == own) / fwd[-1]) for own in range(5)]
        assert np.allclose(langid.fit_pieces({word: 1}, pieces, 1, 0.05, 2), np.array(soft) / sum(soft))
    assert "▁distinguished" in langid.vocabulary(PIECES)


def test_quality(spark, docs, empty):
    rows = [(i, prose(i, 80) if i % 2 else " | ".join(prose(i, 20).split()), i % 2) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    seen = quality.described(frame, "doc_id", "text")
    model = quality.fit(seen.join(frame.select("doc_id", "quality"), "doc_id"), "quality")
    got = {r["doc_id"]: r["score"] for r in quality.score(seen, "doc_id", model).collect()}
    assert all((got[i] >= 0.7) == (i % 2 == 1) for i in range(80))
    all_docs = quality.score(quality.described(docs, "doc_id", "text"), "doc_id", model)
    assert all_docs.count() == len(ROWS) and all_docs.where("score between 0 and 1").count() == len(ROWS)
    assert quality.score(quality.described(empty, "doc_id", "text"), "doc_id", None).count() == 0


def test_mixing(spark, docs, empty):
    m = mixing.temperature({"a": 1000, "b": 10}, max_repeats=4)
    assert 3.9 < m.repeats["b"] <= 4.0001 and abs(m.repeats["a"] - 1) < 1e-6
    rows = mixing.mix(docs, "doc_id", "text", "source", max_repeats=3).collect()
    assert Counter((r["doc_id"], r["tokens"]) for r in rows if r["epoch"] == 0) == Counter((i, len((t or "").split())) for i, t, *_ in ROWS)
    for r in {(r["source"], r["epoch"]) for r in rows}:
        places = sorted(x["position"] for x in rows if (x["source"], x["epoch"]) == r)
        assert places == list(range(len(places))) and r[1] <= 3
    assert mixing.mix(empty, "doc_id", "text", "source").count() == 0


def test_sharding(spark, docs, empty):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    rows = sharding.assign_shards(docs, "doc_id", 16, "text").collect()
    for r in rows:
        key = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:16], 16)
        assert (r["shard"], r["grown_shard"]) == (jump(key, 16), jump(key, 17))
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, *_ in ROWS)
    assert sharding.assign_shards(empty, "doc_id", 16, "text").count() == 0


@settings(deadline=None, max_examples=40)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=4))
def test_jpeg_round_trip(parts):
    payloads = [p.ljust(max(192, -(-len(p) // 192) * 192), b" ") for p in parts]
    found = jpeg.decode(jpeg.encode(payloads))
    assert [m.payload for m in found] == payloads


def test_media(spark, docs, empty):
    rows = media.text_media(docs, "doc_id", "text").collect()
    assert Counter((r["doc_id"], r["payload_sha256"]) for r in rows) == Counter((i, hashlib.sha256(media.payload_of(t)[1]).hexdigest()) for i, t, *_ in ROWS)
    assert media.text_media(empty, "doc_id", "text").count() == 0


def test_html(spark):
    page = '<html><body><nav><a href="/">menu</a></nav><div class="ad">buy</div><article><h1>T &amp; U</h1><p>one\n  two<p>three<script>x="</p>"</script></article><div class="comments">me too</div><footer>&copy;</footer>'
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, "<p>loose"), (4, "http://h/4", "<div>" * 3000 + "deep. text")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(frame, "page_id", "url", "html").collect()}
    assert got == {1: "T & U\none two\nthree", 2: "", 3: "loose", 4: "deep. text"}
    assert html.extract(frame.limit(0), "page_id", "url", "html").count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1200)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0])]
    rows[5] = (5, rows[7][1])
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    index = ann.build(frame, "vec_id", "embedding", cell_rows=12)
    x = np.array([v for _, v in rows[:1200]])
    hits = 0
    for r in ann.search(index, index.rows.where("id % 100 = 0").select("id", "v"), 10, block_rows=100, query_rows=5).collect():
        d = np.sqrt(((x - x[r["query_id"]]) ** 2).sum(1))
        assert r["score"] == d[r["vec_id"]] and r["vec_id"] != r["query_id"]
        d[r["query_id"]] = np.inf
        hits += r["vec_id"] in np.lexsort((np.arange(1200), d))[:10]
    assert hits >= 0.9 * 120
    assert ann.build(frame.limit(0), "vec_id", "embedding") is None
