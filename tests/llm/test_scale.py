"""What only shows at scale, made to show on small inputs: hot keys, tables beyond the broadcast bound, long texts, ties."""

import hashlib
import itertools
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, common, html, jaccard, jpeg, langid, media, sharding, shingles, suffix_dedup

from .conftest import BASE, prose

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def near_rows(n, seed=5):
    """Texts of 60 words, up to three of which are changed."""
    rng = random.Random(seed)
    words, rows = prose(50, 60).split(), []
    for i in range(n):
        w = list(words)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    return rows


def labels_by_hand(rows, share=(80, 100), width=5):
    sets = shingles.shingle_sets([t for _, t in rows], width)
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if jaccard.linked(sets[a], sets[b], share)]
    label = [i for i, _ in rows]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return dict(zip((i for i, _ in rows), label))


@pytest.mark.parametrize("how", [{}, {"block": 8}, {"block": 8, "most": 0}, {"block": 8, "block_bytes": 4096, "most": 0}])
def test_near_duplicates_in_blocks(spark, how):
    """Whether candidates are verified outside or inside their blocks, all links count."""
    rows = near_rows(60)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame, "doc_id", "text", **how).collect()}
    assert got == labels_by_hand(rows)


def test_without_broadcasts(spark, monkeypatch):
    """Beyond the bound, tables are joined by shuffles, with the same results."""
    rows = near_rows(40) + [(i, prose(900, 30)) for i in range(100, 120)] + [(200 + i, prose(100 + i, 12) + " " + BASE[: 250 + i % 7] + prose(200 + i, 12)) for i in range(12)] + [(300, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", f'<div class="a">{prose(i, 30)}</div><div class="b">{prose(i, 20 + 20 * (i % 2))}</div>') for i in range(30)], "page_id int, url string, html string")

    def results():
        near = sorted(map(tuple, jaccard.near_duplicates(frame, "doc_id", "text").collect()))
        spans = sorted((r["doc_id"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(frame, "doc_id", "text").collect())
        return near, spans, sorted(map(tuple, html.extract(pages, "page_id", "url", "html").collect()))

    small = results()
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert results() == small
    assert {i: c for i, _, c in small[0]} == labels_by_hand([(i, t or "") for i, t in rows])


def test_dense_blocks_give_few_rows():
    """Sets just under the limit are candidates of each other by the thousand; a block gives at most one link a row."""
    rng = np.random.default_rng(8)
    core = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[core, rng.integers(0, 1 << 63, 8, dtype=np.uint64)]) for _ in range(200)]
    sets += [np.unique(np.r_[sets[0][:-1], np.uint64(1)])]
    n = len(sets)
    group = pa.table({
        "rep": np.arange(n), "n": [len(s) for s in sets], "component": np.arange(n), "hub": np.full(n, -1), "block": np.zeros(n, np.int64),
        "bits": pa.array([jaccard.bitmap(s) for s in sets], pa.binary()), "tokens": pa.array([s.tobytes() for s in sets], pa.binary()),
    })
    assert len(list(itertools.chain(*(at for _, at in jaccard._candidates(group, (80, 100), True))))) > 8 * n
    assert jaccard._cross_pairs(group, (80, 100), True, 8) is None
    found = jaccard._spanning(group, (80, 100), True)
    assert found.to_pylist() == [{"a": 0, "b": n - 1}]


def test_sketch_follows_documents():
    assert [jaccard.sketch_bits(n) for n in (0, 1 << 20, 1 << 22, 1 << 40)] == [18, 19, 21, 22]


def test_join_spread(spark, tmp_path):
    large = common.stored(spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 5 + [3, 4, 4])], "k int, i int"), "large")
    small = common.stored(spark.createDataFrame([(1, "a", 50), (2, "b", 5), (4, "d", 2)], "k int, v string, n int"), "small")
    assert Counter(map(tuple, common.join_spread(large, small, ["k"], "n", hot=2).collect())) == Counter(map(tuple, large.join(small, "k").collect()))


def test_numbers_within_keys(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 3 * F.lit(0)).alias("k"), F.lit("same").alias("x")).union(spark.createDataFrame([(5, "y")] * 3, "k long, x string"))
    got = common.number_within(common.placed(rows, "rows"), ["k"], "at").collect()
    assert sorted(r["at"] for r in got if r["k"] == 0) == list(range(5000)) and sorted(r["at"] for r in got if r["k"] == 5) == [0, 1, 2]


def test_equal_keys_get_slots(spark):
    rows = sharding.assign_shards(spark.createDataFrame([(None,)] * 500 + [("k",)] * 500, "id string"), "id", 4).collect()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_shared_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
    own = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs://x/y/"), sparkContext=context)
    assert common.shared_dir(own) == "hdfs://x/y"


def test_long_texts(spark):
    long = prose(77, 400_000)
    assert len(long) > 2 << 20
    sets = shingles.shingle_sets(["x", long, long + " end"], 4)
    words = long.split()
    assert len(sets[1]) == len({tuple(words[k : k + 4]) for k in range(len(words) - 3)}) and jaccard.linked(sets[1], sets[2], (85, 100))
    frame = spark.createDataFrame([(1, long), (2, "x" * 100), (3, long)], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in media.text_media(frame, "doc_id", "text").collect()}
    assert rows[1]["payload_sha256"] == hashlib.sha256(media.payload_of(long)[1]).hexdigest() == rows[3]["payload_sha256"]
    langs, probs = langid.train(spark.createDataFrame([(i, prose(i, 50), "ab"[i % 2]) for i in range(20)], "doc_id int, text string, lang string"), "doc_id", "text", "lang", PIECES)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame, "doc_id", "text", langs, probs, PIECES).collect()}
    assert got[1] == got[3] and set(got.values()) <= {"a", "b"}
    page = "<div class=x>" + "".join(f"<p>{long[k : k + 1000]}." for k in range(0, len(long), 1000)) + "</div><div class=y>short</div>"
    text = html.main_text(page, None)
    assert text.split("\n") == [" ".join(f"{long[k : k + 1000]}.".split()) for k in range(0, len(long), 1000)]


def test_ties_of_languages(spark):
    rows = [(i, "same words here", lang) for i in range(4) for lang in ("b", "a")]
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    langs, probs = langid.train(frame, "doc_id", "text", "lang", PIECES)
    got = langid.identify(frame, "doc_id", "text", langs, probs, PIECES).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("a", 0.5)}


def segmentations(word, probs, longest):
    if not word:
        return 1.0
    return sum(probs[word[:k]] * segmentations(word[k:], probs, longest) for k in range(1, min(longest, len(word)) + 1) if word[:k] in probs)


def test_scores_are_sums_over_segmentations():
    rng = random.Random(9)
    pieces = sorted({"".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(20)} | {"a", "b", "▁", "▁a", "▁ab"})
    probs = np.random.default_rng(2).random((len(pieces), 3))
    words = ["▁" + "".join(rng.choices("ab", k=k)) for k in (0, 1, 2, 3, 5, 9, 12, 1, 7)]
    lattice, table = langid.Lattice(pieces, probs, 0.0), langid.piece_table(pieces, probs)
    want = [[segmentations(w, dict(zip(pieces, probs[:, k])), 5) for k in range(3)] for w in words]
    assert np.allclose(np.exp(lattice.scores(words)), want)
    assert np.allclose(np.exp([langid.forward(w, table, 3, lattice.longest, 0.0) for w in words]), want)


def test_lattice_of_the_vocabulary():
    pieces = langid.vocabulary(PIECES)
    probs = np.random.default_rng(3).random((len(pieces), 2)) / len(pieces)
    words = ["▁" + w for w in [*prose(4, 300).split(), "ünïcöde", "漢字", "ⅷ", "a" * 23, "zzzzzz"]]
    lattice, table = langid.Lattice(pieces, probs, 1e-9), langid.piece_table(pieces, probs)
    assert np.allclose(lattice.scores(words), [langid.forward(w, table, 2, lattice.longest, 1e-9) for w in words], rtol=1e-12)


def foreign_jpeg(levels):
    """A colour file with half-size colours and no restart markers, of blocks without detail; levels: DC by block of Y."""
    down, across = len(levels) // 2, len(levels[0]) // 2
    bits = []

    def dc(value):
        size = abs(value).bit_length()
        bits.append(f"{size:04b}")
        if size:
            bits.append(f"{value if value > 0 else value + (1 << size) - 1:0{size}b}")
        bits.append("0")  # no detail

    last = [0, 0, 0]
    for y, x in itertools.product(range(down), range(across)):
        for c, value in [(0, levels[2 * y + i][2 * x + j]) for i in (0, 1) for j in (0, 1)] + [(1, 3), (2, -5)]:
            dc(value - last[c])
            last[c] = value
    raw = "".join(bits)
    raw += "1" * (-len(raw) % 8)
    data = bytes(int(raw[k : k + 8], 2) for k in range(0, len(raw), 8)).replace(b"\xff", b"\xff\x00")
    seg = lambda marker, body: b"\xff" + bytes([marker]) + (len(body) + 2).to_bytes(2, "big") + body
    frame = bytes([8]) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = bytes([0x00]) + bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12)) + bytes([0x10]) + bytes([1, *[0] * 15]) + b"\0"
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xDB, bytes([0] + [16] * 64)) + seg(0xC0, frame) + seg(0xC4, tables) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"


def test_foreign_jpeg():
    rng = random.Random(6)
    for across, down in ((2, 1), (3, 4)):
        levels = [[rng.randint(-63, 63) for _ in range(2 * across)] for _ in range(2 * down)]
        found = jpeg.decode([foreign_jpeg(levels), foreign_jpeg(levels)])[0]
        want = np.clip(np.array(levels) * 16 // 8 + 128, 0, 255).astype(np.uint8)
        assert (found.width, found.height, found.payload) == (16 * across, 16 * down, None)
        assert found.thumbnail_sha256 == hashlib.sha256(want.tobytes()).hexdigest()


LINE = "This line of the article has more than eighty characters in it, so that it is taken for a whole line. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="content share-row"><h1>T</h1><p>{LINE}</p></div>', f"T\n{LINE.strip()}"),
        (f'<nav>n</nav><div id="main" class="post tags-linux"><p>{LINE}</p></div><footer>f</footer>', LINE.strip()),
        ("<p>one<button>Buy</button>two", "onetwo"),
        (f'<article><p>{LINE}<span class="ad">buy</span></p><p class="cookie-notice">we use</p><p>end.</p></article>', f"{LINE.strip()}\nend."),
        (f'<form action="/"><div class="menu">m</div><div class="x"><p>{LINE}</p></div></form>', LINE.strip()),
        (f'<div class="widget"><p>{LINE}</p></div>', LINE.strip()),
        (f"<div title='a>b' data-x=it's><p>a < b &amp;&lt;c {LINE}</p><!-- <p>no</p> --><style>p > a</style></div>", f"a < b &<c {LINE.strip()}"),
        (f'<article><header><h1>T</h1></header><p>{LINE}</p><aside>x</aside><footer>tags</footer></article><div class="post-comments"><p>{LINE}{LINE}{LINE}</p></div>', f"T\n{LINE.strip()}"),
        ("", ""), (None, ""), ("<!-- only", ""), ("just text &copy;", "just text ©"), ("<ul><li>a.<li>b.</ul>", "a.\nb."),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page, None) == text


def test_consensus_changes_pages(spark):
    """On two pages of a host the comments, or a notice, are longer than the article; the other 18 tell where it is."""
    article, other = (lambda i: prose(i, 30) + ".", lambda i: prose(i, 90) + ".")
    rows = []
    for i in range(20):
        odd = "thread" if i == 3 else "hint" if i == 4 else None
        extra = f'<div class="{odd}"><p>{other(i)}</p></div>' if odd else f'<div class="thread"><p>{prose(i, 3)}.</p></div>'
        rows.append((i, f"http://one.example/{i}", f'<div class="story{i}"><p>{article(i)}</p></div>{extra}'))
    rows.append((20, "http://two.example/", f'<div class="thread"><p>{other(20)}</p></div>'))
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert html.best_path(rows[3][2]) == "/div.thread" and html.best_path(rows[4][2]) == "/div.hint" and html.best_path(rows[5][2]) == "/div.story#"
    got = {r["page_id"]: r["text"] for r in html.extract(pages, "page_id", "url", "html").collect()}
    assert got == {i: article(i) for i in range(20)} | {20: other(20)}
    alone = {r["page_id"]: r["text"] for r in html.extract(pages.where("page_id in (3, 4)"), "page_id", "url", "html").collect()}
    assert alone != {i: article(i) for i in (3, 4)}


def test_index_of_odd_vectors(spark):
    rows = [(1, [1.0]), (2, [2.0]), (2, [2.0]), (3, [1.0, 2.0]), (None, [1.0]), (4, [])]
    index = ann.build(spark.createDataFrame(rows, "i bigint, x array<double>"), "i", "x")
    queries = spark.createDataFrame([(1, [1.0]), (9, [5.0])], "id long, v array<double>")
    got = sorted(tuple(r) for r in ann.search(index, queries, 3, share=1.0).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 2, 1.0), (9, 1, 2, 3.0), (9, 2, 2, 3.0), (9, 3, 1, 4.0)]
