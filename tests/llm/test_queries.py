"""Each registered query against brute force over a small set of tables, and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, langid, media, mixing, quality
from marlstone.llm.queries import PIECES, QUERIES

from .conftest import document_rows

WORD = public_tokenizers.path("word_bpe_49k.json")


def collected(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def word_score(word, probs, floor=1e-9):
    """Log-probability of a word, by a plain sum over where its last piece starts."""
    sums = [1.0]
    for j in range(1, len(word) + 1):
        sums.append(sums[-1] * floor + sum(sums[i] * probs[word[i:j]] for i in range(j) if word[i:j] in probs))
    return math.log(sums[-1])


def language_by_hand(text, langs, tables):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return "und", 0.0
    total = [sum(word_score("▁" + w, t) for w in words) for t in tables]
    best = max(range(len(langs)), key=lambda k: (total[k], -k))
    return langs[best], 1 / sum(math.exp((t - total[best]) / len(words)) for t in total)


def test_op1(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(True)))
    langs, probs = langid.train(known, "doc_id", "text", "lang", PIECES)
    assert langs == ["en", "fr"]
    pieces = langid.vocabulary(PIECES)
    tables = [dict(zip(pieces, probs[:, k])) for k in range(len(langs))]
    rows = collected(spark, sf_dir, "op1_language_id")
    want = Counter()
    for i, text, *_ in document_rows():
        if text is not None and len(text) > 5000:
            text = text[:5000].rsplit(" ", 1)[0]
        want[i, held(i), language_by_hand(text, langs, tables)[0]] += 1
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"]) for r in rows) == want
    scores = {r["doc_id"]: r["score"] for r in rows}
    for i, text, *_ in document_rows():
        if text is None or len(text) < 400:
            assert math.isclose(scores[i], language_by_hand(text, langs, tables)[1], rel_tol=1e-9, abs_tol=1e-12)


def test_op1_learns_from_known_rows_alone(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wrong = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang"))
    docs.withColumns({"lang": wrong, "source": F.lit("s")}).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, collected(spark, str(tmp_path), "op1_language_id"))) == Counter(map(tuple, collected(spark, sf_dir, "op1_language_id")))


def test_op2(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer, want, sizes = Tokenizer.from_file(WORD), Counter(), 0
    for i, text, *_ in document_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        sizes += len(ids)
        for p in range(0, len(ids), 2048):
            want[i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())] += 1
    rows = collected(spark, sf_dir, "op2_best_fit_packing")
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(bins) <= -(-sizes // 2048) + 1


def repeated_bytes(texts, window=200):
    """For each text, which bytes lie in a string of `window` bytes that starts anywhere else too."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + window] for d in data for k in range(len(d) - window + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d), bool)
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                hit[k : k + window] = True
        out.append(hit)
    return data, out


def test_op3(spark, sf_dir):
    ids, texts = zip(*((r[0], r[1]) for r in document_rows()))
    want = Counter()
    for i, d, hit in zip(ids, *repeated_bytes(texts)):
        left = bytes(np.frombuffer(d, np.uint8)[~hit])
        want[i, len(d), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest()] += 1
    assert Counter(tuple(r) for r in collected(spark, sf_dir, "op3_suffix_dedup")) == want


def test_op4(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = document_rows()
    x = {n: quality.statistics(r[1]) for n, r in enumerate(rows)}
    own = {k: np.array([x[n] for n, r in enumerate(rows) if r[0] in labels and not held(r[0]) and labels[r[0]] == k]) for k in (0, 1)}
    model = quality.fit(quality.described(spark.createDataFrame([(n, r[1]) for n, r in enumerate(rows)], "n long, t string"), "n", "t").join(spark.createDataFrame([(n, labels[r[0]]) for n, r in enumerate(rows) if r[0] in labels and not held(r[0])], "n long, quality int"), "n"), "quality")
    count = {k: len(v) for k, v in own.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in own.items()}
    pooled = sum(cov[k] * count[k] for k in cov) / sum(count.values())
    logs = {}
    for k in (0, 1):
        c = 0.9 * cov[k] + 0.1 * pooled
        c = 0.98 * c + 0.02 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(c))
        inverse, mean = np.linalg.inv(c), own[k].mean(0)
        logs[k] = {n: math.log(count[k] / sum(count.values())) - 0.5 * (v - mean) @ inverse @ (v - mean) - 0.5 * np.linalg.slogdet(c)[1] for n, v in x.items()}
    want = {n: 1 / (1 + math.exp(min(60, max(-60, logs[0][n] - logs[1][n])))) for n in x}
    assert np.allclose(model.scores(np.array([x[n] for n in x])), [want[n] for n in x], atol=1e-6)
    got = collected(spark, sf_dir, "op4_quality")
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((r[0], held(r[0])) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_op5(spark, sf_dir):
    rows = document_rows()
    tokens = {(r[0], r[1], r[3]): len((r[1] or "").split()) for r in rows}
    by_source = Counter()
    for r in rows:
        by_source[r[3]] += tokens[r[0], r[1], r[3]]
    total = sum(by_source.values())

    def at(t):
        raw = {s: (n / total) ** t for s, n in by_source.items()}
        w = {s: v / sum(raw.values()) for s, v in raw.items()}
        budget = max(by_source[s] / w[s] for s in w)
        return w, {s: budget * w[s] / by_source[s] for s in w}

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if max(at(mid)[1].values()) > 4 else (low, mid)
    weights, repeats = at(high if max(at(0.0)[1].values()) > 4 else 0.0)
    got = collected(spark, sf_dir, "op5_mixing")
    for s, n in by_source.items():
        own = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["weight"], weights[s], rel_tol=1e-6) for r in own)
        full = math.floor(repeats[s] + 1e-6)
        for e in range(full):
            uses = sorted((r for r in own if r["epoch"] == e), key=lambda r: r["position"])
            assert [r["position"] for r in uses] == list(range(len(uses)))
            assert Counter((r["doc_id"], r["tokens"]) for r in uses) == Counter((r[0], tokens[r[0], r[1], s]) for r in rows if r[3] == s)
        last = sorted((r for r in own if r["epoch"] == full), key=lambda r: r["position"])
        rest = (repeats[s] - full) * n
        if rest > 1e-3 * n:  # the last epoch stops with the document that reaches the budget
            used = sum(r["tokens"] for r in last)
            assert [r["position"] for r in last] == list(range(len(last)))
            assert used >= rest - 1e-6 and used - last[-1]["tokens"] < rest + 1e-6
        assert not [r for r in own if r["epoch"] > full]


def test_op6(spark, sf_dir):
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in collected(spark, sf_dir, "op6_html_extraction"))
    one = "T & U\none two\nthree"
    assert got == Counter({(1, "http://h/1", one, len(one)): 1, (2, "http://h/2", "", 0): 2, (3, None, "loose", 5): 1, (4, "http://h/4", "deep. text", 10): 1, (None, "no url", "", 0): 1})


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def components_by_hand(rows, width, share):
    """(id, text) -> smallest id that links reach; rows without an id are alone."""
    sets = [shingles(t, width) for _, t in rows]
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if label[a] is not None and label[b] is not None and sets[a] and sets[b] and label[b] < label[a] and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    return sets, label


def test_op7(spark, sf_dir):
    rows = [(r[0], r[1]) for r in document_rows()]
    sets, label = components_by_hand(rows, 4, (85, 100))
    assert Counter(tuple(r) for r in collected(spark, sf_dir, "op7_ngram_jaccard")) == Counter((i, len(s), c) for (i, _), s, c in zip(rows, sets, label))


def test_op8(spark, sf_dir):
    got = collected(spark, sf_dir, "op8_media")
    want = Counter()
    for i, text, *_ in document_rows():
        n, payload = media.payload_of(text)
        assert len(payload) % 192 == 0 and payload[:n] == (text or "").encode() and not payload[n:].strip(b" ") and payload
        want[i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert len({(r["payload_sha256"], r["media_sha256"], r["media_bytes"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_op9(spark, sf_dir):
    got, want = collected(spark, sf_dir, "op9_sharding"), Counter()
    for i, text, *_ in document_rows():
        data = (text or "").encode()
        key = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16)
        want[i, len(data) + 1, zlib.crc32(data), "key", jump(key, 16), jump(key, 17)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def near_by_hand(rows, q, k):
    d = {i: math.dist(v, rows[q]) for i, v in rows.items() if i != q}
    return sorted(d, key=lambda i: (d[i], i))[:k], d


def test_op10(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = {r["vec_id"]: r["embedding"] for r in found if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"])}
    got, hits = {}, 0
    for r in collected(spark, sf_dir, "op10_nearest"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in rows if i % 100 == 0}
    for q, near in got.items():
        near.sort()
        best, d = near_by_hand(rows, q, 10)
        assert [n for n, _, _ in near] == list(range(1, 11)) and all(math.isclose(s, d[i], rel_tol=1e-12) for _, i, s in near)
        assert [(s, i) for _, i, s in near] == sorted((s, i) for _, i, s in near)
        hits += len(set(best) & {i for _, i, _ in near})
    assert hits >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op10_visits_a_part(spark, sf):
    """With production parameters a query sees little more than half of the rows, and finds at least 0.9 of the nearest."""
    path = f"/root/testdata/{sf}"
    index = ann.build(spark.read.parquet(f"{path}/embeddings.parquet"), "vec_id", "embedding")
    rows = {r["id"]: np.array(r["v"]) for r in index.rows.collect()}
    enough = int(0.5 * len(rows)) + 11
    for q in (i for i in rows if i % 100 == 0):
        cells = ann.visit(rows[q], index, enough)
        assert index.sizes[cells].sum() < 0.6 * len(rows) and len(cells) < np.count_nonzero(index.sizes)
    ids = np.array(sorted(rows))
    x, hits, got = np.stack([rows[i] for i in ids]), 0, {}
    for r in QUERIES["op10_nearest"](spark, path).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, near in got.items():
        d = np.sqrt(((x - rows[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(near & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


def test_mixing_targets():
    tokens = {"a": 1000, "b": 100, "c": 10, "none": 0}
    for target in (0.05, 0.3, 0.9, math.log(3)):
        m = mixing.temperature(tokens, entropy=target)
        assert math.isclose(-sum(w * math.log(w) for w in m.weights.values() if w), target, rel_tol=1e-6)
    assert mixing.temperature(tokens, entropy=0.05).exponent > 1 and m.weights["none"] == 0
    m = mixing.temperature(tokens, max_repeats=4)
    assert math.isclose(max(m.repeats.values()), 4, rel_tol=1e-6) and math.isclose(m.repeats["a"], 1)
    for wrong in ({"entropy": 1.2}, {"max_repeats": 2, "budget": 5000}, {"entropy": 0.5, "max_repeats": 2}):
        with pytest.raises(ValueError):
            mixing.temperature(tokens, **wrong)
    with pytest.raises(ValueError):
        mixing.temperature({"a": 5, "b": 5}, entropy=0.1)
    assert mixing.temperature({}, max_repeats=4).weights == {} and mixing.temperature({"x": 0}, entropy=0.1).repeats == {"x": 1.0}


def test_mixing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used = mixing.mix(docs, "doc_id", "text", "source", max_repeats=2.0, keep=("tokens", "rep"))
    assert used.columns == ["doc_id", "source", "tokens", "epoch", "position", "weight", "tokens_in", "rep"]
    assert used.where("tokens_in <> 'clash' or rep <> 'clash'").count() == 0
