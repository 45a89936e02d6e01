"""The stages of the corpus pipeline against brute force, and on nulls, repeated rows and empty tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from marlstone.llm import langid
from marlstone.llm.queries import PIECES

from .conftest import DOCUMENTS, document_rows, prose
from .test_queries import components_by_hand, language_by_hand, repeated_bytes

STAGES = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], DOCUMENTS)


def of(df):
    return [tuple(r) for r in df.collect()]


def base_rows():
    return [r[:5] for r in document_rows()]


def test_language_id(spark):
    rows = [r for r in base_rows() if r[1] is None or len(r[1]) < 2000]
    docs = frame(spark, rows)
    langs, probs = langid.train(docs, "doc_id", "text", "lang", PIECES)
    pieces = langid.vocabulary(PIECES)
    tables = [dict(zip(pieces, probs[:, k])) for k in range(len(langs))]
    want = Counter()
    for i, text, _, source, n in rows:
        lang, _ = language_by_hand(text, langs, tables)
        if lang != "und":
            want[i, text, lang, source, n] += 1
    assert Counter(of(STAGES["language_id"](spark, docs, ""))) == want and {4, 5, 8}.isdisjoint(k[0] for k in want)


def test_ngram_jaccard(spark):
    rows = base_rows() + [(70, prose(70, 50), "en", "a", 1), (70, prose(71, 50), "en", "a", 1)]
    _, label = components_by_hand([(r[0], r[1]) for r in rows], 5, (80, 100))
    stay = {r[0] for r, c in zip(rows, label) if r[0] is not None and c == r[0]}
    want = Counter(set(r for r in rows if r[0] in stay)) + Counter(r for r in rows if r[0] is None)
    assert Counter(of(STAGES["ngram_jaccard"](spark, frame(spark, rows), ""))) == want
    assert {1, 9, 70} <= stay and not {2, 3} & stay


def test_suffix_array_dedup(spark):
    rows = base_rows() + [(80, "é" * 150 + prose(80, 30), "fr", "a", 1), (81, "xé" + "é" * 150 + prose(81, 30), "fr", "a", 1), (82, "   ", "fr", "a", 3)]
    want = Counter()
    for (i, text, lang, source, _), d, hit in zip(rows, *repeated_bytes([r[1] for r in rows])):
        left, at = [], 0
        for c in d.decode():
            size = len(c.encode())
            if not hit[at : at + size].all():
                left.append(c)
            at += size
        left = "".join(left)
        if not hit.any() or left.strip(" "):
            want[i, left, lang, source, len(left)] += 1
    assert Counter(of(STAGES["suffix_array_dedup"](spark, frame(spark, rows), ""))) == want


def test_source_mixing(spark):
    rows = base_rows()
    got = Counter(of(STAGES["source_mixing"](spark, frame(spark, rows), "")))
    there = Counter(rows)
    assert set(got) == set(there)
    tokens = Counter()
    for r in rows:
        tokens[r[3]] += len((r[1] or "").split())
    for source in tokens:
        uses = {got[r] / there[r] for r in rows if r[3] == source}
        assert 1 <= min(uses) and max(uses) <= 4 and max(uses) - min(uses) <= 1  # whole epochs and a part of one
    assert max(got.values()) > 1


def test_best_fit_packing(spark):
    from tokenizers import Tokenizer

    rows, want = base_rows(), Counter()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            want[i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())] += 1
    got = STAGES["best_fit_packing"](spark, frame(spark, rows), "").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert all(n <= 2048 for n in Counter({s: sum(r["length"] for r in got if r["sequence_id"] == s) for s in {r["sequence_id"] for r in got}}).values())


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_nothing(spark, name):
    assert STAGES[name](spark, frame(spark, []), "").count() == 0
    nulls = STAGES[name](spark, frame(spark, [(None,) * 5] * 3), "").count()
    assert nulls == (0 if name == "language_id" else 3)


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {1, 7, 12} <= {r["doc_id"] for r in got} and not {2, 4, 5, 8} & {r["doc_id"] for r in got}
    assert all(re.fullmatch(r"[0-9]+", str(r["ids_crc32"])) and math.isfinite(r["length"]) for r in got)
