"""A small fixture of all tables, with the cases that every operator must take."""

import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, rep string, key string, tokens string, cell string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeiou", k=rng.randint(2, 7))) for _ in range(n))


BASE = prose(1, 120)
WORDS = {"en": "the cat and the dog went with that house over there", "fr": "le chat et les chiens sont avec nous dans la maison"}


def document_rows():
    rng = random.Random(3)
    rows = [
        (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("a", "o", 2), "en", "a"), (4, None, "en", "b"), (5, "", None, None), (6, "x", "en", "b"), (7, prose(2, 60) + " " + BASE[:300] + " é" + prose(3, 60), "fr", "b"),
        (8, "12 !! %", "fr", "c"), (9, prose(4, 3000), "fr", "c"), (9, prose(4, 3000), "fr", "c"), (None, "lone words stay here", "fr", "c"), (11, "ab " * 400, None, "c"), (12, "Ünïcode ﬁne 漢字漢字 \U0001f600", None, "d"),
    ]
    for i in range(20, 60):
        lang = "en" if i % 2 else "fr"
        rows.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(5, 60))), lang if i % 3 else None, "abcd"[i % 4] if i % 7 else None))
    return [(*r, len(r[1]) if r[1] is not None else None, "clash", "clash", "clash", "clash", "clash") for r in rows]


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(document_rows(), DOCUMENTS).write.parquet(f"{root}/documents.parquet")
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)] + [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [None] * 8), (2400, [float("inf")] * 8)]
    vectors[5] = (5, vectors[100][1])
    spark.createDataFrame([(*v, "clash", "clash", 1, 1) for v in vectors], "vec_id bigint, embedding array<double>, id string, v string, cell int, block int").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame([(r[0], int(i % 3 > 0), 0) for i, r in enumerate(document_rows()) if r[0] is not None and i % 5], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    pages = [
        (1, "http://h/1", '<html><body><nav><a href="/">menu</a></nav><div class="ad">buy</div><article><h1>T &amp; U</h1><p>one\n  two<p>three<script>x="</p>"</script></article><div class="comments">me too</div><footer>&copy;</footer>'),
        (2, "http://h/2", None), (2, "http://h/2", None), (3, None, "<p>loose"), (4, "http://h/4", "<div>" * 3000 + "deep. text"), (None, "no url", ""),
    ]
    spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id bigint, url string, html string, host string, paths string").write.parquet(f"{root}/pages.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty_dir(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in ("documents", "embeddings", "labels", "pages"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return str(root)
