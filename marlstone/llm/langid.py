"""Language identification by unigram piece models that sum over all segmentations."""

from __future__ import annotations

import math
import re
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .shingles import _powers, mix

LETTERS = re.compile(r"[^\W\d_]+")
#: Scores (one a word and language) that a Python worker remembers; beyond it, it starts anew. Those made at once.
CACHE, PART = 800_000, 40_000
_PIECES: dict[str, list[str]] = {}
_SCORES: dict[int, tuple] = {}


def vocabulary(path: str) -> list[str]:
    """The distinct lower-cased pieces of a sentencepiece file that are letters, with the word mark or without."""
    if path not in _PIECES:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
        _PIECES[path] = sorted(p for p in pieces if p.removeprefix("▁").isalpha() or p == "▁")
    return _PIECES[path]


def piece_table(pieces: list[str], probs: np.ndarray) -> dict[str, tuple[float, ...] | bool]:
    """Probabilities of each piece by language; False for what only ends a piece."""
    table: dict[str, tuple[float, ...] | bool] = {}
    for piece in pieces:
        for k in range(1, len(piece)):
            table.setdefault(piece[k:], False)
    table.update(zip(pieces, map(tuple, probs.tolist())))
    return table


def forward(word: str, probs: dict[str, tuple[float, ...] | bool], n: int, longest: int, floor: float) -> list[float]:
    """Log-probability of the word under each of n models, summed over all its segmentations into pieces.

    alpha[j] sums, over every piece that ends at j, its probability times alpha at its start. Alphas are scaled at each
    step, so words of any length work; a character that is no piece costs `floor` under every model.
    """
    alphas, logs = [[1.0] * n], [0.0] * n
    get = probs.get
    for j in range(1, len(word) + 1):
        acc = [a * floor for a in alphas[-1]]
        for back in range(1, min(longest, j) + 1):
            p = get(word[j - back : j])
            if p:
                a = alphas[-back]
                for k in range(n):
                    acc[k] += a[k] * p[k]
            elif p is None:  # no longer piece ends here
                break
        alphas.append(acc)
        if len(alphas) > longest:
            del alphas[0]
            if j % 16 == 0:  # bring the window's newest alpha to 1
                top = alphas[-1]
                logs = [x + math.log(t) for x, t in zip(logs, top)]
                alphas = [[a / t for a, t in zip(row, top)] for row in alphas]
    return [x + math.log(a) for x, a in zip(logs, alphas[-1])]


class Lattice:
    """The same for many words at once, in numpy: pieces are found by hashes of letters, sums are made place by place.

    Hashes are 64-bit; a run of letters that is no piece is taken for one with odds of about pieces / 2^64.
    """

    SLOTS = 20

    def __init__(self, pieces: list[str], probs: np.ndarray, floor: float):
        self.pieces, self.probs, self.floor, self.longest = pieces, np.ascontiguousarray(probs), floor, max(map(len, pieces))
        table = {p[k:]: -1 for p in pieces for k in range(1, len(p))} | {p: i for i, p in enumerate(pieces)}
        runs = sorted(table, key=len)
        self.number = np.array([table[r] for r in runs], np.int32)
        self.more = np.array([False] * len(runs))  # whether a longer piece ends in this run
        place = {r: i for i, r in enumerate(runs)}
        for r in runs:
            if len(r) > 1:
                self.more[place[r[1:]]] = True
        codes, starts, lengths = self._codes(runs)
        prefix, inverse = self._prefix(codes)
        self.hashes = self._hash(prefix, inverse, starts, starts + lengths)
        # Slots by some bits of the hash; runs that meet go to another table, by other bits.
        self.tables, left = [], np.arange(len(runs))
        while len(left):
            slot = self._slot(self.hashes[left], len(self.tables))
            first = np.unique(slot, return_index=True)[1]
            own = np.full(1 << self.SLOTS, -1, np.int32)
            own[slot[first]] = left[first]
            self.tables.append(own)
            left = np.delete(left, first)

    @cached_property
    def table(self) -> dict[str, tuple[float, ...] | bool]:
        """What forward() takes, for words that are too long for scores()."""
        return piece_table(self.pieces, self.probs)

    @staticmethod
    def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        return codes, np.cumsum(lengths) - lengths, lengths

    @staticmethod
    def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = _powers(len(codes) + 1)
        return np.r_[np.uint64(0), np.cumsum(mix(codes + np.uint64(1)) * power[: len(codes)])], inverse

    @staticmethod
    def _hash(prefix: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))

    def _slot(self, hashes: np.ndarray, table: int) -> np.ndarray:
        return (mix(hashes + np.uint64(table)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, np.int32)
        for k, table in enumerate(self.tables):
            at = np.flatnonzero(found < 0)
            there = table[self._slot(hashes[at], k)]
            good = (there >= 0) & (self.hashes[there] == hashes[at])
            found[at[good]] = there[good]
        return found

    def scores(self, words: list[str]) -> np.ndarray:
        """forward() of each word, as a row; words may be at most 24 letters, or the sums would leave the floats."""
        order = np.argsort([-len(w) for w in words], kind="stable")
        codes, starts, lengths = self._codes([words[i] for i in order])
        prefix, inverse = self._prefix(codes)
        owner = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(codes)) - starts[owner] + 1  # letters up to and with each position
        arcs: list[list[tuple]] = [[] for _ in range(int(lengths[0]) + 1)]  # by place: length, words, pieces
        alive = np.arange(len(codes))
        for size in range(1, self.longest + 1):
            alive = alive[place[alive] >= size]
            if not len(alive):
                break
            found = self._find(self._hash(prefix, inverse, alive + 1 - size, alive + 1))
            alive, found = alive[found >= 0], found[found >= 0]
            number = self.number[found]
            hit = alive[number >= 0]
            by_place = np.argsort(place[hit], kind="stable")
            hit, number = hit[by_place], number[number >= 0][by_place]
            ends = np.searchsorted(place[hit], np.arange(len(arcs) + 1))
            for j in range(1, len(arcs)):
                if ends[j] < ends[j + 1]:
                    part = slice(ends[j], ends[j + 1])
                    arcs[j].append((size, owner[hit[part]], number[part]))
            alive = alive[self.more[found]]
        alphas = np.zeros((len(arcs), len(words), self.probs.shape[1]))
        alphas[0] = 1.0
        for j in range(1, len(arcs)):
            own = alphas[j]
            np.multiply(alphas[j - 1], self.floor, out=own)
            for size, who, number in arcs[j]:
                own[who] += alphas[j - size, who] * self.probs[number]
        out = np.empty((len(words), self.probs.shape[1]))
        out[order] = np.log(alphas[lengths, np.arange(len(words))])
        return out


def fit_pieces(words: dict[str, int], pieces: list[str], rounds: int, smoothing: float, longest: int) -> np.ndarray:
    """Probabilities of the pieces by expectation maximisation over all segmentations of the counted words.

    Sums at a place are kept as fwd[j] * 2 ** shift[j], so words of any length work.
    """
    at = {p: i for i, p in enumerate(pieces)}
    probs = [1.0 / len(pieces)] * len(pieces)
    floor = 1e-9
    lattices = []
    for word, count in words.items():
        w = "▁" + word
        arcs = [[(i, at[w[i:j]]) for i in range(max(0, j - longest), j) if w[i:j] in at] for j in range(1, len(w) + 1)]
        lattices.append((count, arcs))
    for _ in range(rounds):
        soft = [smoothing] * len(pieces)
        for count, arcs in lattices:
            n = len(arcs)
            fwd, shift, e = [1.0] + [0.0] * n, [0] * (n + 1), 0
            for j, ends in enumerate(arcs, 1):
                own = fwd[j - 1] * floor + sum(fwd[i] * probs[p] if shift[i] == e else math.ldexp(fwd[i] * probs[p], shift[i] - e) for i, p in ends)
                if own < 1e-150:
                    own, e = math.ldexp(own, 500), e - 500
                fwd[j], shift[j] = own, e
            bwd = [0.0] * n + [count / fwd[n]]
            for j in range(n, 0, -1):
                b, e = bwd[j], shift[j]
                bwd[j - 1] += math.ldexp(b * floor, shift[j - 1] - e)
                for i, p in arcs[j - 1]:
                    x = b * probs[p] if shift[i] == e else math.ldexp(b * probs[p], shift[i] - e)
                    bwd[i] += x
                    soft[p] += fwd[i] * x
        total = sum(soft)
        probs = [s / total for s in soft]
    return np.array(probs)


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, vocabulary_path: str, per_lang: int = 400, rounds: int = 2, smoothing: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Fit a piece model for each language: (languages, log-free probabilities by piece and language).

    Rows with a null text or language are not used. The fit takes about `per_lang` documents of each language, chosen by
    a hash of the id; that bound is the only sampling. A language is fitted in one task from its bounded sample; the
    driver gets one probability per piece and language. An empty table gives no languages.
    """
    pieces = vocabulary(vocabulary_path)
    longest = max(map(len, pieces))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((len(pieces), 0))
    share = F.create_map(*chain.from_iterable((F.lit(x), F.lit(min(1.0, per_lang / counts[x]))) for x in langs))
    chosen = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def word_counts(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        tally: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in LETTERS.findall(text.lower()):
                tally[lang, w] = tally.get((lang, w), 0) + 1
        if tally:
            return pa.RecordBatch.from_pydict({"lang": [k[0] for k in tally], "word": [k[1] for k in tally], "n": list(tally.values())})
        return None

    words = map_batches(chosen.select("lang", "text"), word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit(key: tuple, group: pa.Table) -> pa.Table:
        counted = dict(sorted(zip(group["word"].to_pylist(), group["n"].to_pylist())))
        probs = fit_pieces(counted, vocabulary(vocabulary_path), rounds, smoothing, longest)
        return pa.table({"lang": [key[0].as_py()], "probs": [probs.tobytes()]})

    fitted = {r["lang"]: np.frombuffer(bytes(r["probs"])) for r in words.groupBy("lang").applyInArrow(fit, "lang string, probs binary").collect()}
    return langs, np.stack([fitted.get(x, np.full(len(pieces), 1 / len(pieces))) for x in langs], 1)


def identify(docs: DataFrame, id_col: str, text_col: str, langs: list[str], probs: np.ndarray, vocabulary_path: str, floor: float = 1e-9, undetermined: str = "und", keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text: id column, lang_pred string, score double, and the columns
    named in `keep`.

    Each run of letters is a word; a text's log-likelihood is the sum of its words' forward scores, and the language
    with the highest wins; ties go to the one that sorts first. The posterior of a whole text is near 1 for nearly any
    text, so the score is that of the winner for one word of the text's mean likelihood, under equal priors: it does not
    grow with length and tells clear texts from mixed ones. Texts that are null or have no letter get `undetermined` and
    0, and so does every text if no language was learned. Repeated rows give repeated results; an empty table gives
    none; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)))
    kind, *kept = (f.dataType.simpleString() for f in rows.schema.fields if f.name != "text")
    n = len(langs)
    model_key = hash((tuple(langs), probs.tobytes(), floor))

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = vocabulary(vocabulary_path)
        if model_key not in _SCORES:
            _SCORES.clear()
            _SCORES[model_key] = {}, np.zeros((CACHE // max(n, 1), n)), Lattice(pieces, probs, floor)
        index, scores, lattice = _SCORES[model_key]
        texts = batch.column(1).to_pylist()
        split = [LETTERS.findall((t or "").lower()) for t in texts]
        pred, score = [], []
        if n:
            new = set(chain.from_iterable(split)).difference(index)
            if len(index) + len(new) > len(scores):
                index.clear()
                new = set(chain.from_iterable(split))
            if len(new) > len(scores):  # one text may have more distinct words than the cache
                _SCORES[model_key] = index, scores, lattice = index, np.zeros((len(new), n)), lattice
            short = [w for w in new if len(w) < 24]
            step = max(1, PART // n)
            for at in range(0, len(short), step):
                part = short[at : at + step]
                scores[len(index) : len(index) + len(part)] = lattice.scores(["▁" + w for w in part])
                index.update(zip(part, range(len(index), len(index) + len(part))))
            for w in new:
                if len(w) >= 24:
                    scores[len(index)] = forward("▁" + w, lattice.table, n, lattice.longest, floor)
                    index[w] = len(index)
        for words in split:
            if not words or not n:
                pred.append(undetermined)
                score.append(0.0)
                continue
            total = scores[np.fromiter(map(index.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            pred.append(langs[best])
            score.append(float(1 / np.exp((total - total[best]) / len(words)).sum()))
        names = ["id", "lang_pred", "score", *(f"_keep_{i}" for i in range(len(keep)))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *batch.columns[2:]], names)

    schema = ", ".join([f"id {kind}, lang_pred string, score double", *(f"_keep_{i} {k}" for i, k in enumerate(kept))])
    return map_batches(rows, predict, schema).withColumnsRenamed({"id": id_col} | {f"_keep_{i}": c for i, c in enumerate(keep)})
