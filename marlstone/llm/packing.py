"""Best-two-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, number_within, placed

_TOKENIZERS: dict[str, tuple] = {}
_WORDS: dict[str, dict[bytes, bytes]] = {}
#: Words whose ids a Python worker remembers; beyond it, it starts anew.
CACHE = 400_000
#: ASCII marks that are neither letters, digits nor white space for the tokenizer and open no shortened form or special token.
MARKS = b'!"#$%&()*+,-./:;=?@[\\]^_`{}~'


def _encode(words: list[bytes], path: str) -> dict[bytes, bytes]:
    """The ids of each word, which has no white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        closes = np.zeros(tokenizer.get_vocab_size(), bool)
        closes[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        _TOKENIZERS[path] = tokenizer, closes
    tokenizer, closes = _TOKENIZERS[path]
    out: dict[bytes, bytes] = {}
    # A word of letters alone is one unit for the tokenizer and has one word end, so many go in one call. A line with more
    # ends than words (some letters in capitals become a letter and a mark) is encoded word by word.
    plain, rest = [], []
    for w in words:
        (plain if w.isalpha() or not w.isascii() and w.decode().isalpha() else rest).append(w)
    lines = [plain[k : k + 100] for k in range(0, len(plain), 100)]
    for line, e in zip(lines, tokenizer.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False)):
        ids = np.array(e.ids, "<u4")
        ends = (4 * np.flatnonzero(closes[ids]) + 4).tolist()
        if len(ends) != len(line):
            rest += line
            continue
        raw = ids.tobytes()
        out.update(zip(line, [raw[a:b] for a, b in zip([0, *ends], ends)]))
    for w, e in zip(rest, tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
        out[w] = array("I", e.ids).tobytes()
    return out


def token_ids(texts: list[str | None], path: str, end_id: int = 0) -> list[bytes]:
    """The ids of each text and then end_id, as little-endian unsigned 32-bit numbers.

    No token of this kind of tokenizer spans white space, case does not count, and marks after letters are units of their
    own. So ids are found once for each word without the marks at its end and joined; that gives the same ids as encoding
    the whole text.
    """
    words = _WORDS.setdefault(path, {})
    if len(words) > CACHE:
        words.clear()
    docs, new = [], set()
    for t in texts:
        data = (t or "").encode()
        split = (data if b"<|" in data else data.lower()).split()
        parts = list(map(words.get, split))
        gaps = [(i, split[i]) for i, ids in enumerate(parts) if ids is None] if None in parts else []
        new.update([w for _, w in gaps])
        docs.append((parts, gaps))
    units, cut = set(), []
    for w in new:
        core = w.rstrip(MARKS)
        if len(core) == len(w) or not core[-1:].isalpha():
            units.add(w)
        else:
            tail = w[len(core) :]
            cut.append((w, core, tail))
            if core not in words:
                units.add(core)
            if tail not in words:
                units.add(tail)
    if units:
        words.update(_encode(list(units), path))
    for w, core, tail in cut:
        words[w] = words[core] + words[tail]
    end, out = array("I", [end_id]).tobytes(), []
    for parts, gaps in docs:
        for i, w in gaps:
            parts[i] = words[w]
        parts.append(end)
        out.append(b"".join(parts))
    return out


def tokenised_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Cut each document's ids into pieces of at most `capacity`: id, piece, start, length, ids_crc32."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, cols = batch.column(0), ([], [], [], [], [])
        for row, ids in enumerate(token_ids(batch.column(1).to_pylist(), tokenizer_path, end_id)):
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for c, v in zip(cols, (row, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                    c.append(v)
        at, piece, start, length, crc = cols
        return pa.RecordBatch.from_arrays(
            [own.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["id", "piece", "start", "length", "ids_crc32"],
        )

    return map_batches(docs.select(id_col, text_col), pieces, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-two-fit over a histogram of lengths: (number of bins, {length: documents of it in each}).

    A bin is filled greedily, the longest document that fits first. If a gap is left, its smallest document is taken out
    and, if two unpacked documents fill the expanded gap more tightly, they replace it. The same pattern is then used
    for as many bins as the remaining counts allow, so the work depends on the number of distinct lengths (`capacity`
    at most), not on that of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return plan
        free, use, gap = left.copy(), {}, capacity

        def add(length: int, n: int = 1) -> None:
            free[length] -= n
            use[length] = use.get(length, 0) + n
            if not use[length]:
                del use[length]

        at = len(there) - 1
        while gap and at >= 0:
            at = min(at, int(np.searchsorted(there, gap, "right")) - 1)
            if at < 0:
                break
            length = int(there[at])
            n = min(int(free[length]), gap // length)
            if n:
                add(length, n)
                gap -= n * length
            at -= 1
        if gap:
            small = min(use)
            room, best = gap + small, None
            lengths = np.flatnonzero(free[: room + 1])
            if len(lengths):
                partner = np.searchsorted(lengths, room - lengths, "right") - 1
                ok = partner >= 0
                a, b = lengths[ok], lengths[partner[ok]]
                twice = (a == b) & (free[a] < 2)  # one such document is left: pair it with the next smaller length
                b = np.where(twice, lengths[np.maximum(partner[ok] - 1, 0)], b)
                sums = np.where(twice & (partner[ok] == 0), 0, a + b)
                if len(sums) and sums.max() > small:
                    k = int(sums.argmax())
                    best = (int(a[k]), int(b[k]))
            if best:
                add(small, -1)
                add(best[0])
                add(best[1])
        times = min(int(left[length]) // n for length, n in use.items())
        for length, n in use.items():
            left[length] -= times * n
        plan.append((times, use))


def pack(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens by best-two-fit.

    Returns a row for each piece: the id column, piece, start, length, ids_crc32, sequence_id and offset. A null or
    empty text is the end token alone. Only longer documents are cut; their full pieces fill sequences by themselves.
    Repeated rows and null ids are packed like any others; an empty table gives no rows; other columns are not read.

    The driver gets the histogram of lengths (`capacity` rows at most) and plans bins as patterns of lengths. Each piece
    finds its sequence from its number among the pieces of its length, so documents are never moved or gathered.
    """
    pieces = placed(tokenised_pieces(docs, id_col, text_col, tokenizer_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    taken, base, rows = dict.fromkeys(counts, 0), 0, []
    for times, use in plan_bins(counts, capacity):
        offset = 0
        for length, n in sorted(use.items(), reverse=True):
            rows.append((length, taken[length], n, base, offset))
            taken[length] += n * times
            offset += n * length
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    lengths, firsts = table[:, 0].copy(), table[:, 1].copy()
    spans = {int(length): slice(*np.searchsorted(lengths, [length, length + 1])) for length in np.unique(lengths)}

    def place(batch: pa.RecordBatch) -> pa.Table:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for one in np.unique(length):
            at = np.flatnonzero(length == one)
            own = table[spans[int(one)]]
            own = own[np.searchsorted(own[:, 1], rank[at], "right") - 1]
            t = rank[at] - own[:, 1]
            sequence[at] = own[:, 3] + t // own[:, 2]
            offset[at] = own[:, 4] + t % own[:, 2] * one
        return pa.Table.from_batches([batch]).drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    numbered = number_within(pieces, ["length"], "rank").select("id", "piece", "start", "length", "ids_crc32", "rank")
    kind = pieces.schema["id"].dataType.simpleString()
    return map_batches(numbered, place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
