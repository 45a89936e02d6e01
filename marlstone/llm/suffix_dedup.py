"""Substring deduplication: suffix arrays over the contexts of repeated anchors, and counts of whole contexts.

Strings are told apart by 64-bit hashes in two places, else by bytes: grams, and whole contexts of equal grams. For a
gram with k different contexts the odds that two of them are taken for equal are about k^2 / 2^65; two contexts of
different grams are taken for equal only if both hashes are.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import find
from .common import fits, join_spread, map_batches, scratch, stored
from .gsaca import suffix_array

def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key long (the id; a hash of the text for a null id) and text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text)).alias("key"), text.alias("text"))


def _occurrences(texts: DataFrame, window: int, gram: int, only: object = None) -> DataFrame:
    """gram long, context long, key long, at int of every anchor; if `only` broadcasts sorted grams, of these alone."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find([t.encode() for t in batch.column(1).to_pylist()], window, gram)
        grams, keep = found.gram.view(np.int64), slice(None)
        if only is not None:
            live = only.value
            keep = live[np.minimum(np.searchsorted(live, grams), len(live) - 1)] == grams if len(live) else np.zeros(len(grams), bool)
        owner = batch.column(0).to_numpy()[found.text.astype(np.int64)]
        cols = grams, found.context.view(np.int64), owner, found.at.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], ["gram", "context", "key", "at"])

    return map_batches(texts.select("key", "text"), run, "gram long, context long, key long, at int")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _reach(sides: list[bytes]) -> list[int]:
    """For each string, the longest prefix that another one of the list has too."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out, last = [0] * len(sides), 0
    for i, j in zip(order, order[1:]):
        n = _common(sides[i], sides[j])
        out[i], last = max(last, n), n
    out[order[-1]] = last
    return out


def repeated_in_group(lefts: list[bytes], rights: list[bytes], window: int, gram: int) -> list[list[tuple[int, int]]]:
    """For each context of one gram, the repeated spans around it, as distances from the gram's start.

    lefts are what stands before the gram, read backwards; rights what stands after it. A string of `window` bytes that
    holds the gram is repeated if another context has it at the same distance. What no other context shares on a side
    is cut off. Contexts that are then equal repeat each other; for the rest a suffix array is built in which the gram,
    which all have, is a single symbol, and suffixes that share their first window are found as neighbours.
    """
    margin = window - gram
    spans: list[list[tuple[int, int]]] = [[] for _ in lefts]
    cut: dict[tuple[bytes, bytes], list[int]] = {}
    for i, (n, m) in enumerate(zip(_reach(lefts), _reach(rights))):
        if n + m >= margin:
            cut.setdefault((lefts[i][:n], rights[i][:m]), []).append(i)
    strings = list(cut)
    for (left, right), members in cut.items():
        if len(members) > 1:
            for i in members:
                spans[i].append((-len(left), gram + len(right)))
    if len(strings) > 1 and any(len(m) == 1 for m in cut.values()):
        many = len(strings)
        text: list[int] = []
        first: list[int] = []  # of each string, where its text starts
        for k, (left, right) in enumerate(strings):
            first.append(len(text))
            text += [b + many for b in reversed(left)]
            text.append(256 + many)
            text += [b + many for b in right]
            text.append(many - 1 - k)
        owner = [-1] * len(text)  # of positions where a whole window starts
        for k, (left, right) in enumerate(strings):
            for s in range(max(0, margin - len(right)), min(margin, len(left)) + 1):
                owner[first[k] + len(left) - s] = k
        raw, size = array("I", text).tobytes(), 4 * (margin + 1)
        runs: list[list[int]] = []
        last = None
        for p in suffix_array(text):
            if owner[p] >= 0:
                piece = raw[4 * p : 4 * p + size]
                if piece == last:
                    runs[-1].append(p)
                else:
                    runs.append([p])
                    last = piece
        for run in runs:
            if len(run) > 1:
                for p in run:
                    k = owner[p]
                    s = p - first[k] - len(strings[k][0])
                    for i in cut[strings[k]]:
                        spans[i].append((s, s + window))
    return [merged(x) for x in spans]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, as disjoint spans in order that do not touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def _group_spans(contexts: DataFrame, window: int, gram: int) -> DataFrame:
    """key, begin, end of the repeated spans around the contexts that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if len(held) > 1:
                found = repeated_in_group([h[4] for h in held], [h[5] for h in held], window, gram)
                for (_, key, at, n, _, _), spans in zip(held, found):
                    if n == 1:
                        for a, b in spans:
                            for c, v in zip(out, (key, at + a, at + b)):
                                c.append(v)
            held.clear()

        def batch_of() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["key", "begin", "end"])
            for c in out:
                c.clear()
            return b

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            yield batch_of()
        close()
        yield batch_of()

    rows = contexts.select("gram", "key", "at", "n", "left", "right")
    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "key long, begin int, end int")


def _narrowed(contexts: DataFrame, margin: int, step: int) -> DataFrame:
    """The contexts of too large groups under longer grams: with the next `step` bytes on the left, and on the right.

    A string that holds the gram has `step` more bytes of it on one side at least, if step is half the margin. What the
    other side then can't hold of it is cut off; a context without room for a string is dropped.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        for gram, key, at, n, left, right in zip(*(c.to_pylist() for c in batch.columns)):
            for side, own, rest in ((0, left, right), (1, right, left)):
                if len(own) < step or len(own) - step + min(len(rest), margin - step) < margin - step:
                    continue
                name = hashlib.blake2b(gram.to_bytes(8, "little", signed=True) + bytes([side]) + own[:step], digest_size=8).digest()
                sides = (own[step:], rest[: margin - step]) if side == 0 else (rest[: margin - step], own[step:])
                for c, v in zip(cols, (int.from_bytes(name, "little", signed=True), key, at - step if side == 0 else at, n, *sides)):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["gram", "key", "at", "n", "left", "right"])

    return map_batches(contexts.select("gram", "key", "at", "n", "left", "right"), run, "gram long, key long, at int, n int, left binary, right binary")


def _edge_spans(contexts: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """key, begin, end of the repeated spans around the contexts that occur once.

    contexts (stored): gram, key, at, n, left, right, and kinds, the number of the gram's contexts. Groups of at most
    `hot` contexts go to suffix arrays. Those of larger ones are grouped again by longer grams, each time by half of what
    is missing to a whole string; equal ones are counted and meet as one. In the end a gram is a whole string, and all
    its contexts are equal.
    """
    marks: DataFrame | None = None
    while True:
        found = stored(_group_spans(contexts.where(F.col("kinds") <= hot), window, gram), "edges")
        marks = found if marks is None else marks.union(found)
        large = contexts.where(F.col("kinds") > hot)
        if large.isEmpty():
            return marks
        margin = window - gram
        step = -(-margin // 2)
        gram += step
        rows = stored(_narrowed(large, margin, step), "narrowed")
        same = ["gram", "left", "right"]
        kinds = stored(rows.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.struct("key", "at")).alias("first"), F.count("*").alias("rows")), "kinds")
        again = join_spread(rows.where("n = 1").drop("n"), kinds.where("n > 1").select(*same, "rows"), same, "rows")
        marks = marks.union(again.select("key", (F.col("at") - F.length("left")).alias("begin"), (F.col("at") + gram + F.length("right")).alias("end")))
        sizes = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("_least")).where("kinds > 1 and _least = 1")
        of_size = join_spread(kinds, stored(sizes.select("gram", "kinds"), "sizes"), ["gram"], "kinds")
        contexts = stored(of_size.select("gram", F.col("first.key").alias("key"), F.col("first.at").alias("at"), F.least("n", F.lit(2)).cast("int").alias("n"), "left", "right", "kinds"), "contexts")


def repeated_spans(texts: DataFrame, window: int = 200, gram: int = 100, hot: int = 1024) -> DataFrame:
    """key and spans array<struct<begin, end>> (bytes; disjoint, in order, begin may be below 0) that cover all repeated strings.

    texts has key long and text. Each string of `window` bytes holds an anchor chosen by content, so repeated strings
    share an anchor's gram. Grams are counted; occurrences of those that come again are kept. A whole context that comes
    again is repeated without further work. Contexts of repeated grams that occur once, the edges of what is repeated,
    meet one example of each other context of their gram, and suffix arrays tell what they share. Counts are
    pre-aggregated, so only different contexts of a gram meet; a gram with more than `hot` of them is made longer, which
    parts them into smaller groups. Grams and contexts that come very often are joined without
    moving their rows. What one text's rows gather grows with the length of that text alone.
    """
    with scratch():
        spark = texts.sparkSession
        grams = _occurrences(texts, window, gram).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
        grams = stored(grams, "grams")
        if fits(grams.count() * 8):
            live = spark.sparkContext.broadcast(np.sort(grams.toArrow()["gram"].to_numpy()))
            again = _occurrences(texts, window, gram, live)
        else:
            again = _occurrences(texts, window, gram).join(grams.hint("merge"), "gram", "left_semi")
        again = stored(again, "occurrences")
        kinds = stored(again.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("first")), "kinds")
        whole = join_spread(again, kinds.where("n > 1").select("gram", "context", "n"), ["gram", "context"], "n")
        whole = whole.select("key", (F.col("at") - (window - gram)).alias("begin"), (F.col("at") + window).alias("end"))
        edges = stored(kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("_least")).where("kinds > 1 and _least = 1").select("gram", "kinds"), "edges")
        asked = join_spread(kinds, edges, ["gram"], "kinds").select("gram", F.col("first.key").alias("key"), F.col("first.at").alias("at"), F.least("n", F.lit(2)).cast("int").alias("n"), F.col("kinds").cast("int").alias("kinds"))
        by_text = asked.groupBy("key").agg(F.collect_list(F.struct("gram", "at", "n", "kinds")).alias("asks"))

        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for key, text, asks in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for a in asks:
                    at = a["at"]
                    for c, v in zip(cols, (a["gram"], key, at, a["n"], data[max(0, at - window + gram) : at][::-1], data[at + gram : at + window], a["kinds"])):
                        c.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], ["gram", "key", "at", "n", "left", "right", "kinds"])

        # Repeated rows give a context twice; it has n > 1 then, and is marked as a whole already.
        joined = texts.join(by_text, "key").select("key", "text", "asks")
        contexts = stored(map_batches(joined, cut, "gram long, key long, at int, n int, left binary, right binary, kinds int"), "contexts")
        marks = whole.union(_edge_spans(contexts, window, gram, hot))

        def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = [[{"begin": a, "end": b} for a, b in merged([(s["begin"], s["end"]) for s in own])] for own in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))], ["key", "spans"])

        gathered = marks.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
        return stored(map_batches(gathered, merge, "key long, spans array<struct<begin: int, end: int>>"), "spans", outlive=True)


def _bounds(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    return merged([(max(0, s["begin"]), min(size, s["end"])) for s in spans or ()])


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters of which they cover only a part."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def deduplicate(docs: DataFrame, id_col: str, text_col: str, window: int = 200, gram: int = 100, with_text: bool = True) -> DataFrame:
    """Remove each byte covered by a `window`-byte string that also starts anywhere else, in the same text or another.

    Returns a row per document: the id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans
    (array<struct<begin, end>>) and kept_text (with whole characters only: where a span ends inside a character, that
    character stays; null unless `with_text`). Strings are judged on the input, and every occurrence is removed. A null text counts as empty;
    texts shorter than `window` keep all. Ids are taken to be unique but for repeated rows, which repeat each other; a
    null id is allowed. An empty table gives no rows; other columns are not read.
    """
    return apply_spans(docs, id_col, text_col, repeated_spans(keyed(docs, id_col, text_col), window, gram), with_text=with_text)


def apply_spans(docs: DataFrame, id_col: str, text_col: str, spans: DataFrame, keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """The rows of deduplicate() for given stored spans by key, with the columns named in `keep`."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text)).alias("key"), *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)))
    carried = [f for f in rows.schema.fields if f.name.startswith("_keep_")]
    joined = rows.join(spans.hint("merge"), "key", "left").select("id", "text", "spans", *(f.name for f in carried))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = text.encode()
            own = _bounds(spans, len(data))
            clean = (_kept(data, whole_characters(data, own)).decode() if own else text) if with_text else None
            values = len(data), sum(b - a for a, b in own), len(own), hashlib.sha256(_kept(data, own)).hexdigest(), [{"begin": a, "end": b} for a, b in own], clean
            for c, v in zip(cols, values):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds)), *batch.columns[3:]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text", *(f.name for f in carried)])

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: int, end: int>>, kept_text string"
    out = map_batches(joined, run, ", ".join([schema, *(f"{f.name} {f.dataType.simpleString()}" for f in carried)]))
    return out.withColumnsRenamed({"id": id_col} | {f"_keep_{i}": c for i, c in enumerate(keep)})
