"""N-gram Jaccard join by token-combination prefixes."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, join_measured, join_spread, map_batches, placed, stored
from .graph import components
from .shingles import mix, shingle_sets

#: Least and most bits of the counting sketch's index: it takes 2 to 32 MB.
SKETCH_BITS, MOST_BITS = 18, 22


def sketch_bits(documents: int) -> int:
    """Bits for a bucket for every four documents, within the bounds."""
    return min(MOST_BITS, max(SKETCH_BITS, (documents // 4).bit_length()))


def sketch(docs: DataFrame, text_col: str, width: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many documents have a shingle in each of 2 ** bits hash buckets, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), width):
                np.add.at(total, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": total[at]})

    out = np.zeros(1 << bits, np.int64)
    summed = docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def needed(n: int, share: tuple[int, int]) -> int:
    """The least overlap of a set of n with any set linked to it."""
    return -(-share[0] * n // share[1])


def groups_of(n: int) -> int:
    """Into how many groups the frequent tokens of a set of about n tokens are dealt."""
    return 1 << max(0, (n // 32).bit_length() - 1)


def signatures(s: np.ndarray, counts: np.ndarray, frequent: int, share: tuple[int, int]) -> np.ndarray:
    """The signatures of a set: two linked sets that are not equal have one in common.

    Tokens are ordered, rare ones first. Of a linked set's tokens at most `errors` are missing in the other. A prefix of
    errors + 1 rare tokens leaves one that is shared, so each is a signature. If there are not so many rare ones, the
    prefix extends into frequent tokens; these are dealt to groups by hash, and the pairs within a group are signatures.
    Each group then needs one token more, as one shared token makes no pair; the prefix is extended until more than
    `errors` tokens must be missing to break every signature. Of two linked sets, the one whose prefix ends first has a
    shared signature whose tokens also lie in the other's prefix. The number of groups follows the size of a set, and a
    set gives pairs for every number of groups that a linked set's size allows, so both sides agree on one.

    Frequent tokens count as such only for shares above 3/4: there, sets of fewer than 4 tokens are linked to equal ones
    only, and larger ones always have enough tokens.
    """
    n = len(s)
    if not n:
        return s
    errors = n - needed(n, share)
    count = counts[(s >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)]
    often = count > frequent if 4 * share[0] > 3 * share[1] else np.zeros(n, bool)
    if errors == 0 and n < 4 and 4 * share[0] > 3 * share[1]:
        return s[:0]
    order = np.lexsort((s, count))  # by count: rare tokens come before frequent ones
    rare = int(n - often.sum())
    if rare > errors:
        return s[order[: errors + 1]]
    out = [s[order[:rare]]]
    tail = s[order[rare:]]
    for groups in sorted({groups_of(m) for m in range(needed(n, share), n * share[1] // share[0] + 1)}):
        covered, members = rare, {}
        for token in tail.tolist():
            own = members.setdefault(token % groups, [])
            covered += bool(own)
            own.append(token)
            if covered > errors:
                break
        pairs = np.array([p for own in members.values() for p in itertools.combinations(sorted(own), 2)], np.uint64).reshape(-1, 2)
        out.append(mix(mix(pairs[:, 0] + np.uint64(groups)) * np.uint64(3) + pairs[:, 1]))
    return np.concatenate(out)


def bitmap(s: np.ndarray) -> bytes:
    """A parity bitmap: two sets differ in at least as many tokens as their bitmaps differ in bits."""
    bits = 1 << min(12, max(9, int(2 * len(s)).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(4095)).astype(np.int64), minlength=4096).reshape(-1, bits).sum(0) & 1).tobytes()


def linked(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether share[1] times the overlap is at least share[0] times the union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if share[1] * len(small) < share[0] * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return share[1] * both >= share[0] * (len(a) + len(b) - both)


def _of_hubs(first: DataFrame, hubs: DataFrame) -> DataFrame:
    """rep, n, mark for the marks that several sets have: told apart in the scan if they fit in a broadcast."""
    if not fits(hubs.count() * 8):
        return first.select("rep", "n", F.explode("marks").alias("mark"))  # the join with the hubs filters
    live = first.sparkSession.sparkContext.broadcast(np.sort(hubs.select("mark").toArrow()["mark"].to_numpy()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        owner, mark = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
        keep = live.value[np.minimum(np.searchsorted(live.value, mark), max(len(live.value) - 1, 0))] == mark if len(live.value) else np.zeros(len(mark), bool)
        at = pa.array(owner[keep])
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(mark[keep])], ["rep", "n", "mark"])

    return map_batches(first.select("rep", "n", "marks"), run, "rep long, n long, mark long")


def _sets_of(asked: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """rep and tokens binary: the whole sets of the stored ids asked for, made again from the texts of rows (id, text).

    Where rows of one id differ, each of their sets is given.
    """

    def set_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1).to_pylist(), width)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "tokens"])

    return stored(map_batches(join_measured(rows, asked, "id", "left_semi", 16), set_rows, "rep long, tokens binary"), "sets")


def _verified(pairs: DataFrame, rows: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, x, y = (batch.column(i) for i in range(4))
        keep = [linked(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64), share) for p, q in zip(x, y)]
        mask = pa.array(keep, pa.bool_())
        return pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    pairs = stored(pairs, "pairs")
    sets = _sets_of(stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids"), rows, width)
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return map_batches(both.select("a", "b", "x", "y"), run, "a long, b long")


def most_different(total: np.ndarray | int, share: tuple[int, int]) -> np.ndarray | int:
    """In how many tokens two linked sets can differ at most, by the sum of their sizes."""
    return total - 2 * -(-share[0] * total // (share[0] + share[1]))


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap folded to `size` bytes: it is the one that fewer buckets would have given."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), 0).view(np.uint64)


def _may_link(pairs: DataFrame, info: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow a link."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, n, m, x, y = batch.columns
        n, m = n.to_numpy(), m.to_numpy()
        may = share[1] * np.minimum(n, m) >= share[0] * np.maximum(n, m)
        limit = most_different(n + m, share)
        for i in np.flatnonzero(may).tolist():
            p, q = x[i].as_py(), y[i].as_py()
            size = min(len(p), len(q))
            may[i] = int(np.bitwise_count(folded(p, size) ^ folded(q, size)).sum()) <= limit[i]
        mask = pa.array(may)
        return pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    bits = info.select("rep", "n", "bits")
    both = join_measured(pairs, bits.toDF("a", "n", "x"), "a", "inner", F.octet_length("x") + 64)
    both = join_measured(both, bits.toDF("b", "m", "y"), "b", "inner", F.octet_length("y") + 64)
    return map_batches(both.select("a", "b", "n", "m", "x", "y"), run, "a long, b long")


def _candidates(group: pa.Table, share: tuple[int, int], same_block: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of two blocks of a bucket, each with those it may be linked to and is not known to be in one component with."""
    rep, n, comp, hub, block = (group[c].to_numpy() for c in ("rep", "n", "component", "hub", "block"))
    maps = group["bits"].to_pylist()
    sizes = np.array([len(m) for m in maps])
    for size in np.unique(sizes):
        # Bitmaps of other sizes are folded to the smaller one.
        own = np.flatnonzero(sizes == size)
        other = np.flatnonzero(sizes >= size)
        marks = np.stack([folded(maps[i], int(size)) for i in other])
        place = {int(i): k for k, i in enumerate(other)}
        for i in own.tolist():
            may = (comp[other] != comp[i]) & ((sizes[other] > size) | (rep[other] > rep[i])) & (rep[other] != hub[i]) & (rep[i] != hub[i])
            may &= (share[1] * np.minimum(n[other], n[i]) >= share[0] * np.maximum(n[other], n[i]))
            if not same_block:
                may &= block[other] != block[i]
            at = np.flatnonzero(may)
            if len(at):
                differ = np.bitwise_count(marks[at] ^ marks[place[i]]).sum(1)
                at = at[differ <= most_different(n[other[at]] + n[i], share)]
                if len(at):
                    yield i, other[at]


def _cross_pairs(group: pa.Table, share: tuple[int, int], same_block: bool, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The candidate pairs of two blocks; None if they are more than `most` for each row."""
    rep, found, count = group["rep"].to_numpy(), [], 0
    for i, at in _candidates(group, share, same_block):
        found.append((np.minimum(rep[at], rep[i]), np.maximum(rep[at], rep[i])))
        count += len(at)
        if count > most * len(rep):
            return None
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])


def _small_pairs(rows: dict[str, np.ndarray], maps: list[bytes], ends: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs within each of many small blocks, which end (exclusively) at `ends`: all at once, by distance."""
    rep, n, comp, hub, block, cross = (rows[c] for c in ("rep", "n", "component", "hub", "block", "cross"))
    owner = np.searchsorted(ends, np.arange(len(rep)), "right")
    there = np.flatnonzero(rep != hub)
    first, second, step = [], [], 1
    at = np.arange(len(there) - 1)
    while len(at):  # pairs `step` apart in the same block
        p, q = there[at], there[at + step]
        same = owner[p] == owner[q]
        at, p, q = at[same], p[same], q[same]
        may = (comp[p] != comp[q]) & (share[1] * np.minimum(n[p], n[q]) >= share[0] * np.maximum(n[p], n[q])) & (~cross[p] | (block[p] != block[q]))
        first.append(p[may])
        second.append(q[may])
        step += 1
        at = at[at + step < len(there)]
    p, q = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, second))
    sizes = np.array([len(m) for m in maps])
    least, limit, keep = np.minimum(sizes[p], sizes[q]), most_different(n[p] + n[q], share), np.zeros(len(p), bool)
    for size in np.unique(least):  # bitmaps of other sizes are folded to the smaller one
        pairs = np.flatnonzero(least == size)
        wanted, place = np.unique(np.r_[p[pairs], q[pairs]], return_inverse=True)
        marks = np.stack([folded(maps[i], int(size)) for i in wanted])
        keep[pairs] = np.bitwise_count(marks[place[: len(pairs)]] ^ marks[place[len(pairs) :]]).sum(1) <= limit[pairs]
    return np.minimum(rep[p[keep]], rep[q[keep]]), np.maximum(rep[p[keep]], rep[q[keep]])


def _spanning(group: pa.Table, share: tuple[int, int], same_block: bool) -> pa.Table:
    """Links of two blocks that join all their rows which links of these blocks can join, at most one for each row."""
    rep, comp, tokens = group["rep"].to_numpy(), group["component"].to_numpy().tolist(), group["tokens"].to_pylist()
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            above[x] = x = above.get(above[x], above[x])
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for i, at in _candidates(group, share, same_block):
        for j in at.tolist():
            a, b = top(comp[i]), top(comp[j])
            if a != b and linked(np.frombuffer(tokens[i], np.uint64), np.frombuffer(tokens[j], np.uint64), share):
                above[max(a, b)] = min(a, b)
                out[0].append(int(rep[i]))
                out[1].append(int(rep[j]))
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def _crossed(buckets: DataFrame, info: DataFrame, formed: DataFrame, rows: DataFrame, width: int, share: tuple[int, int], block: int, block_bytes: int, most: int) -> DataFrame:
    """Links (a, b) that join all sets of a bucket which are linked but still in different components.

    In each bucket the component with most members is the main one. Members of others are dealt to blocks and compared
    with all blocks, those of the main one with these blocks only: so a bucket in which few are left costs about as many
    rows as it has. Blocks hold about `block` rows and `block_bytes` of whole sets. Candidate pairs are verified outside;
    blocks with more than `most` for each row get the whole sets instead and give no more than a spanning forest.
    """
    labelled = buckets.where("size > 2").join(formed.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = stored(labelled.select("mark", "rep", "n", "hub", "component"), "labelled")
    per = labelled.groupBy("mark", "component").agg(F.count("*").alias("members"), F.sum(F.col("n") * 8 + 640).alias("bytes"))
    top = per.groupBy("mark").agg(F.max(F.struct("members", "bytes", "component")).alias("main"), F.count("*").alias("kinds"), F.sum("members").alias("size"), F.sum("bytes").alias("bytes")).where("kinds > 1")
    parts = lambda members, size: F.ceil(F.greatest(members / F.lit(block), size / F.lit(block_bytes))).cast("int")
    alone = (F.col("size") <= block) & (F.col("bytes") <= block_bytes)  # a bucket of one block needs no main component
    po = F.when(alone, 1).otherwise(parts(F.col("size") - F.col("main.members"), F.col("bytes") - F.col("main.bytes")))
    top = top.select("mark", "size", F.when(~alone, F.col("main.component")).alias("main"), po.alias("po"), F.when(alone, 0).otherwise(parts(F.col("main.members"), F.col("main.bytes"))).alias("pm"))
    dealt = join_spread(labelled, stored(top, "open"), ["mark"], "size").join(info.select("rep", "bits"), "rep")
    own = F.col("component").eqNullSafe(F.col("main"))
    dealt = dealt.withColumn("block", F.when(own, F.col("po") + F.pmod(F.xxhash64("rep"), F.col("pm"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("po"))).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(own, F.col("po")).otherwise(F.col("po") + F.col("pm")) - 1))).withColumns({"i": F.least("block", "with").cast("int"), "j": F.greatest("block", "with").cast("int")})
    schema = pa.schema([("mark", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("rep", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("hub", pa.int64()), ("bits", pa.binary())])
    dealt = dealt.select(*schema.names)
    out_names = ["a", "b", "mark", "i", "j"]

    def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = (pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], out_names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the block that has not ended
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None and held and all(held[-1].column(c)[-1] == batch.column(c)[-1] for c in range(3)):
                held.append(batch)
                continue
            parts = [*held, *([batch] if batch is not None else [])]
            if not parts:
                continue
            rows = pa.Table.from_batches(parts)
            keys = np.stack([rows.column(c).to_numpy() for c in range(3)], 1)
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            whole = len(keys) if batch is None else int(ends[-1]) if len(ends) else 0
            held = rows.slice(whole).to_batches()
            if not whole:
                continue
            ends = np.union1d(ends[ends <= whole], [whole])
            starts = np.r_[0, ends[:-1]]
            few = ends - starts <= 2 * most + 1  # no more than `most` pairs for each row
            for start, end in zip(starts[~few].tolist(), ends[~few].tolist()):
                pairs = _cross_pairs(rows.slice(start, end - start), share, keys[start, 1] == keys[start, 2], most)
                if pairs:
                    yield found(*pairs)
                else:
                    one = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([keys[start, c]], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32())))]
                    yield pa.RecordBatch.from_arrays(one, out_names)
            if few.any():
                at = np.concatenate([np.arange(s, e) for s, e in zip(starts[few].tolist(), ends[few].tolist())])
                own = rows.take(pa.array(at))
                columns = {c: own[c].to_numpy() for c in ("rep", "n", "component", "hub", "block")} | {"cross": keys[at, 1] != keys[at, 2]}
                yield found(*_small_pairs(columns, own["bits"].to_pylist(), np.cumsum((ends - starts)[few]), share))

    by_block = dealt.repartition("mark", "i", "j").sortWithinPartitions("mark", "i", "j")
    looked = stored(by_block.mapInArrow(look, "a long, b long, mark long, i int, j int"), "looked")
    links = _verified(looked.where("a is not null").select("a", "b").distinct(), rows, width, share)
    dense = looked.where("a is null").select("mark", "i", "j")
    full = dense.count()
    if not full:
        return links
    dealt = dealt.join(F.broadcast(dense) if fits(full * 24) else dense.hint("merge"), ["mark", "i", "j"])
    sets = _sets_of(stored(dealt.select(F.col("rep").alias("id")).distinct(), "ids"), rows, width)

    def span(key: tuple, group: pa.Table) -> pa.Table:
        return _spanning(group, share, key[1].as_py() == key[2].as_py())

    return links.union(dealt.join(sets, "rep").groupBy("mark", "i", "j").applyInArrow(span, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, width: int = 5, share: tuple[int, int] = (80, 100), block: int = 1024, block_bytes: int = 16 << 20, most: int = 8) -> DataFrame:
    """The components of all texts under links of at least share[0] / share[1] Jaccard similarity of word shingles.

    Returns a row per document: the id (as long), n_shingles long and component_id long, the smallest id reachable by
    links. Texts that are null or have no word have no shingles and link with nothing. Ids are taken to be unique but
    for repeated rows; rows with a null id are returned with their count and a null component. An empty table gives no
    rows. Other columns are not read. All links count: no bucket, partner or candidate is left out.

    Shingles are compared by 64-bit hashes: two different ones of a text or pair are taken for one with odds of about
    (shingles in both)^2 / 2^65. Texts with equal sets (by a 128-bit digest) are collapsed first, so copies make no
    pairs. Sets that share a signature make a bucket. In each bucket all sets are verified against the one with the
    smallest id, and components are formed. Only sets that are still in different components are then looked at, in
    blocks, as _crossed() says. A group of near copies costs about as many verifications as it has members; one whose
    members are mostly not linked is quadratic in work, but not in rows that come out of it.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    counts = sketch(rows, "text", width, sketch_bits(rows.count()))
    mean = counts.mean()
    frequent = int(mean + 8 * mean**0.5 + 256)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1).to_pylist(), width)
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        marks = [signatures(s, counts, frequent, share).view(np.int64) for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(list(map(bitmap, sets)), pa.binary()), pa.array(marks, pa.list_(pa.int64()))], ["id", "n", "digest", "bits", "marks"]
        )

    described = placed(map_batches(rows, describe, "id long, n long, digest binary, bits binary, marks array<long>"), "described")
    own = described.where("id is not null and digest is not null")
    reps = own.groupBy("digest").agg(F.min(F.struct("id", "_seq")).alias("first"), F.count("*").alias("copies"))
    reps = stored(reps.select("digest", F.col("first.id").alias("rep"), F.col("first._seq").alias("chosen"), "copies"), "reps")
    copied = reps.where("copies > 1")
    if fits(copied.count() * 64):
        first = own.join(F.broadcast(copied.select("digest", "chosen")), "digest", "left").where("chosen is null or chosen = _seq")
    else:  # by row, as a digest may have most of the rows
        first = own.join(reps.select(F.col("chosen").alias("_seq")).hint("merge"), "_seq", "left_semi")
    first = first.select(F.col("id").alias("rep"), "n", "bits", "marks")
    hubs = first.select("rep", F.explode("marks").alias("mark")).groupBy("mark").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    hubs = stored(hubs, "hubs")
    buckets = stored(_of_hubs(first, hubs).join(hubs, "mark"), "buckets")
    info = stored(join_measured(first.select("rep", "n", "bits"), stored(buckets.select("rep").distinct(), "wanted"), "rep", "left_semi", 16), "info")
    stars = _may_link(buckets.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), info, share)
    links = stored(_verified(stars, rows, width, share), "stars")
    more = _crossed(buckets, info, components(links), rows, width, share, block, block_bytes, most)
    found = components(links.union(more))
    rep_component = stored(reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "copies", F.coalesce("component", "rep").alias("component_id")), "classes")
    out = join_spread(own.select("id", "n", "digest"), rep_component, ["digest"], "copies").select("id", "n", "component_id")
    out = out.union(described.where("id is null or digest is null").select("id", "n", "id"))
    return out.toDF(id_col, "n_shingles", "component_id")
