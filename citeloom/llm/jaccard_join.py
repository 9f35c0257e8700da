"""Links of documents by the Jaccard similarity of their word n-grams: a prefix join of groups.

A document is its set of shingles, by 64-bit hashes.  Equal sets are one node.  Under one order of all shingles (rare ones
first, by a table of counts of fixed size; the order only costs or saves time), two sets with 100 |x & y| >= t |x | y|
share a shingle among the first n - ceil(t n / 100) + 1 of each.  Nodes with the same prefix and size are one group, and
groups meet under each shingle of their prefix:

1. Under each shingle, groups meet the smallest group whose size allows a link (a centre).  Sizes, places in the prefix
   and parity bitmaps rule pairs out, the sets of the rest are compared, and links join nodes into components.
2. Pairs of groups under a shingle that aren't in one component yet meet the same filters, at the first shingle that their
   prefixes share; what passes is expanded to the groups' members, which are compared.

A large bucket is cut into blocks, and pairs of blocks are dealt out.  A pair that step 2 leaves out is in one component
already, so no link between components is lost, while copies and their variants don't meet pair by pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

#: Log of the number of counters that order shingles, counters of a row, 64-bit words of a parity bitmap.
COUNTERS, ROW, WORDS = 22, 4096, 16
#: Centres that a bucket tries, groups of a block, wanted documents up to which their handles are broadcast.
CENTRES, SIDE, FEW = 8, 2048, 500_000
#: Odd multipliers of the hash of a shingle, by place.
MIX = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: By byte: its code, A-Z as a-z; -1 for the six white ones.  Places of a word with random numbers of their own, and these.
LETTER = np.array([-1 if b in b" \t\n\r\x0b\x0c" else bytes([b]).lower()[0] for b in range(256)], np.int16)
PLACES = 32
RANDOM = np.random.default_rng(42).integers(0, 1 << 64, PLACES * 256, np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, A-Z as a-z: the sum of a random number for each of its bytes and places."""
    codes = LETTER[np.frombuffer(text, np.uint8)]
    inside = np.flatnonzero(codes >= 0)
    if not len(inside):
        return np.zeros(0, np.uint64)
    codes = codes[inside]
    new = np.concatenate([[True], inside[1:] != inside[:-1] + 1])
    first = np.flatnonzero(new)
    place = np.arange(len(inside), dtype=np.int32) - np.repeat(first.astype(np.int32), np.diff(np.append(first, len(inside))))
    each = RANDOM[(place & (PLACES - 1)) * 256 + codes]
    if len(far := np.flatnonzero(place >= PLACES)):  # each further run of places has numbers of its own
        mixed = (each[far] ^ place[far].astype(np.uint64) // np.uint64(PLACES)) * MIX[7]
        each[far] = (mixed ^ (mixed >> np.uint64(32))) * MIX[11]
    return np.add.reduceat(each, first)


def shingles(text: bytes | None, size: int = 4) -> np.ndarray:
    """The hashes of the distinct shingles in ascending order; fewer words than ``size`` are one, none give none."""
    each = word_hashes(text or b"")
    if not len(each):
        return each
    k = min(size, len(each))
    n = len(each) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ each[i : i + n]) * MIX[i]
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def parity(found: np.ndarray) -> np.ndarray:
    """A bitmap of the parities of the set's members: one that two sets don't share turns one bit at most."""
    odd = np.bincount(((found >> np.uint64(20)) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def lists(each: list[np.ndarray]) -> pa.ListArray:
    """Arrays of longs as one list column."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]).astype(np.int32)), pa.array(np.concatenate(each) if each else np.zeros(0, np.int64)))


def least_shared(n: Column | np.ndarray, m: Column | np.ndarray, t: int):
    """Shingles that sets of n and m members share at least, if they link: ceil(t (n + m) / (100 + t))."""
    if isinstance(n, Column):
        return F.ceil((n + m) * t / (100 + t) - 1e-9)
    return -(-(n + m) * t // (100 + t))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text binary, handle): the handle finds a row's text again."""
    return common.texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("handle"))


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """A row a document (doc_id, handle, n, key, bits), then the task's counters in rows (n null; doc_id a row's number, key its counters)."""
    names = ["doc_id", "handle", "n", "key", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTERS, np.uint32)
        for batch in batches:
            for part in common.slices(batch, 1, 1024, 8 << 20):
                ns, keys, bits, cells = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, size)
                    cells.append((found >> np.uint64(64 - COUNTERS)).astype(np.int32))
                    ns.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    bits.append(parity(found))
                cell = np.sort(np.concatenate(cells))  # counters are met in order, not all over the table
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else cell
                counters[cell[first]] += np.diff(np.append(first, len(cell))).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), lists(bits)], names)
        rows = counters.reshape(-1, ROW)
        some = np.flatnonzero(rows.any(1))
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(some), none, none, pa.array([zlib.compress(rows[i].tobytes(), 1) for i in some], pa.binary()), pa.nulls(len(some), pa.list_(pa.int64()))], names)

    return _texts(docs).select("doc_id", "text", "handle").mapInArrow(run, "doc_id long, handle long, n long, key binary, bits array<long>")


def _weights(profiles: DataFrame) -> np.ndarray:
    """The counters of all tasks together: 2^COUNTERS of 16 bits, whatever the size of the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.minimum(sums, 65535).astype(np.uint16).tobytes()], pa.binary())], ["row", "sums"])
        for batch in batches:
            for row, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if row != at:
                    if at is not None:
                        yield out()
                    at, sums = row, np.zeros(ROW, np.int64)
                sums += np.frombuffer(zlib.decompress(packed), np.uint32)
        if at is not None:
            yield out()

    rows = profiles.where("n is null").select(F.col("doc_id").alias("row"), "key").repartition("row").sortWithinPartitions("row").mapInArrow(add, "row long, sums binary").collect()
    weights = np.zeros(1 << COUNTERS, np.uint16)
    for r in rows:
        weights[r["row"] * ROW : (r["row"] + 1) * ROW] = np.frombuffer(r["sums"], np.uint16)
    return weights


def _prefixes(docs: DataFrame, weights: np.ndarray, size: int, t: int) -> DataFrame:
    """(handle, key, n, group_key, prefix): the first shingles of each set in the order of weight and hash."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = ["handle", "key", "n", "group_key", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            for part in common.slices(batch, 1, 1024, 8 << 20):
                handles, keys, ns, groups, prefixes = [], [], [], [], []
                for handle, text in zip(*(c.to_pylist() for c in part.columns)):
                    found = shingles(text, size)
                    n = len(found)
                    if n:
                        order = np.argsort(weight[(found >> np.uint64(64 - COUNTERS)).astype(np.int64)], kind="stable")  # ties stay by hash
                        prefix = found[order[: n + t * n // -100 + 1]].view(np.int64)
                        handles.append(handle)
                        keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                        ns.append(n)
                        groups.append(xxhash.xxh3_128_digest(prefix.tobytes(), n % (1 << 32)))
                        prefixes.append(prefix)
                yield pa.RecordBatch.from_arrays([pa.array(handles, pa.int64()), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(groups, pa.binary()), lists(prefixes)], names)

    return _texts(docs).select("handle", "text").mapInArrow(run, "handle long, key binary, n long, group_key binary, prefix array<long>")


def _buckets(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray | pa.Array], np.ndarray]]:
    """Batches with whole buckets (runs of the first ``keys`` columns), and where each bucket begins; more than one row a bucket."""
    held: list[pa.RecordBatch] = []

    def whole(table: pa.Table) -> tuple[list, np.ndarray]:
        columns = [c.combine_chunks() for c in table.columns]
        marks = [c.to_numpy() for c in columns[:keys]]
        new = np.concatenate([[True], np.logical_or.reduce([m[1:] != m[:-1] for m in marks])]) if len(table) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        sizes = np.diff([*starts, len(table)])
        keep = np.repeat(sizes > 1, sizes)
        columns = [c.filter(pa.array(keep)) for c in columns]
        return columns, np.cumsum([0, *sizes[sizes > 1]])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = [c[-1].as_py() for c in batch.columns[:keys]]
        if held and [c[-1].as_py() for c in held[-1].columns[:keys]] == last and [c[0].as_py() for c in batch.columns[:keys]] == last:
            held.append(batch)  # all of one bucket that goes on
            continue
        table = pa.Table.from_batches([*held, batch])
        same = np.logical_and.reduce([table.column(i).to_numpy() == last[i] for i in range(keys)])
        cut = int(np.argmax(same))
        if cut:
            yield whole(table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held:
        yield whole(pa.Table.from_batches(held))


def _drop_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns, _ in _buckets(batches, 1):
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays(columns, ["token", "item", "n", "pos"])


def possible(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    """Whether sets of n and m members may link whose first shared shingle is at places i and j at the latest."""
    return (100 * np.minimum(n, m) >= t * np.maximum(n, m)) & (1 + np.minimum(n - i, m - j) - 1 >= least_shared(n, m, t))


def _centre_pairs(t: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by token, size and item.  (u, v): a bucket's centres and what may link to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, cuts in _buckets(batches, 1):
            _, item, n, pos = (c.to_numpy() for c in columns)
            us, vs = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rest = np.arange(a, b)
                for _ in range(CENTRES):
                    if len(rest) < 2:
                        break
                    u, rest = rest[0], rest[1:]
                    fits = possible(n[u], n[rest], pos[u], pos[rest], t)
                    if fits.any():
                        vs.append(item[rest[fits]])
                        us.append(np.full(len(vs[-1]), item[u]))
                        rest = rest[~fits]
            if us:
                pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    return run


def _still_apart(t: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows (token, item, n, pos, comp) that may link to one of another component under their token; comp -1: of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, cuts in _buckets(batches, 1):
            _, item, n, pos, comp = (c.to_numpy() for c in columns)
            keep = np.zeros(len(item), bool)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                c = comp[a:b]
                if (c == c[0]).all() and c[0] >= 0:
                    continue
                if b - a > 2 * SIDE:  # pairs of blocks are looked at later
                    keep[a:b] = True
                    continue
                for i in range(a, b, 256):
                    j = min(b, i + 256)
                    fits = possible(n[i:j, None], n[None, a:b], pos[i:j, None], pos[None, a:b], t) & ((comp[i:j, None] != c) | (c == -1)) & (item[i:j, None] != item[a:b])
                    keep[i:j] = fits.any(1)
            if keep.any():
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([x.filter(mask) for x in columns], ["token", "item", "n", "pos", "comp"])

    return run


def _apart_pairs(t: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a cell (token, i, j, b, item, n, pos, comp, bits, before) come together.  (u, v): pairs of other components
    that sizes, places and bitmaps allow, under the first token that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, cuts in _buckets(batches, 3):
            token, i_, j_, b_, item, n, pos, comp = (c.to_numpy() for c in columns[:8])
            known = columns[8].is_valid().to_numpy(zero_copy_only=False)
            maps = np.zeros((len(item), WORDS), np.uint64)  # signed numbers count the bits of their absolute value
            maps[known] = columns[8].flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
            before: dict[int, frozenset] = {}
            us, vs = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                cell = np.arange(a, b)
                left, right = cell[b_[a:b] == i_[a]], cell[b_[a:b] == j_[a]]
                for k in range(0, len(left), 256):
                    one = left[k : k + 256]
                    fits = possible(n[one, None], n[None, right], pos[one, None], pos[None, right], t) & ((comp[one, None] != comp[right]) | (comp[right] == -1))
                    if i_[a] == j_[a]:
                        fits &= one[:, None] < right
                    x, y = np.nonzero(fits)
                    x, y = one[x], right[y]
                    room = n[x] + n[y] - 2 * least_shared(n[x], n[y], t)
                    near = ~(known[x] & known[y]) | (np.bitwise_count(maps[x] ^ maps[y]).sum(1) <= room)
                    for p, q in zip(x[near].tolist(), y[near].tolist()):
                        for r in (p, q):
                            if r not in before:
                                before[r] = frozenset(columns[9][r].as_py())
                        if before[p].isdisjoint(before[q]):
                            us.append(min(item[p], item[q]))
                            vs.append(max(item[p], item[q]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _close(rows: DataFrame, t: int) -> DataFrame:
    """Pairs (u, v) of ``rows`` (token, item, n, pos, comp, bits, before) by ``_apart_pairs``; large buckets in blocks."""
    counts = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("blocks"))
    dealt = rows.join(counts, "token").withColumn("b", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("b", "x"), "j": F.greatest("b", "x")})
    cells = cells.select("token", "i", "j", "b", "item", "n", "pos", "comp", "bits", "before")
    return cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_apart_pairs(t), "u long, v long")


def _differ(a: str, b: str) -> Column:
    """How many bits of two parity bitmaps differ at least; 0 where one is missing."""
    bits = [F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(WORDS)]
    total = bits[0]
    for x in bits[1:]:
        total = total + x
    return F.coalesce(total, F.lit(0))


class Join:
    """The tables of one run, in the shared scratch folder."""

    def __init__(self, spark: SparkSession, docs: DataFrame, size: int, t: int):
        self.spark, self.docs, self.size, self.t = spark, docs, size, t
        self.scratch = common.Scratch(spark, "jaccard")
        save = self.scratch.save
        self.profiles = save(_profiles(docs, size))
        nodes = self.profiles.where("n > 0").groupBy("key").agg(F.min(F.struct("handle", "n", "bits")).alias("m"), F.min("doc_id").alias("first"))
        self.nodes = save(nodes.select("key", "m.handle", "m.n", "m.bits", "first", F.monotonically_increasing_id().alias("node")))
        prefixes = _prefixes(docs, _weights(self.profiles), size, t).dropDuplicates(["handle", "key"])
        members = save(self.nodes.join(prefixes.select("handle", "key", "group_key", "prefix"), ["handle", "key"]).select("node", "n", "bits", "group_key", "prefix"))
        grouped = members.groupBy("group_key").agg(F.min(F.struct("node", "n", "bits", "prefix")).alias("m"), F.count(F.lit(1)).alias("of"))
        grouped = save(grouped.select("group_key", F.col("m.node").alias("item"), "m.n", F.when(F.col("of") == 1, F.col("m.bits")).alias("bits"), "m.prefix", "of"))
        self.groups = grouped.select("item", "n", "bits", "prefix")
        several = grouped.where("of > 1").select("group_key", "item")
        self.several = save(members.join(several, "group_key").select("item", "node", "n", "bits"))  # members of groups of several
        index = self.groups.select(F.posexplode("prefix").alias("pos", "token"), "item", "n").select("token", "item", "n", F.col("pos").cast("long").alias("pos"))
        self.shared = save(index.repartition("token").sortWithinPartitions("token").mapInArrow(_drop_single, "token long, item long, n long, pos long"))
        self.scratch.drop(members)

    def by_token(self, rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition("token").sortWithinPartitions("token", "n", "item").select("token", "item", "n", "pos", *keys)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs of nodes (u, v) whose sets link."""
        pairs = self.scratch.save(pairs)
        t, size = self.t, self.size
        wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        wanted = self.scratch.save(wanted.join(self.nodes.select("node", "handle", "key"), "node"))
        handles = wanted.select("handle").distinct()
        texts = _texts(self.docs).select("handle", "text").join(F.broadcast(handles) if wanted.count() <= FEW else handles, "handle", "left_semi")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.slices(batch, 1, 256, 4 << 20):
                    found = [shingles(x, size).tobytes() for x in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in found], pa.binary()), pa.array(found, pa.binary())], ["handle", "key", "members"])

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                us, vs = [], []
                for u, v, a, b in zip(*batch.columns):
                    x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= t * (len(x) + len(y) - both):
                        us.append(u.as_py())
                        vs.append(v.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        found = texts.mapInArrow(sets, "handle long, key binary, members binary").dropDuplicates(["handle", "key"])
        found = self.scratch.save(found.join(wanted, ["handle", "key"]).select("node", "members"))
        one = pairs.join(found.select(F.col("node").alias("v"), F.col("members").alias("b")), "v")
        met = one.join(found.select(F.col("node").alias("u"), F.col("members").alias("a")), "u")  # a centre of many is split by its rows' size
        out = self.scratch.save(met.select("u", "v", "a", "b").mapInArrow(linked, "u long, v long"))
        for done in (pairs, wanted, found):
            self.scratch.drop(done)
        return out

    def central_links(self) -> DataFrame:
        pairs = self.by_token(self.shared).mapInArrow(_centre_pairs(self.t), "u long, v long").distinct()
        of = lambda c: self.groups.select(F.col("item").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
        n, m = F.col("nu"), F.col("nv")
        near = pairs.join(of("u"), "u").join(of("v"), "v").where(_differ("bu", "bv") <= n + m - 2 * least_shared(n, m, self.t))
        within = self.several.where("item <> node").select(F.col("item").alias("u"), F.col("node").alias("v"))
        return self.verified(near.select("u", "v").unionByName(within))

    def other_links(self, links: DataFrame) -> DataFrame:
        """Links between components of ``links``."""
        comps = self.scratch.save(components(self.spark, links).select("node", F.col("component").alias("comp")))
        several = self.several.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = several.groupBy("item").agg(F.when(F.min("comp") == F.max("comp"), F.min("comp")).otherwise(F.lit(-1)).alias("mixed"))
        of_group = self.groups.select("item").join(comps.withColumnRenamed("node", "item"), "item", "left").join(mixed, "item", "left")
        of_group = of_group.select("item", F.coalesce("mixed", "comp", "item").alias("comp"))
        apart = self.by_token(self.shared.join(of_group, "item"), "comp").mapInArrow(_still_apart(self.t), "token long, item long, n long, pos long, comp long")
        rows = self.scratch.save(apart.join(self.groups.select("item", "bits", "prefix"), "item").select("token", "item", "n", "pos", "comp", "bits", F.slice("prefix", F.lit(1), F.col("pos").cast("int")).alias("before")))
        pairs = _close(rows, self.t)
        nodes = several.select("item", "node")
        side = lambda c: nodes.select(F.col("item").alias(c), F.col("node").alias(f"node_{c}"))
        pairs = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left").select(F.coalesce("node_u", "u").alias("u"), F.coalesce("node_v", "v").alias("v"))
        inside = several.join(mixed.where("mixed = -1"), "item").select(
            F.col("item").alias("token"), F.col("node").alias("item"), "n", F.lit(0).cast("long").alias("pos"), "comp", "bits", F.array().cast("array<long>").alias("before")
        )
        pairs = pairs.unionByName(_close(inside, self.t))
        comp = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
        pairs = pairs.join(comp("u"), "u", "left").join(comp("v"), "v", "left").where(F.coalesce("comp_u", "u") != F.coalesce("comp_v", "v"))
        return self.verified(pairs.select("u", "v"))


def classes(spark: SparkSession, docs: DataFrame, size: int = 4, threshold: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when 100 |x & y| >= threshold |x | y|, for sets of shingles.

    component_id is the smallest doc_id that links reach, the document itself included.  Null texts and texts without a
    word have no shingle and link with nothing.  Rows that repeat a doc_id each stay and link by their own text; rows
    without a doc_id link like others, and a component of such rows alone has a null component_id.  Other columns are not
    read; an empty table gives no row.
    """
    join = Join(spark, docs, size, threshold)
    links = join.central_links()
    links = join.scratch.save(links.unionByName(join.other_links(links)))
    comps = components(spark, links)
    rooted = join.scratch.save(join.nodes.select("node", "key", "first").join(comps, "node", "left").withColumn("root", F.coalesce("component", "node")).select("key", "root", "first"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_key = join.scratch.save(rooted.join(least, "root").select("key", "component_id"))
    every = join.profiles.where("n is not null")
    with_words = every.where("n > 0").join(of_key, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.unionByName(every.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
