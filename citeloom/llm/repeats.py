"""Repeated passages, by interval trees over a sparse enhanced suffix array that Spark partitions by content.

A window is SPAN bytes.  Its anchor is the GRAM-byte string in it with the least hash, the leftmost of equals: the
window's content alone decides it, so equal windows have equal anchors at equal offsets.  Consecutive windows of one
anchor form a segment, whose bytes are all that those windows need.  So

1. segments whose anchor no other segment has cannot repeat, and go (a count by anchor, a semi-join);
2. segments that occur twice or more as a whole repeat with all their windows (a count by anchor and segment);
3. where an anchor has several different segments, one of each meets the others: they are sorted by the bytes from the
   anchor on (the suffix array of that anchor), a scan with a stack over common-prefix lengths gives the tree of its
   intervals, and in every interval the same scan over the reversed bytes before the anchor tells where members part to
   the left.  An interval with its left node is a maximal repeat around the anchor: all its occurrences have it, and it
   extends neither way.  Those of SPAN bytes or more are removed.

An anchor with more than CROWD different segments isn't gathered in a task: its segments' windows are counted by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPAN, GRAM, CROWD = 200, 64, 2_000
#: Bytes that are hashed at a time: short documents together, a longer one in overlapping parts.
CHUNK = 1 << 20
#: Up to so many documents' ranges are broadcast to the texts; beyond, both are shuffled.
FEW = 300_000
FACTOR = 0x9E3779B97F4A7C15 | 1
#: The bits of a hash that rank a string; a string's place breaks ties in the others.
HIGH = np.uint64(0xFFFFFFFF00000000)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR ** i and its inverse modulo 2 ** 64."""
    up, down = np.full(n, FACTOR, np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours: block by block from both ends."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(texts: list[bytes], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor) of every segment: positions in their text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = (np.zeros(0, np.int64),) * 4
    windows = np.maximum(sizes - span + 1, 0)
    if not windows.sum():
        return none
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    count = len(data) - gram + 1
    order = (mixed((sums[gram:] - sums[:count]) * down[:count]) & HIGH) | np.arange(count, dtype=np.uint64)
    least = sliding_least(order, span - gram + 1) & ~HIGH
    owner = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
    anchor = least[at].astype(np.int64)
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])  # an anchor lies in its text: texts part as well
    lasts = np.concatenate([firsts[1:], [len(at)]]) - 1
    who = owner[firsts]
    return who, at[firsts] - starts[who], at[lasts] - starts[who], anchor[firsts] - starts[who]


def signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = xxhash.xxh3_64_intdigest

    def flush(ids: list, bases: list[int], texts: list[bytes]) -> pa.RecordBatch:
        who, lo, hi, anchor = segments(texts)
        base = np.array(bases, np.int64)[who]
        keys, whole = np.zeros(len(who), np.uint64), np.zeros(len(who), np.uint64)
        for k, (w, a, b, p) in enumerate(zip(who.tolist(), lo.tolist(), hi.tolist(), anchor.tolist())):
            t = texts[w]
            keys[k], whole[k] = hashed(t[p : p + GRAM]), hashed(t[a : b + SPAN], (p - a) & 0xFFFF)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()).take(pa.array(who)), *(pa.array((x + base).astype(np.int32)) for x in (lo, hi, anchor)), pa.array(keys.view(np.int64)), pa.array(whole.view(np.int64))],
            ["row", "lo", "hi", "anchor", "key", "seg"],
        )

    ids, bases, texts, size = [], [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):
            raw = bytes_of(t.as_py())
            for base in range(0, len(raw) - SPAN + 1, CHUNK):  # a long text in parts, each with the windows that start in it
                ids.append(i.as_py())
                bases.append(base)
                texts.append(raw[base : base + CHUNK + SPAN - 1])
                size += len(texts[-1])
                if size >= CHUNK:
                    yield flush(ids, bases, texts)
                    ids, bases, texts, size = [], [], [], 0
    if ids:
        yield flush(ids, bases, texts)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def interval_tree(strings: list[bytes]) -> list[tuple[int, int, int]]:
    """(first, last, length): the intervals of sorted strings that share a prefix of ``length``, which none outside shares
    and not all inside extend.  One scan over the common-prefix lengths of neighbours, with a stack of open intervals."""
    out, stack = [], []
    n = len(strings)
    for k in range(1, n + 1):
        size = common_prefix(strings[k - 1], strings[k]) if k < n else -1
        first = k - 1
        while stack and stack[-1][1] > size:
            first, length = stack.pop()
            out.append((first, k - 1, length))
        if size >= 0 and (not stack or stack[-1][1] < size):
            stack.append((first, size))
    return out


def maximal_repeats(rows: list[tuple[bytes, bytes]], span: int = SPAN) -> Iterator[tuple[int, int, list[int]]]:
    """(before, after, members): the maximal repeats of ``span`` bytes or more around one anchor, with all occurrences.

    rows: (reversed bytes before the anchor, bytes from it on), sorted by the second.  Members are row numbers.
    """
    for first, last, after in interval_tree([r[1] for r in rows]):
        if after < span - max(len(rows[k][0]) for k in range(first, last + 1)):
            continue
        inside = sorted(range(first, last + 1), key=lambda k: rows[k][0])
        for a, b, before in interval_tree([rows[k][0] for k in inside]):  # a node is left-diverse: its members part there
            if before + after >= span:
                yield before, after, inside[a : b + 1]


RANGES = "row long, a int, b int"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, back, front, row, anchor) sorted by (key, front); a key may go on in the next batch."""
    key, rows = None, []

    def solve(rows: list, out: list) -> None:
        if len(rows) < 2:
            return
        best: dict[int, tuple[int, int]] = {}  # a row's repeats all hold its anchor: together they are one range
        for before, after, members in maximal_repeats([(r[1], r[2]) for r in rows]):
            for k in members:
                b, a = best.get(k, (0, 0))
                best[k] = max(b, before), max(a, after)
        out.extend((rows[k][3], rows[k][4] - before, rows[k][4] + after) for k, (before, after) in best.items())

    for batch in batches:
        out: list = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != key:
                solve(rows, out)
                key, rows = row[0], []
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32())], ["row", "a", "b"])
    out = []
    solve(rows, out)
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32())], ["row", "a", "b"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, segments) to one row a segment, with its bytes before (reversed) and from its anchor."""
    names = ["key", "back", "front", "row", "anchor", "lo", "hi", "kinds"]
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            out = []
            for i, text, parts in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns)):
                t = bytes_of(text)
                out += [(s["key"], t[s["lo"] : s["anchor"]][::-1], t[s["anchor"] : s["hi"] + SPAN], i, s["anchor"], s["lo"], s["hi"], s["kinds"]) for s in parts if s["hi"] + SPAN <= len(t)]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a segment, by two hashes of its bytes."""
    one, two = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
    for batch in batches:
        for key, back, front, i, anchor, lo, hi, _ in zip(*(c.to_pylist() for c in batch.columns)):
            t = back[::-1] + front
            parts = [t[s : s + SPAN] for s in range(hi - lo + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([signed(one(p)) for p in parts], pa.int64()), pa.array([signed(two(p)) for p in parts], pa.int64()), pa.array([i] * len(parts), pa.int64()), pa.array(range(lo, hi + 1), pa.int32())],
                ["w1", "w2", "row", "a"],
            )


def told_apart(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row is a 64-bit hash of both, so that rows of one doc_id, or of none, are told apart by text."""
    return common.texts(docs).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def _met(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shared, kinds, contexts): segments whose anchor others have, the different ones among them, and of anchors with
    several different ones the bytes around the anchor."""
    scratch = common.Scratch(spark, "repeats")
    texts = told_apart(docs).select("row", "text").where(f"octet_length(text) >= {SPAN}")
    found = texts.mapInArrow(_segmented, "row long, lo int, hi int, anchor int, key long, seg long")
    again = found.groupBy("key").count().where("count > 1").select("key")
    shared = scratch.save(found.join(again, "key", "left_semi"))
    kinds = scratch.save(shared.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "lo", "hi", "anchor")).alias("one")))
    # a written table: joined with it, a key with many kinds is a shuffle partition that Spark can split
    mixed_keys = scratch.save(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    meeting = kinds.join(mixed_keys, "key").select("one.row", F.struct("key", "one.lo", "one.hi", "one.anchor", "kinds").alias("part"))
    asked = meeting.groupBy("row").agg(F.collect_list("part").alias("parts"))  # a document's own segments: bounded by its text
    contexts = scratch.save(texts.join(asked, "row").select("row", "text", "parts").mapInArrow(_contexts, "key long, back binary, front binary, row long, anchor int, lo int, hi int, kinds long"))
    return shared, kinds, contexts


def _crowded(contexts: DataFrame) -> DataFrame:
    """(w1, w2, row, a): the windows of crowded anchors that occur twice or more."""
    crowd = contexts.where(F.col("kinds") > CROWD).mapInArrow(_windows, "w1 long, w2 long, row long, a int")
    twice = crowd.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    return crowd.join(twice, ["w1", "w2"], "left_semi")


def repeated_ranges(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, a, b): byte ranges that windows with another occurrence cover; ranges of a row may overlap.

    ``row`` is that of ``told_apart``.
    """
    shared, kinds, contexts = _met(spark, docs)
    copied = kinds.where("n > 1").select("key", "seg")
    whole = shared.join(copied, ["key", "seg"], "left_semi").select("row", F.col("lo").alias("a"), (F.col("hi") + SPAN).alias("b"))
    few = contexts.where(F.col("kinds") <= CROWD).select("key", "back", "front", "row", "anchor")
    met = few.repartition("key").sortWithinPartitions("key", "front").mapInArrow(_ranges, RANGES)
    crowded = _crowded(contexts).select("row", "a", (F.col("a") + SPAN).alias("b"))
    return whole.unionByName(met).unionByName(crowded)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, back, front) sorted by (key, front) to maximal repeats: (content, size, key, seg, before) of each member."""
    key, rows = None, []
    digest, hashed = xxhash.xxh3_128_hexdigest, xxhash.xxh3_64_intdigest
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32())

    def solve() -> list:
        out = []
        for before, after, members in maximal_repeats(rows) if len(rows) > 1 else ():
            back, front = rows[members[0]]
            content = digest(back[:before][::-1] + front[:after])
            out += [(content, before + after, key, signed(hashed(rows[k][0][::-1] + rows[k][1], len(rows[k][0]) & 0xFFFF)), before) for k in members]
        return out

    for batch in batches:
        out: list = []
        for k, back, front in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                out += solve()
                key, rows = k, []
            rows.append((back, front))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["content", "size", "key", "seg", "before"])
    out = solve()
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["content", "size", "key", "seg", "before"])


def repeat_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(content, size, doc_id, row, start): maximal repeats of SPAN bytes or more with all their occurrences, a row each.

    A group is the places of one content (named by its hash).  It is maximal around its anchor: within the windows that
    share the anchor, not all occurrences extend alike to either side.  A longer repeat, of several anchors, shows as the
    parts that each anchor's windows cover.  Segments that only occur as a whole are groups themselves, and of crowded
    anchors each repeated window is one.
    """
    shared, kinds, contexts = _met(spark, docs)
    few = contexts.where(F.col("kinds") <= CROWD).select("key", "back", "front")
    members = few.repartition("key").sortWithinPartitions("key", "front").mapInArrow(_groups, "content string, size int, key long, seg long, before int")
    tree = members.join(shared, ["key", "seg"]).select("content", "size", "row", (F.col("anchor") - F.col("before")).alias("start"))
    name = lambda a, b: F.concat(F.lower(F.hex(a)), F.lit("-"), F.lower(F.hex(b)))
    copied = shared.join(kinds.where("n > 1").select("key", "seg"), ["key", "seg"], "left_semi")
    whole = copied.select(name("key", "seg").alias("content"), (F.col("hi") + SPAN - F.col("lo")).alias("size"), "row", F.col("lo").alias("start"))
    windows = _crowded(contexts).select(name("w1", "w2").alias("content"), F.lit(SPAN).alias("size"), "row", F.col("a").alias("start"))
    found = tree.unionByName(whole).unionByName(windows).distinct()
    return found.join(told_apart(docs).select("row", "doc_id"), "row").select("content", "size", "doc_id", "row", "start")


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _join_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"a": a, "b": b} for a, b in joined([(r["a"], r["b"]) for r in x])] for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], ["row", "ranges"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            out = []
            for i, text, ranges in zip(*(c.to_pylist() for c in batch.slice(k, 512).columns)):
                t = bytes_of(text)
                spans = [(r["a"], min(r["b"], len(t))) for r in ranges or () if r["a"] < len(t)]
                cuts = [0, *(x for s in spans for x in s), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                out.append((i, len(t), len(t) - len(kept), len(spans), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row of ``docs``.

    A byte goes if a SPAN-byte string over it starts anywhere else too, in this row or another.  Null and empty texts lose
    nothing.  Rows that repeat a doc_id, and rows without one, are documents of their own: each loses what its own text
    repeats, and what it has counts as another place for all others.
    """
    scratch = common.Scratch(spark, "cut")
    found = repeated_ranges(spark, docs).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))  # bounded by the text
    ranges = scratch.save(found.mapInArrow(_join_ranges, "row long, ranges array<struct<a: int, b: int>>"))
    n = ranges.agg(F.count(F.lit(1)), F.sum(F.size("ranges"))).first()
    ranges = F.broadcast(ranges) if n[0] <= FEW and (n[1] or 0) <= 4 * FEW else ranges
    return told_apart(docs).join(ranges, "row", "left").select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
