"""SimHash near-duplicates, found with the perfect Golay code as a fuzzy hash.

A fingerprint's 64 bits are cut into three segments (22, 21, 21 bits, each padded to 23).  In the binary Golay code
every 23-bit word is within 3 bits of exactly one codeword, its primary; the codewords within 4 bits (at most six) are
its wide keys.  Words one bit apart: the primary of one is a wide key of the other.  Words two bits apart share a wide
key (the primary of the word between them).  Four errors over three segments leave, by pigeonhole, either

* one segment without error and another with two at most: key = the exact segment and a wide key of the other; or
* errors in all three, as 2-1-1 or fewer: key = one wide key of each segment, at least one of them a primary.

So fingerprints within 4 bits share a key, and pairs that share one are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS = 4
#: Broadcast up to so many groups; beyond, Spark joins by shuffle.
FEW = 500_000
#: Buckets of more fingerprints are cut further.
CROWD = 1_000
#: Fixed value: generator polynomial of the (23, 12) Golay code.
GOLAY = 0b110001110101
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bit b is set if over half of the shingles' hashes have it; no words: zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six white bytes alone
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def syndromes(words: np.ndarray) -> np.ndarray:
    """The 11-bit remainder of each 23-bit word by the generator polynomial."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out ^= ((out >> bit) & 1) * (GOLAY << (bit - 11))
    return out


def error_patterns() -> np.ndarray:
    """By syndrome: the error patterns of up to 4 bits, the least first (the primary's); -1 where there are fewer than six."""
    table, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for s, p in zip(syndromes(patterns).tolist(), patterns.tolist()):
            table[s, used[s]] = p
            used[s] += 1
    return table


ERRORS = error_patterns()


def wide_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6): indices (0..4095) of the codewords within 4 bits of each word, the primary first; -1 fills up."""
    errors = ERRORS[syndromes(words)]
    return np.where(errors < 0, -1, (words.astype(np.int64)[:, None] ^ errors) >> 11)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of every key of every fingerprint (uint64)."""
    parts = [((prints >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    wide = [wide_keys(p) for p in parts]
    rows, keys = [], []

    def add(kind: int, value: np.ndarray, fits: np.ndarray) -> None:
        rows.append(np.nonzero(fits)[0])
        keys.append((value[fits] << 3) | kind)

    for kind, (i, j) in enumerate([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]):
        for k in range(6):
            add(kind, (parts[i] << 12) | wide[j][:, k], wide[j][:, k] >= 0)
    for x in range(6):
        for y in range(6):
            for z in range(6):
                if 0 in (x, y, z):
                    add(6, (wide[0][:, x] << 24) | (wide[1][:, y] << 12) | wide[2][:, z], (wide[0][:, x] >= 0) & (wide[1][:, y] >= 0) & (wide[2][:, z] >= 0))
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for a in range(0, len(prints), 4096):
            rows, keys = golay_keys(prints[a : a + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[a : a + 4096][rows].view(np.int64))], ["key", "fp"])


def bucket_links(ids: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[list, list]:
    """Links that join each set of a bucket's fingerprints within reach (steps of ``radius``) of one another.

    A search outwards from each fingerprint, against those not reached yet: n - 1 links at most, not all pairs.  Large
    buckets are cut into smaller ones first.
    """
    us, vs, rest = [], [], np.arange(len(ids))
    if len(ids) > CROWD:
        vary = np.bitwise_or.reduce(prints) ^ np.bitwise_and.reduce(prints)
        bits = np.flatnonzero(np.unpackbits(np.array([vary]).view(np.uint8), bitorder="little"))
        if len(bits) > radius + 1:  # those within the radius agree on one of radius + 1 parts of the bits that vary
            for part in np.array_split(bits, radius + 1):
                value = prints & np.bitwise_or.reduce(np.uint64(1) << part.astype(np.uint64))
                order = np.argsort(value, kind="stable")
                for same in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                    if len(same) > 1:
                        u, v = bucket_links(ids[same], prints[same], radius)
                        us, vs = us + u, vs + v
            return us, vs
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= radius
            if near.any():
                new = rest[near]
                us.extend([ids[at]] * len(new))
                vs.extend(ids[new].tolist())
                queue.extend(new.tolist())
                rest = rest[~near]
    return us, vs


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a bucket may go on in the next batch."""
    hold = None

    def links(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(keys)) + 1
        firsts, lasts = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
        pairs = firsts[lasts - firsts == 2]
        near = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= RADIUS]
        us, vs = ids[near].tolist(), ids[near + 1].tolist()
        for a, b in zip(firsts, lasts):
            if b - a > 2:
                u, v = bucket_links(ids[a:b], prints[a:b])
                us += u
                vs += v
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        prints = batch.column(1).to_numpy()
        now = [batch.column(0).to_numpy(), prints, prints.view(np.uint64)]  # a fingerprint is the node's own number
        hold = now if hold is None else [np.concatenate(x) for x in zip(hold, now)]
        cut = int(np.searchsorted(hold[0], hold[0][-1]))
        if cut:
            yield links(*(x[:cut] for x in hold))
            hold = [x[cut:] for x in hold]
    if hold is not None:
        yield links(*hold)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long: the fingerprint's 64 bits, mark: Spark's xxhash64 of the text of a row without a doc_id)."""

    def each(i: int | None, t: str | None) -> tuple:
        mark = None if i is not None else 42 if t is None else _signed(xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), 42))
        return i, _signed(fingerprint(t)), mark

    return common.texts(docs).mapInArrow(common.arrow_rows([("doc_id", pa.int64()), ("fp", pa.int64()), ("mark", pa.int64())], each), "doc_id long, fp long, mark long")


def _signed(n: int) -> int:
    return int(np.uint64(n).astype(np.int64))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints link at 4 or fewer differing bits.

    component_id is the smallest doc_id reachable over links, the document itself included; rows without a doc_id link
    like others, and a group of such rows alone has a null component_id.  Null and empty texts and texts without a word
    have fingerprint zero and link like others.  Rows that repeat a doc_id each stay.  Fingerprints are what links join:
    documents of one fingerprint meet as one row (a partial aggregate), so a group of exact copies costs one row a task.
    """
    scratch = common.Scratch(spark, "simhash")
    return _grouped(spark, scratch.save(fingerprints(docs))).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """``prints`` with ``component_id`` and ``node``, the least fingerprint of the group."""
    scratch = common.Scratch(spark, "simhash")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))  # min passes over nulls
    links = distinct.select("fp").mapInArrow(_keyed, "key long, fp long").repartition("key").sortWithinPartitions("key").mapInArrow(_verified, "u long, v long")  # ``components`` drops repeated ones
    linked = scratch.save(distinct.join(components(spark, links).select(F.col("node").alias("fp"), F.col("component").alias("node")), "fp"))
    firsts = scratch.save(linked.groupBy("node").agg(F.min("first").alias("component_id")))
    joined = linked.join(F.broadcast(firsts) if firsts.count() <= FEW else firsts, "node").select("fp", "node", "component_id")
    of_print = distinct.join(joined, "fp", "left").select("fp", F.coalesce("node", "fp").alias("node"), F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(of_print, "fp")


def one_of_each_group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents whose doc_id is their group's smallest, with all their columns; a repeated doc_id keeps its rows.

    Of a group without any doc_id, one row stays: that of the smallest fingerprint and, of its texts, the smallest hash.
    """
    scratch = common.Scratch(spark, "simhash")
    grouped = scratch.save(_grouped(spark, scratch.save(fingerprints(docs))))
    keep = grouped.where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    named = docs.join(keep, docs["doc_id"] == keep["_kept_id"], "left_semi")
    lone = grouped.where("component_id is null").groupBy("node").agg(F.min(F.struct("fp", "mark")).alias("m")).select(F.col("m.mark").alias("_kept_mark"))
    rows = docs.where("doc_id is null").join(lone, F.xxhash64("text") == F.col("_kept_mark"), "left_semi")
    one = rows.groupBy("text").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("x")).select("x.*")
    return named.unionByName(one)
