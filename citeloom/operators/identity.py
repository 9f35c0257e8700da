"""The name directory and lookups in it."""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import WORD, clean_uid, generated_email, surname, truthy
from .publications import first_per_key

#: Names of a block of a lookup, and entries of a block, which meet in one task.
FEW, ENTRIES = 20_000, 16_000
#: Rare three-letter parts of a name, entries of each, and entries on either side of a name that give first guesses; the letters of a name that they score.
RARE, POSTINGS, BESIDE, LONG = 8, 64, 32, 128
#: Names that go down a tree together, and paths at once.
BATCH, PATHS = 512, 400_000
#: Organizations of a bucket that a directory picks from.
IN_BUCKET = 64


def org_name_list(orgs: DataFrame) -> DataFrame:
    """Distinct names; one default where there are none."""
    names = orgs.select("name").where(truthy(F.col("name")).isNotNull()).distinct()
    default = orgs.sparkSession.createDataFrame([("DefaultOrg",)], "name string").join(names.limit(1).select(F.lit(1).alias("_any")), how="left").where("_any is null").select("name")
    return names.unionByName(default)


def build_directory(authors: DataFrame, orgs: DataFrame | list[str], file_order: Column | None = None) -> DataFrame:
    """(uid, cn, sn, o, mail): entries of authors with a name, the first of each uid.

    Half of those without an address get a generated one; which half, and the organization where none is given, follow
    the name's hash.  Organizations are a table (name) of any size, or a list; they stand in buckets by hash, and a name's
    hash picks a bucket and a place in it.
    """
    spark = authors.sparkSession
    table = orgs if isinstance(orgs, DataFrame) else spark.createDataFrame([(n,) for n in orgs], "name string")
    names = org_name_list(table)
    buckets = F.lit(max(1, names.count() // IN_BUCKET))
    spread = names.groupBy(F.pmod(F.xxhash64("name"), buckets).alias("_b")).agg(F.array_sort(F.collect_set("name")).alias("_orgs"))
    least = names.agg(F.min("name").alias("_least"))  # for a bucket that got none
    order = F.col("name") if file_order is None else file_order
    named = authors.where(truthy(F.trim("name")).isNotNull()).withColumns({"_o": order, "_b": F.pmod(F.xxhash64("name", F.lit(11)), buckets)})
    named = named.join(spread, "_b", "left").join(F.broadcast(least))  # one row
    picked = F.coalesce(F.get("_orgs", F.pmod(F.xxhash64("name"), F.greatest(F.size("_orgs"), F.lit(1))).cast("int")), F.col("_least"))
    mail = F.coalesce(truthy(F.col("email")), F.when(F.pmod(F.xxhash64("name", F.lit(3)), F.lit(2)) == 0, generated_email(F.col("name"), F.col("name"))))
    uid = clean_uid(F.coalesce(truthy(F.col("uid")), F.replace(F.col("name"), F.lit(" "), F.lit(""))))
    entries = named.select(uid.alias("uid"), F.col("name").alias("cn"), surname(F.col("name")).alias("sn"), F.coalesce(truthy(F.col("org_name")), picked).alias("o"), mail.alias("mail"), "_o")
    return first_per_key(entries.where("uid <> ''"), "uid", F.col("_o"), F.col("cn")).drop("_o")


def exact_entries(directory: DataFrame, names: DataFrame) -> DataFrame:
    """(query, cn, mail): the entry of each name, case aside, the first of several: an equi-join of any size."""
    asked = names.select(F.col("name").alias("query")).where("query is not null").distinct()
    found = directory.join(asked, F.lower("cn") == F.lower("query"))
    return first_per_key(found, "query", F.col("cn"), F.col("uid")).select("query", "cn", "mail")


def _parts(df: DataFrame, name: str) -> DataFrame:
    """(name, part): each name's different three-letter parts; a shorter name is its own."""
    n = F.length(name)
    parts = F.when(n < 3, F.array(F.col(name))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(F.col(name), i, F.lit(3))))
    return df.select(name, F.explode(F.array_distinct(parts)).alias("part"))


def _rare_pairs(mailed: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, cn): entries that share one of a name's rarest three-letter parts, some of each part."""
    index = _parts(mailed, "cn")
    sizes = index.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    some = index.withColumn("_r", F.row_number().over(Window.partitionBy("part").orderBy("cn"))).where(F.col("_r") <= POSTINGS).select("part", "cn")
    rare = _parts(asked, "query").join(sizes, "part").withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("n", "part"))).where(F.col("_r") <= RARE)
    return rare.join(some, "part").select("query", "cn")


def _beside_pairs(mailed: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
    """(query, cn): entries beside a name in the order of names, of names read backwards as well, within a range of names."""

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, queries = [], []
        for batch in batches:
            for name, is_query in zip(*(c.to_pylist() for c in batch.columns)):
                (queries if is_query else entries).append(name)
        entries.sort()
        for some in (queries[k : k + BATCH] for k in range(0, len(queries), BATCH)):
            found = [(q, entries[max(0, at - BESIDE) : at + BESIDE]) for q in some for at in [bisect_left(entries, q)]]
            yield pa.RecordBatch.from_pydict({"query": pa.array([q for q, near in found for _ in near], pa.string()), "cn": pa.array([e for _, near in found for e in near], pa.string())})

    def pairs(turn) -> DataFrame:
        rows = mailed.select(turn(F.col("cn")).alias("name"), F.lit(False).alias("is_query")).unionByName(asked.select(turn(F.col("query")).alias("name"), F.lit(True).alias("is_query")))
        return rows.repartitionByRange(parts, "name").mapInArrow(beside, "query string, cn string").select(turn(F.col("query")).alias("query"), turn(F.col("cn")).alias("cn"))

    return pairs(lambda c: c).unionByName(pairs(F.reverse))


def first_guesses(mailed: DataFrame, asked: DataFrame, top: int, parts: int = 1) -> DataFrame:
    """(query, floor): a ratio that the ``top``-th best entry has at least; -1 where too few entries were found.

    Some entries are scored: those of a name's rarest parts and those beside it.  What is passed over only makes the floor
    lower, and so do names that are too ``LONG`` to be scored here.
    """
    pairs = _rare_pairs(mailed, asked).unionByName(_beside_pairs(mailed, asked, parts)).where((F.length("query") <= LONG) & (F.length("cn") <= LONG)).distinct()

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_pylist() for c in batch.columns)
            total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
            yield pa.RecordBatch.from_pydict({"query": batch.column(0), "hundredths": pa.array(_hundredths(_common(a, b), total), pa.int64())})

    scored = pairs.mapInArrow(scores, "query string, hundredths long").withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("hundredths"))))
    best = scored.where(F.col("_r") == top).select("query", (F.col("hundredths") / 100).alias("floor"))
    return asked.join(best, "query", "left").select("query", F.coalesce("floor", F.lit(-1.0)).alias("floor"))


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all names one after another, and their lengths."""
    return np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64), np.array([len(n) for n in names], np.int64)


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each pair, row by row for all pairs at once."""

    def table(names: list[str], pad: int) -> np.ndarray:
        letters, sizes = _letters(names)
        out = np.full((max(1, sizes.max(initial=0)), len(names)), pad, np.int64)
        out[np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(names)), sizes)] = letters
        return out

    left, right = table(a, -1), table(b, -2)
    row = np.zeros((len(left) + 1, len(a)), np.int16)
    for letter in right:
        new = row.copy()
        np.maximum(new[1:], row[:-1] + (left == letter), out=new[1:])
        row = np.maximum.accumulate(new, axis=0)
    return row[-1].astype(np.int64)


def _hundredths(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``fuzz_ratio`` in hundredths, from letters in common and letters in all."""
    return np.where(total == 0, 10_000, (40_000 * common + total) // np.maximum(2 * total, 1))


class _Names:
    """Different names in order, as a tree of their beginnings: ``level(d)`` has the names that are the first with their
    first ``d`` letters."""

    def __init__(self, names: list[str]):
        letters, self.size = _letters(names)
        self.alphabet, self.code = np.unique(letters, return_inverse=True)
        self.at = np.cumsum(self.size) - self.size
        self.shared = np.zeros(len(names), np.int64)  # letters in common with the name before
        self.shared[1:] = [len(os.path.commonprefix([x, y])) for x, y in pairwise(names)]
        self.levels = {}

    def level(self, d: int) -> tuple[np.ndarray, ...]:
        """First name, last letter, least and greatest length of each beginning of ``d`` letters."""
        if d not in self.levels:
            first = np.flatnonzero((self.shared < d) & (self.size >= d))
            edges = np.flatnonzero(self.shared < d)  # shorter names end a beginning's range as well
            least, most = (f.reduceat(self.size, edges)[np.searchsorted(edges, first)] if len(first) else first for f in (np.minimum, np.maximum))
            self.levels[d] = first, self.code[self.at[first] + d - 1], least, most, np.append(edges, len(self.size))[np.searchsorted(edges, first) + 1]
        return self.levels[d]


def nearest(names: list[str], queries: list[str], floors: list[float], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, name, letters in common), as places: the ``top`` best names of each query among those that reach its floor,
    ties by name.  ``names`` differ and are in order.

    All queries go down the tree of the names' beginnings together, with a bit row of the longest common subsequence
    each.  To reach the floor, a name of m letters needs some in common with a query of n, so it may pass over so many of
    its own and of the query's; a beginning that passed over more is left.
    """
    tree, none = _Names(names), np.zeros(0, np.int64)
    found, held = [(none, none, none, none)], 0
    sizes = np.array([len(q) for q in queries], np.int64)
    least = np.array(floors, np.float64) - 0.0051  # a rounding step below
    need = lambda q, m: np.maximum(np.ceil(least[q] * (sizes[q] + m) / 200.0 - 1e-9), 0).astype(np.int64)

    def best_of() -> tuple[np.ndarray, ...]:
        q, e, common, hundredths = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((e, -hundredths, q))
        q = q[order]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else none
        kept = order[np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) < top] if len(q) else order
        return tuple(c[kept] for c in map(np.concatenate, zip(*found)))

    def take(q: np.ndarray, e: np.ndarray, common: np.ndarray) -> None:
        nonlocal found, held
        reach = common >= need(q, tree.size[e])
        q, e, common = q[reach], e[reach], common[reach]
        found.append((q, e, common, _hundredths(common, sizes[q] + tree.size[e])))
        held += len(q)
        if held > 4 * PATHS:
            found = [best_of()]
            held = len(found[0][0])

    by_size = np.argsort(sizes, kind="stable")
    for some in (by_size[k : k + BATCH] for k in range(0, len(by_size), BATCH)):
        words = max(1, -(-int(sizes[some].max()) // WORD))
        masks = np.zeros((words, len(some), len(tree.alphabet)), np.int64)  # the places of each letter in each query
        full = np.zeros((words, len(some)), np.int64)
        letters, lengths = _letters([queries[k] for k in some])
        place, mine = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(np.arange(len(some)), lengths)
        code = np.minimum(np.searchsorted(tree.alphabet, letters), max(0, len(tree.alphabet) - 1))
        known = tree.alphabet[code] == letters if len(tree.alphabet) else np.zeros(len(letters), bool)
        np.bitwise_or.at(masks, (place[known] // WORD, mine[known], code[known]), np.int64(1) << (place[known] % WORD))
        np.bitwise_or.at(full, (place // WORD, mine), np.int64(1) << (place % WORD))

        everyone = np.arange(len(some))
        if len(names) and not tree.size[0]:  # the empty name
            take(some, np.zeros(len(some), np.int64), np.zeros(len(some), np.int64))
        # (letters read, query, first name and the one behind the last, bit rows)
        paths = [(0, everyone, np.zeros(len(some), np.int64), np.full(len(some), len(names)), full)]
        while paths:
            d, q, lo, hi, rows = paths.pop()
            first, letter, shortest, longest, behind = tree.level(d + 1)
            start = np.searchsorted(first, lo)
            children = np.searchsorted(first, hi) - start
            fit = max(1, int(np.searchsorted(np.cumsum(children), PATHS, "right")))  # so many paths go on at once
            if fit < len(q):
                paths.append((d, q[fit:], lo[fit:], hi[fit:], rows[:, fit:]))
                q, start, children, rows = q[:fit], start[:fit], children[:fit], rows[:, :fit]
            node = np.arange(children.sum()) + np.repeat(start - (np.cumsum(children) - children), children)
            q, rows = np.repeat(q, children), np.repeat(rows, children, axis=1)
            n, asked = sizes[some[q]], some[q]
            own, theirs = longest[node] - need(asked, longest[node]), n - need(asked, shortest[node])
            passed = d + 1 - own + theirs  # so many letters of the query have at most ``theirs`` without a partner
            carry, over = np.int64(0), np.maximum(passed - n, 0)
            for w in range(words):
                u = rows[w] & masks[w, q, letter[node]]
                total = rows[w] + u + carry
                carry = total >> WORD
                rows[w] = (total | (rows[w] - u)) & full[w, q]
                over = over + np.bitwise_count(rows[w] & ((np.int64(1) << np.clip(passed - w * WORD, 0, WORD)) - 1))
            on = (over <= theirs) & (own >= 0)
            q, node, rows = q[on], node[on], rows[:, on]
            ends = tree.size[first[node]] == d + 1
            take(some[q[ends]], first[node[ends]], sizes[some[q[ends]]] - np.bitwise_count(rows[:, ends]).sum(axis=0, dtype=np.int64))
            if len(q):
                paths.append((d + 1, q, first[node], behind[node], rows))
    return best_of()[:3]


def near_entries(mailed: DataFrame, asked: DataFrame, top: int, block: int = FEW, entries: int = ENTRIES) -> DataFrame:
    """(query, floor, cn, mail, common): pairs with all ``top`` best of each query, ties by name, and the letters that they
    have in common.

    Names stand in blocks by hash and entries in blocks by their order; each pair of blocks is a group of its own, which
    gives the best of each name in it (``nearest``).
    """
    n_e, n_q = max(1, -(-mailed.count() // entries)), max(1, -(-asked.count() * 5 // (4 * block)))  # room for uneven blocks
    floors = first_guesses(mailed, asked, top, n_e).withColumns({"_q": F.pmod(F.xxhash64("query"), F.lit(n_q)).cast("int"), "_e": F.explode(F.sequence(F.lit(0), F.lit(n_e - 1)))})
    placed = mailed.select("cn", "mail").repartitionByRange(n_e, "cn").withColumn("_e", F.spark_partition_id()).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.take(pa.array(np.array(sorted(range(len(left)), key=(names := left["cn"].to_pylist()).__getitem__), np.int64)))
        q, e, common = nearest(sorted(names), right["query"].to_pylist(), right["floor"].to_pylist(), top) if len(left) and len(right) else (np.zeros(0, np.int64),) * 3
        mine, theirs = right.take(pa.array(q)), rows.take(pa.array(e))
        return pa.table({"query": mine["query"], "floor": mine["floor"], "cn": theirs["cn"], "mail": theirs["mail"], "common": pa.array(common, pa.int64())})

    cells = min(2000, 2 * n_e * n_q) if n_e * n_q > 1 else 1  # named, as a cell takes long for its few bytes
    left, right = (df.repartition(cells, "_e", "_q").groupBy("_e", "_q") for df in (placed, floors))
    return left.cogroup(right).applyInArrow(best, "query string, floor double, cn string, mail string, common long")


def identity_lookup(directory: DataFrame, names: DataFrame, top: int = 10, block: int = FEW) -> DataFrame:
    """(query, cn, mail, score, exact): the exact entry of each name, case aside, and the ``top`` most similar entries
    with an address; the exact entry's name is left out of those after the cut.

    Names are counted and, where they are more than ``block``, dealt into blocks by hash; only entries that may be among the
    best are scored to the end.
    """
    asked = names.select(F.col("name").alias("query")).where("query is not null").distinct()
    exact = exact_entries(directory, names).select("query", "cn", "mail", F.lit(100.0).alias("score"), F.lit(True).alias("exact"))
    mailed = directory.where("mail is not null and cn is not null").groupBy("cn").agg(F.max_by("mail", "uid").alias("mail"))
    total = F.length("query") + F.length("cn")
    ratio = F.round(F.when(total == 0, 100.0).otherwise(200.0 * F.col("common") / F.greatest(total, F.lit(1))), 2)  # fuzz_ratio
    scored = near_entries(mailed, asked, top, block).withColumn("score", ratio)
    best = scored.where("score >= floor").withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cn"))).where(F.col("_r") <= top)
    similar = best.join(exact.select("query", F.col("cn").alias("_cn")), "query", "left").where("_cn is null or cn <> _cn")
    return exact.unionByName(similar.select("query", "cn", "mail", "score", F.lit(False).alias("exact")))


def lookup_messages(found: DataFrame) -> DataFrame:
    """(query, message): what a lookup found."""
    kinds = found.groupBy("query").agg(F.bool_or("exact").alias("hit"), F.bool_or(~F.col("exact")).alias("near"))
    both = F.when(F.col("hit") & F.col("near"), "exact match and suggestions").when(F.col("hit"), "exact match").otherwise("suggestions")
    return kinds.select("query", both.alias("message"))


def identity_stats(directory: DataFrame) -> DataFrame:
    return directory.agg(F.count(F.lit(1)).alias("total"), F.count("mail").alias("with_email"), (F.count(F.lit(1)) - F.count("mail")).alias("without_email"))
