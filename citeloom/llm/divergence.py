"""How the sources of a language differ in their words: a chi-square-like audit over a transducer's vocabulary.

The terms that enough documents of a language have are sorted and cut into ranges, each of which becomes a minimal acyclic
transducer; a range's offset and the transducer's output are a term's lexicographic ordinal.  Texts then stream through
the transducers once more, and from there on only ordinals and counts travel; ordinals break ties, and the transducers
turn those of the result back into terms.  The transducers are sent to every task while they take a bounded number of
bytes; beyond it, each task's counted terms go to the range that they belong to.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .transducer import Builder, Transducer

#: Terms of a transducer, bytes of all that are sent to every task, terms that a task counts before it lets go of them.
RANGE, SHARED_BYTES, HELD = 50_000, 64 << 20, 300_000
#: Ordinals of a block of counts; pairs of counts that are worked on at once.
BLOCK, PAIRS = 2048, 250_000
BILLION = 1_000_000_000
#: A-Z to a-z; every other ASCII byte but a-z parts terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of other characters beyond ASCII, in UTF-8; only A-Z lower-cased."""
    return text.translate(FOLD).split()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _counted(batches: Iterator[pa.RecordBatch], keys: int, once: bool) -> Iterator[dict[tuple, Counter]]:
    """Counts of terms by the first ``keys`` columns, let go whenever they are many; ``once`` a document or each."""
    held: dict[tuple, Counter] = {}
    for batch in batches:
        for part in common.slices(batch, keys, 1024, 8 << 20):
            *names, texts = (c.to_pylist() for c in part.columns)
            for *key, text in zip(*names, texts):
                found = terms(text)
                held.setdefault(tuple(key), Counter()).update(set(found) if once else found)
            if sum(map(len, held.values())) > HELD:
                yield held
                held = {}
    yield held


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term binary): the terms in at least ``least`` documents of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _counted(batches, 1, True):
            for (lang,), counts in held.items():
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n"])

    each = _rows(docs).select("lang", "text").mapInArrow(run, "lang string, term binary, n long")
    return each.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def transducers(kept: DataFrame, size: int = RANGE) -> DataFrame:
    """(lang, first, n, data): a transducer of each ``size`` terms at most, in order within its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, builder = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([first], pa.binary()), pa.array([builder.words]), pa.array([builder.done()], pa.binary())], ["lang", "first", "n", "data"])

        for batch in batches:
            for lang, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if builder is None or lang != at or builder.words == size:
                    if builder is not None:
                        yield row()
                    at, first, builder = lang, term, Builder()
                builder.add(term)
        if builder is not None:
            yield row()

    return kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, "lang string, first binary, n long, data binary")


def pack(ordinals: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(block, total, cells) of counts by ascending ordinal; cells are the places in the block, then the counts."""
    blocks = ordinals // BLOCK
    edges = np.flatnonzero(np.diff(blocks)) + 1
    for a, b in zip([0, *edges], [*edges, len(blocks)]):
        if b > a:
            yield int(blocks[a]), int(counts[a:b].sum()), (ordinals[a:b] % BLOCK).astype("<u2").tobytes() + counts[a:b].astype("<i8").tobytes()


def unpack(cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(cells) // 10
    return np.frombuffer(cells, "<u2", n).astype(np.int64), np.frombuffer(cells, "<i8", n, 2 * n)


CELLS = "lang string, source string, block long, total long, cells binary"


def _cell_rows(found: list[tuple[str, str, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    rows = []
    for lang, source, ordinals, counts in found:
        order = np.argsort(ordinals)
        rows += [(lang, source, *x) for x in pack(ordinals[order], counts[order])]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], ["lang", "source", "block", "total", "cells"])


def _recount_everywhere(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Texts stream through all transducers, which every task has."""
    by_lang: dict[str, list] = {}
    for r in ranges.orderBy("lang", "first").collect():  # SHARED_BYTES at most
        by_lang.setdefault(r["lang"], []).append((bytes(r["first"]), r["before"], bytes(r["data"])))
    shared = docs.sparkSession.sparkContext.broadcast(by_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = {lang: [(first, before, Transducer(data)) for first, before, data in x] for lang, x in shared.value.items()}
        for held in _counted(batches, 2, False):
            found = []
            for lang in {lang for lang, _ in held} & set(machines):
                words = sorted(set().union(*(c for (x, _), c in held.items() if x == lang)))
                starts = np.searchsorted(np.array(words, object), np.array([first for first, _, _ in machines[lang]], object)).tolist() if words else []
                ordinal = dict.fromkeys(words, -1)
                for (_, before, machine), a, b in zip(machines[lang], starts, [*starts[1:], len(words)]):
                    part = words[a:b]
                    places = machine.ordinals(part)
                    ordinal.update(zip(part, np.where(places < 0, -1, places + before).tolist()))
                for (x, source), counts in held.items():
                    if x == lang:
                        places, n = np.fromiter(map(ordinal.__getitem__, counts), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
                        found.append((lang, source, places[places >= 0], n[places >= 0]))
            yield _cell_rows(found)

    return _rows(docs).mapInArrow(run, CELLS)


def _recount_by_range(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each task's counted terms go to their range, whose transducer comes first there."""
    firsts: dict[str, list[bytes]] = {}
    for r in ranges.select("lang", "first").orderBy("lang", "first").collect():  # a term a range
        firsts.setdefault(r["lang"], []).append(bytes(r["first"]))
    shared = docs.sparkSession.sparkContext.broadcast(firsts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _counted(batches, 2, False):
            for (lang, source), counts in held.items():
                if lang in shared.value:
                    cuts, n = shared.value[lang], len(counts)
                    place = pa.array([bisect_right(cuts, t) - 1 for t in counts], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * n, pa.string()), place, pa.array([source] * n, pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "range", "source", "term", "n"]
                    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, before = None, 0
        for batch in batches:
            rows = batch.to_pylist()
            start = 0
            for i in range(len(rows) + 1):
                if i == len(rows) or rows[i]["data"] is not None:  # the rows up to here are the last transducer's
                    by_source: dict[tuple, list] = {}
                    for r in rows[start:i]:
                        by_source.setdefault((r["lang"], r["source"]), []).append(r)
                    found = []
                    for (lang, source), part in by_source.items():
                        places = machine.ordinals([r["term"] for r in part])
                        n = np.array([r["n"] for r in part], np.int64)
                        found.append((lang, source, places[places >= 0] + before, n[places >= 0]))
                    yield _cell_rows(found)
                    if i < len(rows):
                        machine, before, start = Transducer(rows[i]["data"]), rows[i]["n"], i + 1

    counts = _rows(docs).mapInArrow(count, "lang string, range long, source string, term binary, n long").where("range >= 0").groupBy("lang", "range", "source", "term").agg(F.sum("n").alias("n"))
    machines = ranges.select("lang", "range", F.lit(None).cast("string").alias("source"), F.lit(None).cast("binary").alias("term"), F.col("before").alias("n"), "data")
    both = machines.unionByName(counts.withColumn("data", F.lit(None).cast("binary")))
    return both.repartition("lang", "range").sortWithinPartitions("lang", "range", F.col("data").isNull()).mapInArrow(stream, CELLS)


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by language, block and source; one row of each goes out."""
    at, sums = None, None

    def row() -> pa.RecordBatch:
        places = np.flatnonzero(sums)
        return _cell_rows([(at[0], at[2], places + at[1] * BLOCK, sums[places])])

    for batch in batches:
        for lang, source, block, _, cells in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, block, source) != at:
                if at is not None:
                    yield row()
                at, sums = (lang, block, source), np.zeros(BLOCK, np.int64)
            places, counts = unpack(cells)
            sums[places] += counts  # places of a row differ
    if at is not None:
        yield row()


def per_billion(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 count / of), exact while 1000 times ``of`` fits 64 bits: a long division by thousands."""
    out, rest = np.divmod(count, of)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, of)
        out = out * 1000 + digit
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Scores:
    """What a task gathers from blocks of counts: the best terms and counts of counts of each source, and of each pair of
    sources what the terms that both have add to the sums that take one of the two counts as zero."""

    def __init__(self, best: int):
        self.best, self.top, self.counts = best, {}, {}

    def block(self, lang: str, v: int, whole: int, rows: list[tuple[str, int, int, bytes]]) -> Iterator[tuple]:
        """rows: (source, its n, block, cells).  Gives ('pair', lang, source, other, value)."""
        names, base = [r[0] for r in rows], rows[0][2] * BLOCK
        ns = np.array([r[1] for r in rows], np.int64)
        cells = [unpack(r[3]) for r in rows]
        zero = per_billion(np.ones(len(rows), np.int64), ns + v)
        total = np.zeros(BLOCK, np.int64)
        for places, counts in cells:
            total[places] += counts
        q = per_billion(total + 1, np.int64(whole + v))
        ps = []
        for name, n, (places, counts) in zip(names, ns, cells):
            p = per_billion(counts + 1, n + v)
            ps.append(p)
            more = p > q[places]
            held = self.top.get((lang, name), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            value, ordinal = np.concatenate([held[0], gap(p[more], q[places[more]])]), np.concatenate([held[1], places[more] + base])
            order = np.lexsort((ordinal, -value))[: self.best]
            self.top[lang, name] = value[order], ordinal[order]
            self.counts.setdefault((lang, name), Counter()).update(dict(zip(*(x.tolist() for x in np.unique(counts, return_counts=True)))))
        source = np.repeat(np.arange(len(rows)), [len(c[0]) for c in cells])
        place, p = np.concatenate([c[0] for c in cells]), np.concatenate(ps)
        order = np.argsort(place, kind="stable")
        place, source, p = place[order], source[order], p[order]
        first, after = np.searchsorted(place, place), np.searchsorted(place, place, "right")
        width = after - first  # each count meets those of its term
        ends, start = np.cumsum(width), 0
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while start < len(place):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            a = np.repeat(np.arange(start, stop), width[start:stop])
            b = first[a] + np.arange(len(a)) - np.repeat(ends[start:stop] - width[start:stop] - (ends[start - 1] if start else 0), width[start:stop])
            a, b = a[source[a] != source[b]], b[source[a] != source[b]]
            za, zb = zero[source[a]], zero[source[b]]
            value = gap(p[a], p[b]) - gap(p[a], zb) - gap(za, p[b]) + gap(za, zb)
            keys, at = np.unique(np.concatenate([keys, source[a] * len(rows) + source[b]]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, np.concatenate([values, value]))
            values, start = sums, stop
        for key, value in zip(keys.tolist(), values.tolist()):
            yield "pair", lang, names[key // len(rows)], names[key % len(rows)], 0, value

    def rest(self) -> Iterator[tuple]:
        for (lang, name), (value, ordinal) in self.top.items():
            yield from (("term", lang, name, None, o, f) for o, f in zip(ordinal.tolist(), value.tolist()))
        for (lang, name), counts in self.counts.items():
            yield from (("count", lang, name, None, c, n) for c, n in counts.items())


def _scored(best: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    fields = [("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("place", pa.int64()), ("value", pa.int64())]

    def out(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list(rows)
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows[i : i + 100_000]), fields)], [name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, at, rows = Scores(best), None, []
        for batch in batches:
            for lang, block, source, n, v, whole, cells in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, block) != at:
                    if rows:
                        yield from out(scores.block(*kept, rows))
                    at, rows, kept = (lang, block), [], (lang, v, whole)
                rows.append((source, n, block, cells))
        if rows:
            yield from out(scores.block(*kept, rows))
        yield from out(scores.rest())

    return run


def audit(spark: SparkSession, docs: DataFrame, least: int = 3, best: int = 200, shared_bytes: int = SHARED_BYTES, range_terms: int = RANGE) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs; null text, lang and source read as ''.

    A language keeps the V terms in at least ``least`` of its rows.  p = 1 + floor(10^9 (count + 1) / (N + V)) of each kept
    term, N being the group's count of kept terms; f = floor((p - q)^2 / q).  Part ``pair``: every other source of the
    language, q its p, f summed over the kept terms (0 if there are none), all ranks.  Part ``term``: the terms that the
    group has with p over q, the language's p, up to rank ``best``.  Ranks go by value, then item.  Repeated rows count
    each; other columns are not read; an empty table gives no row.

    The sum over all terms is taken from the terms that a source has: f between two sources where only one has the term
    depends on its count alone, so it is summed over counts of counts; terms that both have are corrected one by one.
    """
    scratch = common.Scratch(spark, "divergence")
    kept = scratch.save(vocabulary(docs, least))
    found = scratch.save(transducers(kept, range_terms))
    order = Window.partitionBy("lang").orderBy("first")  # a row a range
    ranges = scratch.save(found.withColumns({"range": F.row_number().over(order) - 1, "before": F.sum("n").over(order) - F.col("n")}))
    scratch.drop(kept)
    scratch.drop(found)
    size = ranges.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    cells = (_recount_everywhere if size <= shared_bytes else _recount_by_range)(docs, ranges)
    counts = scratch.save(cells.repartition("lang", "block").sortWithinPartitions("lang", "block", "source").mapInArrow(_sum_cells, CELLS))

    vs = ranges.groupBy("lang").agg(F.sum("n").alias("v"))
    groups = _rows(docs).groupBy("lang", "source").agg(F.lit(1).alias("_one")).drop("_one").join(counts.groupBy("lang", "source").agg(F.sum("total").alias("n")), ["lang", "source"], "left")
    groups = scratch.save(groups.join(vs, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    wholes = groups.groupBy("lang").agg(F.sum("n").alias("whole"))
    rows = counts.join(groups, ["lang", "source"]).join(wholes, "lang").select("lang", "block", "source", "n", "v", "whole", "cells")
    fields = "kind string, lang string, source string, other string, place long, value long"
    scored = scratch.save(rows.repartition("lang", "block").sortWithinPartitions("lang", "block", "source").mapInArrow(_scored(best), fields))
    return _pairs(groups, scored).unionByName(_terms(scored, ranges, best))


def _pairs(groups: DataFrame, scored: DataFrame) -> DataFrame:
    """The sums over all terms, from counts of counts and the corrections."""
    big = "decimal(38,0)"
    div = lambda a, b: F.call_function("div", a, b)
    p = lambda count, n, v: div((count + 1).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)"), F.nullif(n + v, F.lit(0)).cast("decimal(20,0)")) + 1
    f = lambda p, q: div((p - q) * (p - q), q)
    zeros = groups.withColumn("zero", p(F.lit(0), F.col("n"), F.col("v")))
    counts = scored.where("kind = 'count'").groupBy("lang", "source", "place").agg(F.sum("value").alias("terms"))
    counts = counts.join(groups, ["lang", "source"]).select("lang", "source", p(F.col("place"), F.col("n"), F.col("v")).alias("p"), "terms")
    had = counts.groupBy("lang", "source").agg(F.sum("terms").alias("had"))
    alone = counts.join(zeros.select("lang", F.col("source").alias("other"), "zero"), "lang").where("source <> other").groupBy("lang", "source", "other").agg(
        F.sum(f(F.col("p"), F.col("zero")).cast(big) * F.col("terms")).cast(big).alias("mine"), F.sum(f(F.col("zero"), F.col("p")).cast(big) * F.col("terms")).cast(big).alias("theirs")
    )
    both = scored.where("kind = 'pair'").groupBy("lang", "source", "other").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast(big).alias("both"))
    side = zeros.join(had, ["lang", "source"], "left").withColumn("had", F.coalesce("had", F.lit(0)))
    all_pairs = side.alias("a").join(side.select("lang", F.col("source").alias("other"), F.col("zero").alias("q"), F.col("had").alias("other_had")), "lang").where("source <> other")
    key = ["lang", "source", "other"]
    met = all_pairs.join(alone.select(*key, "mine"), key, "left").join(alone.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "theirs"), key, "left").join(both, key, "left")
    none = F.lit(0).cast(big)
    value = F.coalesce("mine", none) + F.coalesce("theirs", none) + F.coalesce("both", none) + F.coalesce(f(F.col("zero"), F.col("q")).cast("decimal(20,0)") * (F.col("v") - F.col("had") - F.col("other_had")), none)
    ranked = met.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.cast("long").alias("value"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(scored: DataFrame, ranges: DataFrame, best: int) -> DataFrame:
    """The best terms of each group by value and ordinal, then named by the transducer of their range."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "place")
    top = scored.where("kind = 'term'").select("lang", "source", "place", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    bounds = ranges.select("lang", F.col("range").alias("in_range"), "before", "n")
    placed = top.join(bounds, "lang").where("place >= before and place < before + n").select("lang", "in_range", "source", "value", "rank", (F.col("place") - F.col("before")).alias("place"))
    machines = ranges.select(F.col("lang").alias("of_lang"), F.col("range").alias("of_range"), "data")

    def name(key: tuple, rows: pa.Table, machine: pa.Table) -> pa.Table:
        words = Transducer(machine.column("data")[0].as_py())
        items = [words.word(i).decode() for i in rows.column("place").to_pylist()]
        return rows.select(["lang", "source"]).append_column("part", pa.array(["term"] * len(items), pa.string())).append_column("item", pa.array(items, pa.string())).append_column("value", rows.column("value")).append_column("rank", rows.column("rank"))

    found = placed.groupBy("lang", "in_range").cogroup(machines.groupBy("of_lang", "of_range"))
    return found.applyInArrow(name, "lang string, source string, part string, item string, value long, rank int")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT s.lang, s.source, coalesce(sum(c.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + v.v) AS p
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), l AS (
  SELECT p.lang, p.term, 1 + (1000000000::HUGEINT * (sum(p.c) + 1)) // (any_value(w.n) + any_value(v.v)) AS q
  FROM p JOIN v ON v.lang = p.lang JOIN (SELECT lang, sum(n) AS n FROM g GROUP BY ALL) w ON w.lang = p.lang GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, CAST((p.p - l.q) * (p.p - l.q) // l.q AS BIGINT)
  FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.c > 0 AND p.p > l.q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""
