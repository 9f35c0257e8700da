"""Line near-duplicates within an edit distance, by a segment-partition join (Li et al., Pass-Join) in DataFrame functions.

Lines of 16 letters or more match within two edits, of 8 to 15 letters within one, shorter ones only if equal: one edit
for eight letters of the shorter line, two at most.  A line with t edits is cut into t + 1 even segments.  A line within
t edits of it holds one of them unchanged, at a position that the two lengths and the edits before and after bound.  So
each distinct line puts its own segments into an index keyed by (length, segment number, text), and probes the index of
every length down to t shorter with the substrings at those positions.

What meets is verified by a banded bit-parallel automaton: bit k of word e tells whether the prefixes that end on
diagonal k of the band are within e edits; a letter moves all diagonals at once by shifts, ands and ors.  Common
beginnings and ends are cut off before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

TAU, LETTERS_AN_EDIT = 2, 8
#: Broadcast up to so many ids of lines to verify; beyond, Spark joins by shuffle.
FEW = 500_000
#: Sixteen letters, whose counts (modulo 4) make a line's signature.
LETTERS = "etanoirshdlcumgw"
BLANK = " \t\r\x0b\x0c"


def lines_of(docs: DataFrame, *more: F.Column) -> DataFrame:
    """(doc_id, line_no, line), and ``more`` of the row: the non-blank lines, trimmed of ASCII white space."""
    rows = docs.select("doc_id", "text", *more)  # below the generator, so that ``more`` is made once a row, not once a line
    each = rows.select(*(c for c in rows.columns if c != "text"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.where(not_blank("line")).withColumn("line", trimmed("line"))


def not_blank(line: F.Column | str) -> F.Column:
    return F.ltrim(line, F.lit(BLANK)) != ""  # ends at the first letter


def trimmed(line: str) -> F.Column:
    """Without ASCII white space around.  To trim walks over the whole line, so it is left to lines that begin or end with some."""
    blank = [f(F.col(line), F.lit(c)) for c in BLANK for f in (F.startswith, F.endswith)]
    return F.when(reduce(lambda a, b: a | b, blank), F.btrim(line, F.lit(BLANK))).otherwise(F.col(line))


def edits(length: F.Column, tau: int) -> F.Column:
    """How many edits a line of this length allows."""
    return F.least(F.lit(tau), F.floor(length / LETTERS_AN_EDIT).cast("int"))


def specs(tau: int, probes: bool) -> F.Column:
    """One row (t, shorter, i, move) for each key a line makes: of its own segments, or of places where a segment i of a
    line of t edits, ``shorter`` by so much, may stand ``move`` letters further on.  The bounds are match-aware from both ends."""
    rows = []
    for t in range(1, tau + 1):
        for shorter in range(t + 1 if probes else 1):
            for i in range(t + 1):
                low, high = (max(-i, shorter - (t - i)), min(i, shorter + (t - i))) if probes else (0, 0)
                rows += [F.struct(F.lit(t).alias("t"), F.lit(shorter).alias("shorter"), F.lit(i).alias("i"), F.lit(m).alias("move")) for m in range(low, high + 1)]
    return F.array(*rows)


def keys_of(heads: DataFrame, tau: int, probes: bool, name: str) -> DataFrame:
    """(key, h_<name>, sig_<name>): the keys of distinct lines.  A row a key, each by the same small expression."""
    each = heads.select("line", "size", "h", "sig", F.inline(specs(tau, probes)))
    length, t, i = F.col("size") - F.col("shorter"), F.col("t"), F.col("i")
    each = each.where(edits(length, tau) == t)
    base, longer = F.floor(length / (t + 1)).cast("int"), t + 1 - length % (t + 1)  # segments from number ``longer`` on are one longer
    start = base * i + F.greatest(F.lit(0), i - longer) + F.col("move")
    wide = base + (i >= longer).cast("int")
    fits = (start >= 0) & (start + wide <= F.col("size"))
    return each.where(fits).select(F.xxhash64(length, i, F.substring(F.col("line"), start + 1, wide)).alias("key"), F.col("h").alias(f"h_{name}"), F.col("sig").alias(f"sig_{name}"))


def signature(line: str) -> F.Column:
    """Two bits for each letter's count, 32 in all."""
    whole = F.octet_length(line)
    counts = [whole - F.octet_length(F.replace(line, F.lit(c))) for c in LETTERS]
    return sum((F.shiftleft((c % 4).cast("long"), 2 * k) for k, c in enumerate(counts)), F.lit(0).cast("long"))


def signature_gap(a: str, b: str) -> F.Column:
    """Sum of the differences of the letters' counts, modulo 4: two for an edit at most.

    Per letter the difference d of two bits counts min(d, 4 - d): its low bit, or two if only the high bit is set.
    """
    low = int("01" * 16, 2)
    # a - b in each two-bit field: the fields are spread over odd and even ones, so that borrows stay inside
    even = int("0011" * 8, 2)
    fields = lambda c, k: F.shiftrightunsigned(F.col(c), 2 * k).bitwiseAND(F.lit(even))
    out = F.lit(0)
    for k in (0, 1):
        d = (fields(a, k) + F.lit(int("0100" * 8, 2)) - fields(b, k)).bitwiseAND(F.lit(even))
        ones = d.bitwiseAND(F.lit(low))
        twos = F.shiftrightunsigned(d, 1).bitwiseAND(F.lit(low)).bitwiseAND(F.bitwise_not(ones))
        out = out + F.bit_count(ones) + 2 * F.bit_count(twos)
    return out


def row_hash() -> F.Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("text").alias("row")


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def shared_head(a: F.Column, b: F.Column) -> F.Column:
    """Letters that two texts begin with alike: bisection by powers of two."""
    most = F.least(F.length(a), F.length(b))

    def add(n: F.Column, p: F.Column) -> F.Column:
        return F.when((n + p <= most) & (F.substring(a, n + 1, p) == F.substring(b, n + 1, p)), n + p).otherwise(n)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0), add)


def letters(c: str) -> F.Column:
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def bit_parallel_distance(a: str, b: str, tau: int) -> F.Column:
    """Edit distance of text columns a (letters in ``_a``) and b, -1 if over ``tau``: a band of 2 tau + 1 diagonals, one word of bits an edit count."""
    width = 2 * tau + 1
    band = F.lit((1 << width) - 1)
    # for each letter of b, the diagonals of the band on which a has the same one
    equal = F.transform(letters(b), lambda c, j: sum((F.when(F.get(F.col("_a"), j + k - tau) == c, 1 << k).otherwise(0) for k in range(1, width)), F.when(F.get(F.col("_a"), j - tau) == c, 1).otherwise(0)))

    def step(was: F.Column, m: F.Column) -> F.Column:
        now = [was["e0"].bitwiseAND(m)]
        for e in range(1, tau + 1):
            stay, less = was[f"e{e}"].bitwiseAND(m), was[f"e{e - 1}"]
            now.append(stay.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(now[-1], 1)).bitwiseAND(band))  # match, replace, insert, delete
        return F.struct(*(x.alias(f"e{e}") for e, x in enumerate(now)))

    start = F.struct(*(F.lit(((2 << e) - 1) << tau & ((1 << width) - 1)).alias(f"e{e}") for e in range(tau + 1)))
    end = F.length(a) - F.length(b) + tau
    reached = lambda s: F.coalesce(*(F.when(F.call_function("shiftright", s[f"e{e}"], end).bitwiseAND(F.lit(1)) == 1, e) for e in range(tau + 1)), F.lit(-1))
    walked = F.aggregate(equal, start, step, reached)
    return F.when((end >= 0) & (end < width), walked).otherwise(-1)


def near_texts(spark: SparkSession, docs: DataFrame, tau: int) -> DataFrame:
    """(u, v, a, b, distance): hashes and first places (doc_id, line_no, row) of every two texts within reach."""
    scratch = Scratch(spark, "lines")
    lines = lines_of(docs, row_hash())
    # a generator of one row, so that signatures are made once, before the shuffle, and not again for each use
    heads = lines.select("line", F.explode(F.array(signature("line"))).alias("sig")).distinct().withColumns({"size": F.length("line"), "h": F.xxhash64("line")})
    index, probe = keys_of(heads, tau, False, "i"), keys_of(heads, tau, True, "p")
    met = probe.join(index, (probe["key"] == index["key"]) & (F.col("h_i") != F.col("h_p")) & (signature_gap("sig_i", "sig_p") <= 2 * tau))
    pairs = scratch.save(met.select(F.least("h_i", "h_p").alias("u"), F.greatest("h_i", "h_p").alias("v")).distinct())
    ids = scratch.save(pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct())
    held = lines.withColumn("h", F.xxhash64("line")).join(few(ids), "h")
    texts = scratch.save(held.groupBy("h", "line").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("x")))
    left, right = (texts.select(F.col("h").alias(h), F.col("x").alias(c), F.col("line").alias(f"text_{c}")) for h, c in ("ua", "vb"))
    both = pairs.join(left, "u").join(right, "v")
    return scratch.save(verified(both, tau).select("u", "v", "a", "b", "distance"))


def verified(pairs: DataFrame, tau: int) -> DataFrame:
    """The pairs (text_a, text_b) within reach, with their distance."""
    # generators of one row keep each step apart: as plain columns, a filter on the distance would be made of copies of all of them
    once = lambda df, name, x: df.select("*", F.explode(F.array(x)).alias(name))
    cut = pairs.withColumns({"_x": F.col("text_a"), "_y": F.col("text_b")})
    for turn in range(2):  # common beginnings go, then, of the reversed rest, common ends
        cut = once(cut, "_n", shared_head(F.col("_x"), F.col("_y")))
        rest = [F.reverse(F.substring(F.col(c), F.col("_n") + 1, F.length(c))).alias(c) for c in ("_x", "_y")]
        cut = cut.select(*pairs.columns, F.inline(F.array(F.struct(*rest))))
    cut = once(once(cut, "_a", letters("_x")), "distance", bit_parallel_distance("_x", "_y", tau))
    allowed = edits(F.least(F.length("text_a"), F.length("text_b")), tau)
    return cut.where((F.col("distance") >= 0) & (F.col("distance") <= allowed)).drop("_x", "_y", "_a")


def links(spark: SparkSession, docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc_a, line_a, doc_b, line_b, distance): pairs of different line texts within reach, by their first places.

    Place a comes before place b.  Null texts have no lines.  All pairs are found, none dropped; exact copies meet as
    one row and make no pairs.  Texts are told apart by 64-bit hashes.
    """
    near = near_texts(spark, docs, tau).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    return near.select(F.col("a.doc_id").alias("doc_a"), F.col("a.line_no").alias("line_a"), F.col("b.doc_id").alias("doc_b"), F.col("b.line_no").alias("line_b"), "distance")


def linked_texts(spark: SparkSession, near: DataFrame) -> DataFrame:
    """(h, k, late, class_id, stays) of each text with a link: number of links, whether one leads to an earlier text, the
    smallest hash that links reach, and whether its first place is its class's first."""
    scratch = Scratch(spark, "classes")
    end = lambda h, x, o: F.struct(F.col(h).alias("h"), F.col(x).alias("x"), (F.col(o) < F.col(x)).cast("int").alias("late"))
    ends = near.select(F.explode(F.array(end("u", "a", "b"), end("v", "b", "a"))).alias("e")).select("e.*")
    each = ends.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max("late").alias("late"), F.min("x").alias("x"))
    classed = scratch.save(each.join(components(spark, near.select("u", "v")).select(F.col("node").alias("h"), F.col("component").alias("class_id")), "h"))
    firsts = classed.groupBy("class_id").agg(F.min("x").alias("first"))
    return scratch.save(classed.join(firsts, "class_id").select("h", "k", "late", "class_id", (F.col("x") == F.col("first")).alias("stays")))


def report(spark: SparkSession, docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row per doc_id (null is one as well); rows that repeat a doc_id count together.

    * n_lines (not blank), n_first (whose text stands nowhere before), n_near (first ones linked to a text whose first
      place is earlier) and n_links (links of the first ones): these add up to the corpus's figures.
    * n_linked and n_line_links: lines, first or not, whose text has a link, and the links of all of them.
    * class_ids: the classes (texts joined by links, over any number of steps) of these lines, in order.  Documents that
      share an id hold lines of one class.
    * text: the document without the lines whose text, or one of its class, has an earlier place; blank lines stay.
      Different rows of one doc_id are joined by a newline, equal ones are one.  Null where all its texts are null.
    """
    docs = docs.select("doc_id", "text")
    near = few(linked_texts(spark, near_texts(spark, docs, tau)))
    marks = Scratch(spark, "marks").save(lines_of(docs, row_hash()).select("doc_id", "line_no", "row", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("h2")))
    n_lines = F.size(F.filter(F.split("text", "\n"), not_blank))
    whole = docs.select("doc_id", row_hash(), "text", F.coalesce(F.when(F.col("text").isNotNull(), n_lines), F.lit(0)).cast("long").alias("n_lines"))
    first = marks.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("f")).join(near, "h", "left")
    first = first.select("f.doc_id", "f.row", F.when(F.coalesce("stays", F.lit(True)), F.col("f.line_no")).alias("line_no"), F.lit(1).cast("long").alias("n_first"), F.col("late").cast("long").alias("n_near"), F.col("k").alias("n_links"))
    linked = marks.join(near, "h").groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n_linked"), F.sum("k").alias("n_line_links"), F.collect_set("class_id").alias("classes"))
    parts = whole.unionByName(first, True).unionByName(linked, True).repartition("doc_id")  # dealt once for both groupings
    counts = ["n_lines", "n_first", "n_near", "n_links", "n_linked", "n_line_links"]
    rows = parts.groupBy("doc_id", "row").agg(F.first("text", True).alias("text"), F.sort_array(F.collect_list("line_no")).alias("stay"), F.flatten(F.collect_list("classes")).alias("classes"), *(F.sum(c).alias(c) for c in counts))
    before = F.slice(F.concat(F.array(F.lit(-1)), F.col("stay")), 1, F.size("stay"))
    gaps = F.transform(F.arrays_zip(F.col("stay").alias("at"), before.alias("last")), lambda z: F.concat(F.array_repeat(F.lit(False), z["at"] - z["last"] - 1), F.array(F.lit(True))))
    cut = F.when(F.col("text").isNotNull(), F.struct("row", "text", F.flatten(gaps).alias("stays")))  # line_no is a place in stays
    grouped = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(cut)).alias("cut"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("class_ids"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))
    left = lambda r: F.array_join(F.filter(F.split(r["text"], "\n"), lambda x, k: F.coalesce(F.get(r["stays"], k), F.lit(False)) | ~not_blank(x)), "\n")
    return grouped.select("doc_id", *counts, "class_ids", F.when(F.size("cut") > 0, F.array_join(F.transform("cut", left), "\n")).alias("text"))
