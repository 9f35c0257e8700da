"""Statistics of publications and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_year_in_text, truthy


def _size(c: str) -> Column:
    return F.coalesce(F.array_size(c), F.lit(0)).cast("long")


def coverage_stats(publications: DataFrame) -> DataFrame:
    """One row: the total, count and percentage of publications with each field, and authors and organizations in all
    and on average.  No citations count as missing; percentages of an empty table are null."""
    n = F.count(F.lit(1))
    has = {
        "abstract": truthy(F.col("abstract")).isNotNull(), "doi": truthy(F.col("doi")).isNotNull(),
        "keywords": _size("keywords") > 0, "citations": F.coalesce("citations_count", F.lit(0)) > 0,
    }
    share = lambda c: F.round(100 * F.count_if(c) / F.nullif(n, F.lit(0)), 6)
    mean = lambda c: F.round(F.sum(_size(c)) / F.nullif(n, F.lit(0)), 6)
    return publications.agg(
        n.alias("total"), *(F.count_if(c).alias(f"with_{k}") for k, c in has.items()), *(share(c).alias(f"pct_{k}") for k, c in has.items()),
        F.sum(_size("authors")).alias("total_authors"), mean("authors").alias("mean_authors"), F.sum(_size("organizations")).alias("total_organizations"), mean("organizations").alias("mean_organizations"),
    )


def _top(names: DataFrame, n: int) -> DataFrame:
    return names.where(truthy(F.col("name")).isNotNull()).groupBy("name").count().orderBy(F.desc("count"), "name").limit(n)


def top_authors(publications: DataFrame, n: int = 10) -> DataFrame:
    return _top(publications.select(F.explode("authors.name").alias("name")), n)


def top_organizations(publications: DataFrame, n: int = 10) -> DataFrame:
    return _top(publications.select(F.explode("organizations.name").alias("name")), n)


def top_keywords(publications: DataFrame, n: int = 20) -> DataFrame:
    return _top(publications.select(F.explode(F.transform("keywords", lambda k: F.lower(k))).alias("name")), n)


def publications_by_year(publications: DataFrame) -> DataFrame:
    return publications.select(first_year_in_text(F.col("publication_date")).alias("year")).where("year is not null").groupBy("year").count().orderBy(F.desc("year"))


def document_types(publications: DataFrame) -> DataFrame:
    each = publications.select(F.coalesce(truthy(F.col("document_type")), F.lit("Unknown")).alias("document_type")).groupBy("document_type").count()
    return each.withColumn("pct", F.round(100 * F.col("count") / F.sum("count").over(Window.partitionBy()), 6)).orderBy(F.desc("count"), "document_type")  # a row a type


#: Ranges that a round of rank selection counts; names of a block of a publication with many.
RANGES, NAMES = 4096, 256


def nth_largest(counts: DataFrame, rank: int, least: int, most: int) -> int | None:
    """The value at a place (0: the largest) of a table of counts (v long, k), whose values are between two bounds.

    Each round counts ranges of values, a bounded number of rows, and goes on in the one that holds the place.
    """
    low, high = least, most
    while low < high:
        width = -(-(high - low + 1) // RANGES)
        v = F.col("v") if high - low < 1 << 62 and -(1 << 62) < low else F.col("v").cast("decimal(20,0)")
        part = F.call_function("div", v - F.lit(low), F.lit(width)).alias("part")
        found = counts.where(F.col("v").between(low, high)).groupBy(part).agg(F.sum("k").alias("k")).orderBy(F.desc("part")).collect()
        for r in found:
            if rank < r["k"]:
                low, high = low + r["part"] * width, min(high, low + (r["part"] + 1) * width - 1)
                break
            rank -= r["k"]
        else:
            return None
    return low


def citation_stats(publications: DataFrame) -> DataFrame:
    """n, sum, mean, max, min and median of the citations that aren't null; the median is element n // 2 counted down.

    The median is found by counts of ranges of values, so no task holds all values; all null where there are none.
    """
    c = publications.where("citations_count is not null").groupBy(F.col("citations_count").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    total = c.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.sum(F.col("v") * F.col("k")).alias("sum"), F.max("v").alias("max"), F.min("v").alias("min"))
    known = total.first()
    median = nth_largest(c, known["n"] // 2, known["min"], known["max"]) if known["n"] else None
    return total.where("n > 0").select("n", "sum", F.round(F.col("sum") / F.col("n"), 6).alias("mean"), "max", "min", F.lit(median).cast("long").alias("median"))


def top_cited(publications: DataFrame, n: int = 10) -> DataFrame:
    return publications.where("citations_count > 0").orderBy(F.desc("citations_count"), F.desc("title"), F.desc("publication_id")).select("publication_id", "title", "citations_count").limit(n)


def collaboration_pairs(publications: DataFrame, n: int = 10, block: int = NAMES) -> DataFrame:
    """The ``n`` pairs of names that share most publications, by count and then names, all descending.

    A publication of more than ``block`` names is cut into blocks; pairs of blocks are dealt to tasks.
    """
    names = publications.select(F.array_sort(F.array_distinct(F.filter("authors.name", lambda x: truthy(x).isNotNull()))).alias("names")).where(F.size("names") > 1)
    light = names.where(F.size("names") <= block).select(F.col("names").alias("left"), F.col("names").alias("right"), F.lit(True).alias("one"))
    parts = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size("names") - 1, F.lit(block)).cast("int")), lambda i: F.slice("names", i * block + 1, block))
    heavy = names.where(F.size("names") > block).select(F.posexplode(parts).alias("i", "left"), parts.alias("parts"))
    heavy = heavy.select("left", F.posexplode(F.slice("parts", F.col("i") + 1, F.size("parts"))).alias("j", "right")).select("left", "right", (F.col("j") == 0).alias("one"))
    heavy = heavy.repartition(F.xxhash64("left", "right"))
    after = lambda a, i: F.when(F.col("one"), F.slice("right", i + 2, F.size("right"))).otherwise(F.col("right"))
    pairs = F.flatten(F.transform("left", lambda a, i: F.transform(after(a, i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = light.unionByName(heavy).select(F.explode(pairs).alias("p"))
    return each.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared"), F.desc("a"), F.desc("b")).limit(n)


def node_counts(**tables: DataFrame) -> DataFrame:
    """(kind, n): rows of each table."""
    counts = [df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def linked_work_counts(authors: DataFrame, authored: DataFrame) -> DataFrame:
    counts = authored.groupBy(F.col("author_id").alias("id")).agg(F.count(F.lit(1)).alias("works"))
    return authors.select("id").join(counts, "id", "left").select("id", F.coalesce("works", F.lit(0)).cast("long").alias("works"))


def extraction_stats(mentions: DataFrame, key: str = "id") -> DataFrame:
    return mentions.agg(F.countDistinct(key).alias("entities"), F.count(key).alias("mentions"))
