"""The benchmark tables as corpus tables: suppliers as authors, orders as works, line items as their links, and so on.

``SQL`` holds the same tables as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = """WITH authors AS (SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS org_id, CAST(floor(s_acctbal) AS BIGINT) AS citation_count FROM supplier),
orgs AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey),
topics AS (SELECT p_partkey AS id, p_name AS name, p_type AS field, p_brand AS subfield FROM part),
works AS (SELECT o_orderkey AS id, 'Work ' || o_orderkey || ' on ' || o_orderpriority || ' matters' AS title,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS publication_date,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year, CAST(floor(o_totalprice / 1000) AS BIGINT) AS citation_count, o_orderpriority AS document_type FROM orders),
mentions AS (SELECT l_orderkey AS work_id, l_linenumber AS n, l_suppkey AS author_id, CAST(s_nationkey AS BIGINT) AS org_id, l_partkey AS topic_id, round(1 - l_discount, 2) AS score
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey),
authored AS (SELECT DISTINCT author_id, work_id FROM mentions),
affiliated AS (SELECT DISTINCT author_id, org_id FROM mentions WHERE org_id IS NOT NULL),
covers AS (SELECT DISTINCT work_id, topic_id, score FROM mentions)
"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("org_id"), F.floor("s_acctbal").cast("long").alias("citation_count"))


def orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("country"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("field"), F.col("p_brand").alias("subfield"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    date = F.when(key % 17 == 0, None).when(key % 5 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    title = F.concat(F.lit("Work "), key.cast("string"), F.lit(" on "), F.col("o_orderpriority"), F.lit(" matters"))
    return _read(spark, sf_dir, "orders").select(
        key.alias("id"), title.alias("title"), date.alias("publication_date"), F.when(key % 2 == 0, F.year("o_orderdate")).alias("year"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("citation_count"), F.col("o_orderpriority").alias("document_type"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount")
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return line.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
        F.col("l_orderkey").alias("work_id"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("author_id"), F.col("s_nationkey").cast("long").alias("org_id"), F.col("l_partkey").alias("topic_id"), F.round(1 - F.col("l_discount"), 2).alias("score")
    )


def nested_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with lists of authors and topics in line order; orders without line items have none."""
    m = mentions(spark, sf_dir).groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("n", "author_id", "org_id", "topic_id", "score"))).alias("ms"))
    lists = m.select(
        "work_id", F.transform("ms", lambda x: F.struct(x["author_id"].alias("author_id"), x["org_id"].alias("org_id"))).alias("authors"), F.transform("ms", lambda x: F.struct(x["topic_id"].alias("topic_id"), x["score"].alias("score"))).alias("topics")
    )
    return works(spark, sf_dir).join(lists, F.col("id") == F.col("work_id"), "left").drop("work_id")


def authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by work, as most joins of them ask for."""
    return mentions(spark, sf_dir).select("author_id", "work_id").repartition("work_id").distinct()


def affiliated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).where("org_id is not null").select("author_id", "org_id").distinct()


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select("work_id", "topic_id", "score").distinct()


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw publications: orders with their suppliers as authors, nations as affiliations and parts as keywords."""
    n = orgs(spark, sf_dir).select(F.col("id").alias("org_id"), F.col("name").alias("org_name"), "country")
    a = authors(spark, sf_dir).select(F.col("id").alias("author_id"), F.col("name").alias("author_name"))
    t = topics(spark, sf_dir).select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name"), "field")
    m = mentions(spark, sf_dir).join(n, "org_id").join(a, "author_id").join(t, "topic_id")
    two = (F.lit(30) + F.col("topic_id") % 20).cast("string")
    four = F.concat(two, F.lpad((F.col("topic_id") % 100).cast("string"), 2, "0"))
    entity = lambda kind, code, name, cat: F.struct(F.concat(F.lit(kind), F.col("topic_id").cast("string")).alias("id"), F.struct(F.concat(code, F.lit(" "), F.col(name)).alias("name"), cat.alias("uber_cat_id")).alias("details"))
    group = F.to_json(F.struct(F.array(entity("f", two, "field", F.concat(F.lit("9"), two)), entity("s", four, "topic_name", F.concat(F.lit("8"), four))).alias("entities")))
    row = F.struct(
        "n", F.struct(F.col("author_name").alias("name"), F.concat(F.lit("ur."), F.col("author_id").cast("string")).alias("researcher_id"), F.array("org_name").alias("affiliations")).alias("author"),
        F.struct(F.col("org_name").alias("name"), F.concat(F.lit("grid."), F.col("org_id").cast("string")).alias("org_id"), F.col("country"), F.when(F.col("org_id") % 2 == 0, "Education").alias("type")).alias("org"), F.col("topic_name").alias("plain"), group.alias("grp"),
    )
    lists = m.groupBy("work_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    w = works(spark, sf_dir)
    pick = lambda k: F.transform("rows", lambda x: x[k])
    return w.join(lists, F.col("id") == F.col("work_id"), "left").select(
        F.concat(F.lit("pub."), F.col("id").cast("string")).alias("publication_id"), "title", F.when(F.col("id") % 4 != 0, F.col("title")).alias("abstract"), "publication_date", F.concat(F.lit("https://host/details/publication/pub."), F.col("id").cast("string"), F.lit("?q=1")).alias("url"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("10.1/"), F.col("id").cast("string"))).alias("doi"), F.lit(None).cast("string").alias("venue"), F.when(F.col("id") % 11 != 0, F.col("document_type")).alias("document_type"),
        F.when(F.col("id") % 7 != 0, F.col("citation_count")).alias("citations_count"), pick("author").alias("authors"), pick("org").alias("organizations"), F.concat(pick("plain"), pick("grp")).alias("keywords"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author vectors: every embedding, with counts that follow from its id."""
    v = F.col("vec_id")
    return _read(spark, sf_dir, "embeddings").select(
        v.alias("id"), v.alias("author_id"), F.concat(F.lit("Author "), v.cast("string")).alias("author_name"), "embedding", (v % 20 + 1).alias("num_abstracts"), (v * 7 % 400).alias("citation_count")
    )


def directory_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, mail): part and customer names; every second customer has an address."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower("c_name"), F.lit("@example.org"))).alias("mail"))
    p = _read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().select("name", F.concat(F.replace("name", F.lit(" "), F.lit(".")), F.lit("@example.org")).alias("mail"))
    return c.unionByName(p)
