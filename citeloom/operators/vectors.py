"""Abstract embeddings, author vectors and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import l2_distance
from ..schemas import EMBEDDING_DIM
from ..sources.files import Files

#: Queries of a block, which is sent to every task.
MOST_QUERIES = 50_000
MODELS: dict[str, tuple[int, Callable[[int], Callable[[list[str]], np.ndarray]] | None]] = {"hashed-bag-of-words": (EMBEDDING_DIM, None)}


def hashed_bag_of_words(texts: list[str], dim: int) -> np.ndarray:
    """Signed hash counts of lower-case words, scaled to length one: a stand-in encoder that needs no model files."""
    import zlib

    words = [(text or "").lower().split() for text in texts]
    hashes = {w: zlib.crc32(w.encode("utf-8", "replace")) for w in set().union(*words)} if words else {}  # each word once a batch
    h = np.fromiter((hashes[w] for x in words for w in x), np.int64)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in words])
    out = np.bincount(row * dim + (h >> 1) % dim, np.where(h & 1, 1.0, -1.0), len(texts) * dim).reshape(len(texts), dim).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_text(text: Column, model: str = "hashed-bag-of-words", encoder: Callable[[list[str]], np.ndarray] | None = None) -> Column:
    """Vectors of texts; an unknown model is an error.  ``encoder`` replaces the stand-in for the model."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known: {sorted(MODELS)}")
    dim = MODELS[model][0]

    @F.pandas_udf("array<float>")
    def embed(values: pd.Series) -> pd.Series:
        texts = values.fillna("").tolist()
        return pd.Series(list(encoder(texts) if encoder else hashed_bag_of_words(texts, dim)))

    return embed(text)


def author_abstracts(works: DataFrame) -> DataFrame:
    """(author_id, abstracts, num_abstracts): the abstracts that aren't blank, by author, one a mention, in order of text.

    A list is as long as its author's works; means of vectors come from ``author_embeddings``, which gathers none."""
    from .filters import nonblank_abstracts

    each = nonblank_abstracts(works).select("abstract", F.explode("authors.author_id").alias("author_id")).where("author_id is not null")
    return each.groupBy("author_id").agg(F.sort_array(F.collect_list("abstract")).alias("abstracts"), F.count(F.lit(1)).alias("num_abstracts"))


def author_embeddings(vectors: DataFrame, author: str = "author_id", embedding: str = "embedding") -> DataFrame:
    """(author_id, embedding, num_abstracts): the mean of each author's vectors, summed map-side."""
    grouped = vectors.groupBy(F.col(author).alias("author_id")).agg(Summarizer.mean(array_to_vector(F.col(embedding).cast("array<double>"))).alias("m"), F.count(F.lit(1)).alias("num_abstracts"))
    return grouped.select("author_id", vector_to_array("m", "float32").alias("embedding"), "num_abstracts")


def vector_search(vectors: DataFrame, query: list[float], limit: int = 10, offset: int = 0, where: str | None = None, fields: list[str] | None = None, squared: bool = False) -> DataFrame:
    """The nearest by distance, then id, after ``where``; ``has_more`` tells if rows follow the page."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100 and offset 0 or more")
    df = vectors.where(F.expr(where)) if where else vectors
    scored = df.withColumn("distance", l2_distance(F.col("embedding"), F.array(*map(F.lit, map(float, query))), squared))
    kept = scored.select("id", *(fields or [c for c in vectors.columns if c not in ("id", "embedding")]), "distance")
    return paginate(kept, [F.col("distance"), F.col("id")], limit, offset)


def paginate(df: DataFrame, order: list[Column], limit: int = 10, offset: int = 0) -> DataFrame:
    """One page in order, with ``returned`` and ``has_more``."""
    top = df.orderBy(*order).limit(offset + limit + 1)
    placed = top.withColumn("_r", F.row_number().over(Window.orderBy(*order)))  # offset + limit + 1 rows
    more = F.max("_r").over(Window.partitionBy()) > offset + limit
    page = placed.withColumn("has_more", more).where((F.col("_r") > offset) & (F.col("_r") <= offset + limit))
    return page.withColumn("returned", F.count(F.lit(1)).over(Window.partitionBy())).drop("_r")


def text_search(vectors: DataFrame, texts: str, limit: int = 10, offset: int = 0, **how) -> DataFrame:
    """``vector_search`` for a text, by the stand-in encoder of the vectors' dimension."""
    dim = len(vectors.select("embedding").first()[0])
    return vector_search(vectors, hashed_bag_of_words([texts], dim)[0].tolist(), limit, offset, **how)


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = MOST_QUERIES) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of each query, by distance and id.

    Queries (query_id, embedding) are counted and, where they are more than ``block``, dealt into blocks by hash.  Each
    block is sent to every task, which keeps k rows a query; those meet by query.
    """
    n, out = max(1, -(-queries.count() * 5 // (4 * block))), None  # room for uneven blocks
    for b in range(n):
        found = _block_knn(vectors, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) if n > 1 else queries, k)
        out = found if out is None else out.unionByName(found)
    return out


def _block_knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.orderBy("query_id").collect()
    ids = [r["query_id"] for r in rows]
    matrix = np.array([r["embedding"] for r in rows], np.float64) if rows else np.zeros((0, 0))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q = shared.value
        best: list[list[tuple[float, int]]] = [[] for _ in qids]
        for pdf in batches:
            if not len(pdf) or not len(qids):
                continue
            x, keys = np.stack(pdf["embedding"].to_numpy()).astype(np.float64), pdf["id"].to_numpy()
            for a in range(0, len(qids), 256):
                part = q[a : a + 256]
                near = np.maximum((part**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * part @ x.T, 0)
                for j, row in enumerate(near):
                    few = np.argpartition(row, min(k, len(row)) - 1)[:k] if len(row) > k else np.arange(len(row))
                    few = np.flatnonzero(row <= row[few].max() + 1e-9)
                    exact = np.sqrt(((x[few] - part[j]) ** 2).sum(1))
                    best[a + j] = sorted(best[a + j] + list(zip(exact.tolist(), keys[few].tolist())))[:k]
        out = [(qid, key, d) for qid, found in zip(qids, best) for d, key in found]
        yield pd.DataFrame(out, columns=["query_id", "id", "distance"])

    local = vectors.select("id", "embedding").mapInPandas(nearest, "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ivf_index(vectors: DataFrame, nlist: int = 128, seed: int = 7, sample: int = 100_000) -> tuple[DataFrame, list]:
    """(vectors with their cell, centroids): cells fitted on a bounded sample by hash of id; every row is assigned."""
    n = vectors.count()
    share = min(1.0, sample / max(1, n))
    as_vector = vectors.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    fitted = as_vector.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003)
    model = KMeans(k=max(2, min(nlist, n // 4)), seed=seed, maxIter=10, featuresCol="_v", predictionCol="cell").fit(fitted)
    return model.transform(as_vector).drop("_v"), model.clusterCenters()


def write_ivf(vectors: DataFrame, folder: str, nlist: int = 128, **how) -> None:
    """Inverted lists (id, embedding) by cell, as a partitioned table that a search reads some cells of, and the centroids."""
    indexed, centers = ivf_index(vectors, nlist, **how)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    vectors.sparkSession.createDataFrame(rows, "cell int, center array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    indexed.select("id", "embedding", "cell").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/lists")


def _cells_in_order(spark: SparkSession, folder: str, queries: np.ndarray) -> np.ndarray:
    """(queries, cells): cells from the nearest centroid on."""
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()  # nlist rows
    cells, centers = np.array([r["cell"] for r in rows]), np.array([r["center"] for r in rows], np.float64)
    apart = (queries**2).sum(1)[:, None] + (centers**2).sum(1)[None, :] - 2 * queries @ centers.T
    return cells[np.argsort(apart, axis=1, kind="stable")]


def ivf_search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, nprobe: int = 10, block: int = MOST_QUERIES) -> DataFrame:
    """(query_id, id, distance, rank) by the ``nprobe`` cells nearest to each query, then exact distances.

    Queries are dealt into blocks as in ``batch_knn``; a block reads the cells that it probes and no other.
    """
    n, out = max(1, -(-queries.count() * 5 // (4 * block))), None
    for b in range(n):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) if n > 1 else queries
        found = _probe(spark, folder, some.orderBy("query_id").collect(), k, nprobe)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)


def _probe(spark: SparkSession, folder: str, rows: list, k: int, nprobe: int) -> DataFrame:
    ids, matrix = [r["query_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
    probed = _cells_in_order(spark, folder, matrix)[:, :nprobe] if rows else np.zeros((0, 0), int)
    of_cell = {int(c): np.flatnonzero((probed == c).any(1)) for c in np.unique(probed)}
    shared = spark.sparkContext.broadcast((ids, matrix, of_cell))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, of_cell = shared.value
        best: dict[int, list[tuple[float, int]]] = {}
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                x, keys, asked = np.stack(part["embedding"].to_numpy()).astype(np.float64), part["id"].to_numpy(), of_cell[int(cell)]
                for a in range(0, len(asked), 256):
                    some = asked[a : a + 256]
                    near = np.maximum((matrix[some] ** 2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * matrix[some] @ x.T, 0)
                    for q, row in zip(some.tolist(), near):
                        few = np.flatnonzero(row <= np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1] + 1e-9)
                        exact = np.sqrt(((x[few] - matrix[q]) ** 2).sum(1))
                        best[q] = sorted(best.get(q, []) + list(zip(exact.tolist(), keys[few].tolist())))[:k]
        yield pd.DataFrame([(ids[q], key, d) for q, found in best.items() for d, key in found], columns=["query_id", "id", "distance"])

    lists = spark.read.parquet(f"{folder}/lists").where(F.col("cell").isin(sorted(of_cell)))  # the other cells' files aren't read
    return lists.select("id", "embedding", "cell").mapInPandas(nearest, "query_id long, id long, distance double")


def ivf_recall(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(nprobe, recall): the part of the queries' true ``k`` nearest that the nearest ``nprobe`` cells hold, for every
    number of cells.  Queries are a sample that fits the driver."""
    rows = queries.orderBy("query_id").collect()
    order = _cells_in_order(spark, folder, np.array([r["embedding"] for r in rows], np.float64))
    places = spark.createDataFrame([(r["query_id"], int(c), i) for r, cells in zip(rows, order) for i, c in enumerate(cells, 1)], "query_id long, cell int, place int")
    lists = spark.read.parquet(f"{folder}/lists")
    true = batch_knn(lists.select("id", "embedding"), queries, k).join(lists.select("id", "cell"), "id")
    held = places.select("place").distinct().join(true.join(places, ["query_id", "cell"]).groupBy("place").count(), "place", "left")
    sums = F.sum(F.coalesce("count", F.lit(0))).over(Window.orderBy("place"))  # a row a cell
    every = F.sum(F.coalesce("count", F.lit(0))).over(Window.partitionBy())
    return held.select(F.col("place").alias("nprobe"), F.round(sums / every, 6).alias("recall"))


def ivf_bytes(spark: SparkSession, folder: str, cells: list[int] | None = None) -> int:
    """Bytes of the inverted lists' files, of some cells or of all."""
    files = Files(spark, f"{folder}/lists")
    wanted = [name for name, _ in files.names() if name.startswith("cell=") and (cells is None or int(name[5:]) in cells)]
    return sum(size for name in wanted for _, size in files.names(name))
