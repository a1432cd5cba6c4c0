"""Questions, exact dense search, fusion, re-ranking and diversity, keyed by query."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.functions import text as text_functions
from paragrid.operators.index import Best
from paragrid.session import materialize

FUSION_K = 60
QUERY_TERMS = 32
ROW_BLOCK, QUERY_BLOCK = 2_048, 256
#: Numbers of the queries' vectors that are sent to all tasks at once.
SENT = 2_000_000


def query_terms(queries: DataFrame, key: str, text: Column) -> DataFrame:
    """``(key, term)``: the first ``QUERY_TERMS`` distinct terms of each query."""
    distinct = F.slice(F.array_distinct(text_functions.search_terms(text)), 1, QUERY_TERMS)
    return queries.select(F.col(key), F.explode(distinct).alias("term"))


def top(ranked: DataFrame, query: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best rows of each query with their rank, ties by key."""
    order = W.partitionBy(query).orderBy(F.desc(score), key)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(column: pa.Array) -> np.ndarray:
    """Lists of one size as rows of length one; a zero vector stays."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def dense_top(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, itself: bool = False) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the ``k`` rows of highest cosine for each query, left out itself unless ``itself``.

    Queries go to all tasks, in groups of about ``SENT`` numbers, each group in a pass of its own over the
    rows. A task multiplies block by block, keeps the ``k`` best of each query and passes on
    only those. Null vectors are in no row; a zero vector has the cosine 0.
    """
    shaped = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    data, asked = shaped(rows), materialize(shaped(queries))
    about = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")).first()
    groups = max(1, -(-about["n"] * (about["size"] or 1) // SENT))
    part = F.pmod(F.xxhash64("key"), F.lit(groups))
    found = reduce(DataFrame.unionByName, (_dense_of(data, asked.where(part == n), k, itself) for n in range(groups)))
    return top(found, "query_id", "vec_id", k)


def _dense_of(data: DataFrame, asked: DataFrame, k: int, itself: bool) -> DataFrame:
    """``(query_id, vec_id, score)``: the ``k`` best of each task for the queries, which go to all tasks."""
    spark, held = data.sparkSession, asked.toArrow()  # about ``SENT`` numbers
    if not held.num_rows:
        return spark.createDataFrame([], "query_id long, vec_id long, score double")
    sent = spark.sparkContext.broadcast((held.column("key").combine_chunks(), _unit(held.column("vector").combine_chunks())))
    shape = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ask = sent.value
        own = names.to_numpy()
        blocks = [(slice(n, n + QUERY_BLOCK), Best(n, len(own[n : n + QUERY_BLOCK]), k, -1.5)) for n in range(0, len(names), QUERY_BLOCK)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                some = batch.slice(at, ROW_BLOCK)
                keys, vectors = some.column(0), _unit(some.column(1)).T
                for block, best in blocks:
                    scores = ask[block] @ vectors
                    if not itself:
                        scores[own[block][:, None] == keys.to_numpy()[None, :]] = -2.0
                    best.offer(scores, keys)
        for _, best in blocks:
            yield from best.result(names, shape)

    return data.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, "query_id long, vec_id long, score double")


def fuse(lanes: dict[str, DataFrame], query: str, key: str, k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lanes ``(query, key, rank)``: ``(query, key, score, best_rank, lanes)``."""
    rows = None
    for name in sorted(lanes):
        lane = lanes[name].groupBy(query, key).agg(F.min("rank").alias("rank")).withColumn("lane", F.lit(name))
        rows = lane if rows is None else rows.unionByName(lane)
    return rows.groupBy(query, key).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min("rank").cast("long").alias("best_rank"), F.count("*").alias("lanes")
    )


def fused_order(fused: DataFrame, query: str, key: str) -> DataFrame:
    """The fused rows with their final rank: score, then best rank, then key."""
    order = W.partitionBy(query).orderBy(F.desc("score"), "best_rank", key)
    return fused.withColumn("rank", F.row_number().over(order))


def diverse(ranked: DataFrame, query: str, group: str, k: int, per_group: int = 2, backfill: bool = False) -> DataFrame:
    """At most ``per_group`` rows of a group, in rank order, the first ``k`` of each query, ranked anew.

    With ``backfill`` the rows over a group's limit follow after all others instead of
    being dropped. A null group limits nothing.
    """
    within = F.row_number().over(W.partitionBy(query, group).orderBy("rank"))
    marked = ranked.withColumn("_late", (within > per_group) & F.col(group).isNotNull())
    if not backfill:
        marked = marked.where("not _late")
    order = W.partitionBy(query).orderBy("_late", "rank")
    return marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_late")


def overlap(asked: Column, held: Column) -> Column:
    """The share of the asked terms that are held; 0 if none is asked."""
    asked = F.array_distinct(asked)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, held)) / F.size(asked)).otherwise(0.0)


def lexical_score(query: Column, body: Column, heading: Column, rank: Column) -> Column:
    """Weighted shares of the query's terms in body and heading, the whole phrase, and the first rank."""
    asked = text_functions.terms(query)
    phrase = F.contains(text_functions.rank_form(body), text_functions.rank_form(query)).cast("double")
    return F.round(
        0.52 * overlap(asked, text_functions.terms(body)) + 0.16 * overlap(asked, text_functions.terms(heading)) + 0.18 * phrase + 0.14 / rank, 6
    )


def partitioned_order(ranked: DataFrame, query: str, bucket: Column) -> DataFrame:
    """A stable partition: rows by bucket, in their old order within it, ranked anew."""
    order = W.partitionBy(query).orderBy("_bucket", "rank")
    return ranked.withColumn("_bucket", bucket).withColumn("rank", F.row_number().over(order)).drop("_bucket")


def ends_first(ranked: DataFrame, query: str) -> DataFrame:
    """Rows alternately at the two ends, so that the best stand first and last: place 1, n, 2, n-1, ..."""
    n = F.count("*").over(W.partitionBy(query))
    place = F.when(F.col("rank") % 2 == 1, F.floor((F.col("rank") + 1) / 2)).otherwise(n - F.floor(F.col("rank") / 2) + 1)
    return ranked.withColumn("place", place.cast("long"))


def hashed_vector(rows: DataFrame, key: str, terms: str, dimensions: int = 64) -> DataFrame:
    """``(key, dim, weight)``: signed feature hashing with 1 + ln(tf), of length one."""
    tf = rows.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    digest = F.sha2("term", 256)
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dimensions))
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = tf.groupBy(key, bucket.alias("dim")).agg(F.sum(sign * (1 + F.log(F.col("tf").cast("double")))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))  # at most ``dimensions`` rows
    return sums.where(F.abs("w") > 1e-12).select(key, "dim", F.round(F.col("w") / norm, 6).alias("weight"))


def dense_rows(rows: DataFrame, key: str, terms: Column, dimensions: int = 64) -> DataFrame:
    """``(key, vector)``: the vectors of :func:`hashed_vector` as arrays, a row at a time without any exchange; rows without terms have none."""
    own = rows.select(F.col(key), terms.alias("_terms")).where(F.size("_terms") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, tuple[int, float]] = {}
        for batch in batches:
            made = np.zeros((batch.num_rows, dimensions))
            for n, held in enumerate(batch.column(1).to_pylist()):
                for term, tf in Counter(t for t in held if t is not None).items():
                    if term not in places:
                        if len(places) > 1_000_000:
                            places.clear()
                        digest = hashlib.sha256(term.encode()).hexdigest()
                        places[term] = int(digest[:8], 16) % dimensions, 1.0 if int(digest[8], 16) % 2 == 0 else -1.0
                    place, sign = places[term]
                    made[n, place] += sign * (1 + math.log(tf))
            some = (np.abs(made) > 1e-12).any(axis=1)
            vectors = np.round(made[some] / np.linalg.norm(made[some], axis=1, keepdims=True), 6).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * dimensions, pa.int32()), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), lists], [key, "vector"])

    return own.mapInArrow(run, f"`{key}` {dict(own.dtypes)[key]}, vector array<float>")
