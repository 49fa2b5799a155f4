"""Relevance classification: TF-IDF features, metrics as plain SQL, and nearest vectors. Learners have a module of their own."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def features(column: str, prefix: str, vocabulary: int = 1 << 18) -> list:
    return [
        RegexTokenizer(inputCol=column, outputCol=f"{prefix}_words", pattern=r"\w\w+", gaps=False),
        CountVectorizer(inputCol=f"{prefix}_words", outputCol=f"{prefix}_tf", maxDF=0.85, vocabSize=vocabulary),
        IDF(inputCol=f"{prefix}_tf", outputCol=f"{prefix}_idf"),
        Normalizer(inputCol=f"{prefix}_idf", outputCol=f"{prefix}_x"),
    ]


def dealt(rows: DataFrame, key: str, each: int = 12_000) -> DataFrame:
    """rows in tasks of about `each` of them, whatever the files' splits are: learners keep the words of a whole task."""
    return rows.repartition(max(8, -(-rows.select(key).count() // each)), key)


def logistic(x: str, label: str = "label") -> LogisticRegression:
    return LogisticRegression(featuresCol=x, labelCol=label, regParam=0.01)


def metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts of the confusion matrix by their right names, and the rates that follow."""
    c = df.agg(*[F.count_if((F.col(label) == a) & (F.col(predicted) == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fn", 1, 0), ("fp", 0, 1), ("tn", 0, 0))])
    rate = lambda a, b: F.when(b == 0, 0.0).otherwise(F.bround(a / b, 6))
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return c.select("*", rate(tp + tn, tp + fn + fp + tn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 1000) -> DataFrame:
    """The k vectors with the highest cosine (to nine places, then the smaller id) for each of a stated set of queries.

    Queries go out in blocks of bounded size; of each batch of vectors only its own k best go on. Null and zero
    vectors answer and ask nothing. (query_id, vec_id, cosine, place).
    """
    import itertools

    import numpy as np
    import pyarrow as pa

    schema, out = "query_id long, vec_id long, cosine double", None
    live = "vec_id is not null and embedding is not null and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null)"
    asked = queries.where(live).select(F.col("vec_id").cast("long"), "embedding").toLocalIterator()

    def unit(rows):
        x = np.array(rows, np.float64)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def best(ids, q):
        def run(batches):
            for batch in batches:
                own, x = batch.column(0).to_numpy(), unit(batch.column(1).to_pylist())
                cosine = np.round(q @ x.T, 9)
                cosine[ids[:, None] == own[None, :]] = -np.inf
                top = [np.lexsort((own, -c))[:k] for c in cosine]
                rows = [(i, int(own[j]), float(c[j])) for i, c, t in zip(ids.tolist(), cosine, top, strict=True) for j in t if np.isfinite(c[j])]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "cosine"])

        return run

    src = vectors.where(live).select(F.col("vec_id").cast("long"), "embedding")
    while part := list(itertools.islice(asked, block)):
        found = src.mapInArrow(best(np.array([r[0] for r in part], np.int64), unit([r[1] for r in part])), schema)
        out = found if out is None else out.unionByName(found)
    out = out if out is not None else vectors.sparkSession.createDataFrame([], schema)
    w = W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
