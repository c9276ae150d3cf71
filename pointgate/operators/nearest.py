"""Nearest vectors by cosine, exact, in blocks of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cosine_topk(queries: DataFrame, vectors: DataFrame, *, id: str, vector: str, k: int, block: int = 2_000) -> DataFrame:
    """(query_id, id, similarity): the ``k`` most similar vectors of each query, equal ones by id; a query isn't its own answer.

    Queries and vectors are dealt into blocks of about ``block`` rows by a hash of the id.  Every
    pair of blocks is one matrix product, of which only the best ``k`` of each query leave the
    task.  Similarities are compared to 7 places.  Rows without id, without vector or with a vector
    of length zero have no similarity and are left out.
    """
    kind = vectors.schema[id].dataType.simpleString()
    usable = F.col(id).isNotNull() & F.exists(vector, lambda x: x != 0)
    queries, vectors = (df.where(usable).select(F.col(id).alias("_id"), F.col(vector).cast("array<double>").alias("_v")) for df in (queries, vectors))
    n_q, n_v = (max(1, math.ceil(df.count() / block)) for df in (queries, vectors))
    dealt = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_qb", dealt(n_q)).withColumn("_vb", every(n_v))
    v = vectors.withColumn("_vb", dealt(n_v)).withColumn("_qb", every(n_q))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], id: [], "similarity": []}
        if len(a) and len(b):
            b = b.sort_values("_id", ignore_index=True)
            ids = b["_id"].to_numpy()
            x, y = (np.array(m["_v"].tolist(), dtype=float) for m in (a, b))
            x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
            for qid, exact in zip(a["_id"], x @ y.T):
                row, other = np.round(exact, 7), np.flatnonzero(ids != qid)
                s = row[other]
                if len(s) > k:  # all that reach the k-th value, so that ties go by id
                    other = other[s >= np.partition(s, len(s) - k)[len(s) - k]]
                top = other[np.argsort(-row[other], kind="stable")][:k]
                out["query_id"] += [qid] * len(top)
                out[id] += ids[top].tolist()
                out["similarity"] += exact[top].tolist()
        return pd.DataFrame(out)

    x = q.groupBy("_qb", "_vb").cogroup(v.groupBy("_qb", "_vb")).applyInPandas(best, f"query_id {kind}, `{id}` {kind}, similarity double")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("similarity", 7).desc(), id))
    return x.withColumn("_r", r).where(F.col("_r") <= k).drop("_r")
