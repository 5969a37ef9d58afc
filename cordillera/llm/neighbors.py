"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Vectors are scaled to length one, so the largest cosine is the maximum inner product. Each is cut into subspaces of two
components with 16 codewords, four bits. Codes and codebooks are those that minimise a loss in which the residual's part
along the vector weighs `eta` times its other part, as only the former moves large inner products: codes by coordinate
descent, codebooks by the normal equations of that loss, on a sample of at most `SAMPLE` vectors (by a hash of the id).
Every vector is indexed. A scan adds up tables of two codes at once. Of each block its best `RERANK` are ranked by the exact
cosine in double precision, and then every other vector whose table score, with a bound on its quantisation error, reaches
the k-th exact score so far: none that belongs to the k best is left out, however many near copies share its codes.

Base vectors are dealt in blocks of about `BLOCK` by a hash of the id; each block meets the queries as a stream, so a task
holds one block and one batch of queries. The base is shuffled once, the queries once for each block.

Defined cases: a vector that is null, zero or holds null or non-finite components, or whose length is not the most frequent
one (the largest of several), takes no part; equal scores go to the smaller id; rows that repeat an id count once (the smallest vector); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, BLOCK, RERANK, WIDTH, SWEEPS, ROUNDS, THRESHOLD = 4000, 16384, 128, 2, 3, 6, 0.2
ROUNDING = np.float32(1e-5)  # of table scores in single precision


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def encode(x: np.ndarray, books: np.ndarray, eta: float) -> np.ndarray:
    """Codes (n x subspaces) of unit vectors x (n x subspaces x WIDTH) by coordinate descent on the anisotropic loss."""
    n, m, _ = x.shape
    cost = np.empty((n, m, 16), np.float32)
    along = np.empty((n, m, 16), np.float32)
    for j in range(m):
        r = x[:, j, None, :] - books[j][None]
        cost[:, j], along[:, j] = (r * r).sum(2), (r * x[:, j, None, :]).sum(2)
    codes = cost.argmin(2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(SWEEPS):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            codes[:, j] = (cost[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
            total = rest + along[rows, j, codes[:, j]]
    return codes


def fit(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """(codebooks: subspaces x 16 x WIDTH, eta) of unit vectors x (n x d, d a multiple of WIDTH)."""
    n, d = x.shape
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    rng, parts = np.random.default_rng(seed), x.reshape(n, -1, WIDTH)
    m = parts.shape[1]
    books = np.stack([parts[rng.integers(0, n, 16), j] + rng.normal(0, 1e-4, (16, WIDTH)) for j in range(m)])
    for _ in range(8):  # plain codebooks first
        for j in range(m):
            near = ((parts[:, j, None] - books[j][None]) ** 2).sum(2).argmin(1)
            count = np.bincount(near, minlength=16)
            for c in range(WIDTH):
                books[j, :, c] = np.where(count > 0, np.bincount(near, parts[:, j, c], 16) / np.maximum(count, 1), books[j, :, c])
    for _ in range(ROUNDS):
        codes = encode(parts, books, eta)
        # unknown (j, code, c) of vector i: its own WIDTH entries of every subspace; loss |r|^2 + (eta - 1) (r . x)^2
        at = ((np.arange(m)[None, :] * 16 + codes)[:, :, None] * WIDTH + np.arange(WIDTH)).reshape(n, d)
        size = m * 16 * WIDTH
        design = np.zeros((size, size))
        for lo in range(0, n, 256):
            a, b = at[lo : lo + 256], x[lo : lo + 256]
            design += np.bincount((a[:, :, None] * size + a[:, None, :]).ravel(), ((eta - 1) * b[:, :, None] * b[:, None, :]).ravel(), size * size).reshape(size, size)
        design[np.diag_indices(size)] += np.bincount(at.ravel(), minlength=size) + 1e-3
        right = np.bincount(at.ravel(), (eta * x).ravel(), size) + 1e-3 * books.ravel()
        books = np.linalg.solve(design, right).reshape(m, 16, WIDTH)
    return books.astype(np.float32), eta


class Block:
    """One block's index: pairs of codes as bytes, and the vectors for the exact scores."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, books: np.ndarray, eta: float) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.v, self.books = ids[order], v[order], books
        self.norms = np.sqrt((self.v * self.v).sum(1))
        unit = _padded(self.v / self.norms[:, None]).astype(np.float32)
        codes = encode(unit.reshape(len(ids), -1, WIDTH), books, eta)
        made = books[np.arange(codes.shape[1])[None, :], codes].reshape(len(ids), -1)
        # a vector x of length one, quantised to y: y . x, and the length of y - (y . x) x, for the bound in `search`
        along = np.einsum("nd,nd->n", made, unit, dtype=float)
        self.along, self.across = along.astype(np.float32), np.sqrt(np.maximum(((made - along[:, None] * unit) ** 2).sum(1), 0)).astype(np.float32)
        if codes.shape[1] % 2:
            codes = np.hstack([codes, np.zeros((len(codes), 1), codes.dtype)])
        self.bytes = np.ascontiguousarray((codes[:, 0::2] * 16 + codes[:, 1::2]).astype(np.uint8).T)

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids and scores for one query, its own id left out."""
        norm = np.sqrt((q * q).sum())
        part = _padded((q / norm)[None]).astype(np.float32).reshape(-1, 1, WIDTH)
        table = (self.books * part).sum(2)
        if len(table) % 2:
            table = np.vstack([table, np.zeros((1, 16), np.float32)])
        pairs = (table[0::2, :, None] + table[1::2, None, :]).reshape(-1, 256)
        score = pairs[0][self.bytes[0]]
        for t, b in zip(pairs[1:], self.bytes[1:]):
            score += t[b]
        score[self.ids == own] = -np.inf
        first = max(RERANK, k)
        if len(score) > first:
            at = np.argpartition(score, len(score) - first)[len(score) - first :]
        else:
            at = np.arange(len(score))
        ids, exact = self._best(at[self.ids[at] != own], q, norm, k)
        if len(score) > first:
            # with c the cosine of q and x, the table score q . y is y . x * c + q . (y - (y . x) x), the latter at least
            # -across * sqrt(1 - c * c); so a c that reaches the k-th one needs at least this score
            least = exact[-1] if len(exact) == k else -1.0
            need = self.along * np.float32(least) - self.across * np.float32(np.sqrt(max(1 - least * least, 0.0)) if least > 0 else 1.0)
            more = (score >= need - ROUNDING) | (self.along <= 0)
            more[at] = False
            more[self.ids == own] = False
            if more.any():
                ids, exact = self._best(np.concatenate([np.searchsorted(self.ids, ids), np.flatnonzero(more)]), q, norm, k)
        return ids, exact

    def _best(self, at: np.ndarray, q: np.ndarray, norm: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        exact = (self.v[at] * q).sum(1) / (self.norms[at] * norm)
        best = np.lexsort((self.ids[at], -exact))[:k]
        return self.ids[at][best], exact[best]


def _padded(x: np.ndarray) -> np.ndarray:
    return x if x.shape[1] % WIDTH == 0 else np.hstack([x, np.zeros((len(x), WIDTH - x.shape[1] % WIDTH), x.dtype)])


def search(base: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """base, queries: (id, v). query_id, rank, vec_id, score: the k best of every query, itself left out."""
    spark = base.sparkSession
    base, queries = (x.groupBy("id").agg(F.min("v").alias("v")) for x in (base, queries))
    n = base.count()
    picked = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array(picked["v"].tolist())
    books, eta = fit(_padded(x / np.sqrt((x * x).sum(1, keepdims=True))))
    blocks = -(-n // BLOCK)
    rows = base.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), "id", "v")
    dealt = rows.union(asked).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, parts, index = None, [], [], None
        for batch in batches:
            found = []
            for (block, kind), own in batch.groupby(["block", "kind"], sort=True):
                if block != at:
                    at, ids, parts, index = block, [], [], None
                v = np.array(own["v"].tolist(), float)
                if kind == 0:
                    ids.append(own["id"].to_numpy())
                    parts.append(v)
                elif parts:
                    index = index or Block(np.concatenate(ids), np.concatenate(parts), books, eta)
                    for q, vector in zip(own["id"].tolist(), v):
                        found += [(q, i, s) for i, s in zip(*index.search(q, vector, k))]
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = dealt.mapInPandas(run, "query_id long, vec_id long, score double")  # k rows for each query and block
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbors_query(spark, sf_dir: str) -> DataFrame:
    base = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(base, base.where(F.col("id") % 50 == 0))
