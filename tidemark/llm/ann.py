"""Nearest neighbours by inner product: anisotropic four-bit quantisation, table scans, exact reranking.

Vectors are cut into pieces of ``PIECE`` components, each coded by one of 16 centroids. Codes and centroids minimise a
loss that weighs the part of the residual parallel to the vector ``(d - 1) T^2 / (1 - T^2)`` times the rest, for
that part is what shifts large inner products. Codebooks are fitted on at most ``SAMPLE`` vectors, those whose ids hash
lowest; every vector is coded.

Rows are dealt into blocks by a hash of their id, queries likewise, and each pair of blocks meets in one task: per query a table of 16
entries for each piece is summed over the codes of the block's distinct vectors, the ``RERANK`` best of them are scored in double
precision on the original vectors, their rows of least ids take their scores, and the block's ``k`` best go on to a top-k per query: so
copies of a vector take one place of ``RERANK``. No task holds more than a block of each.

Vectors that are null, zero, of another length than the most frequent one, or that hold a null or non-finite component
take no part, nor do rows without an id. Rows of the query's own id are not its neighbours. Ties go
to the smaller id, also among equal table sums. Query rows of equal id and vector are one query; rows of one id with other vectors
are queries of their own, each with ranks from 1. Rows that repeat among the candidates are each a neighbour. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage, table

PIECE, SAMPLE, THRESHOLD, ROUNDS = 2, 16_384, 0.2, 8
ROWS_BLOCK, QUERY_BLOCK, RERANK = 8192, 2048, 256
_SCHEMA = "nth long, query_id long, vec_id long, score double"


class Codebook:
    """centers: (pieces, 16, PIECE); weight: what a parallel error costs beyond an orthogonal one."""

    def __init__(self, centers: np.ndarray, dim: int):
        self.centers, self.dim = centers, dim
        self.weight = max(0.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2) - 1)

    def _split(self, x: np.ndarray) -> np.ndarray:
        pad = -self.dim % PIECE
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, PIECE)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """(n, pieces) codes by coordinate descent on the anisotropic loss."""
        xs = self._split(x)
        us = xs / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        n, pieces = len(x), xs.shape[1]
        near = np.stack([((xs[:, m, None, :] - self.centers[m]) ** 2).sum(-1) for m in range(pieces)], 1)
        along = np.stack([((xs[:, m, None, :] - self.centers[m]) * us[:, m, None, :]).sum(-1) for m in range(pieces)], 1)
        codes = near.argmin(-1)
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for m in range(pieces):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (near[:, m] + self.weight * (rest[:, None] + along[:, m]) ** 2).argmin(-1)
                total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 1) -> Codebook:
        rng, dim = np.random.default_rng(seed), x.shape[1]
        book = cls(np.zeros((-(-dim // PIECE), 16, PIECE)), dim)
        xs = book._split(x)
        pick = rng.choice(len(x), 16, replace=len(x) < 16)
        book.centers = np.ascontiguousarray(xs[pick].transpose(1, 0, 2)) + rng.normal(0, 1e-6, (xs.shape[1], 16, PIECE))
        us = xs / np.linalg.norm(x, axis=1)[:, None, None]
        for _ in range(ROUNDS):
            codes = book.encode(x, sweeps=1)
            errors = np.stack([((xs[:, m] - book.centers[m][codes[:, m]]) * us[:, m]).sum(-1) for m in range(xs.shape[1])], 1)
            total = errors.sum(1)
            for m in range(xs.shape[1]):
                rest = total - errors[:, m]
                for c in range(16):
                    own = codes[:, m] == c
                    if own.any():
                        u, v = us[own, m], xs[own, m]
                        a = own.sum() * np.eye(PIECE) + book.weight * u.T @ u
                        b = v.sum(0) + book.weight * (u * (rest[own] + (u * v).sum(1))[:, None]).sum(0)
                        book.centers[m, c] = np.linalg.solve(a, b)
                errors[:, m] = ((xs[:, m] - book.centers[m][codes[:, m]]) * us[:, m]).sum(-1)
                total = rest + errors[:, m]
        return book

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return codes[:, 0::2] << 4 | codes[:, 1::2]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): what each packed byte adds to the inner product."""
        t = np.einsum("qmp,mcp->qmc", self._split(q), self.centers)
        t = np.pad(t, ((0, 0), (0, t.shape[1] % 2), (0, 0)))
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that can take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _distinct(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows come sorted by id. Group of each row; by group in order of least ids: its first row; all rows by group; where each begins, and the end."""
    rows = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, first, group = np.unique(rows, return_index=True, return_inverse=True)
    order = np.argsort(first)
    group = np.argsort(order)[group.ravel()]
    return group, first[order], np.argsort(group, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(group))])


def _meet(book: Codebook, k: int):
    def run(key: tuple, data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c == "score" else pa.int64()) for c in ("nth", "query_id", "vec_id", "score")})
        data = data.sort_by("vec_id")
        ids, x = data["vec_id"].to_numpy(), _matrix(data["v"], book.dim)
        packed = np.frombuffer(b"".join(data["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        group, first, members, begin = _distinct(ids, x)
        packed, x = packed[first], x[first]
        # the k least ids of a group, and room for the query's own
        take = np.minimum(np.diff(begin), k + np.unique(ids, return_counts=True)[1].max())
        nth, qids, q = queries["nth"].to_numpy(), queries["vec_id"].to_numpy(), _matrix(queries["v"], book.dim)
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(qids), 128):
            tables = book.tables(q[at : at + 128])
            sums = np.zeros((len(tables), len(x)), np.float32)
            for m in range(packed.shape[1]):
                sums += tables[:, m, :][:, packed[:, m]]
            for i, s in enumerate(sums):
                own, n = np.unique(group[slice(*(np.searchsorted(ids, qids[at + i], x) for x in ("left", "right")))], return_counts=True)
                s[own[n == np.diff(begin)[own]]] = -np.inf
                if len(s) > RERANK:
                    edge = np.partition(s, len(s) - RERANK)[len(s) - RERANK]
                    best = np.flatnonzero(s > edge)
                    best = np.concatenate([best, np.flatnonzero(s == edge)[: RERANK - len(best)]])
                else:
                    best = np.arange(len(s))
                each = take[best]
                row = members[np.repeat(begin[best] - np.cumsum(each) + each, each) + np.arange(each.sum())]
                score = np.repeat(x[best] @ q[at + i], each)
                row, score = row[ids[row] != qids[at + i]], score[ids[row] != qids[at + i]]
                order = np.lexsort((ids[row], -score))[:k]
                out.append((np.full(len(order), nth[at + i]), np.full(len(order), qids[at + i]), ids[row][order], score[order]))
        return pa.table(dict(zip(("nth", "query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def search(embeddings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row; both sides have vec_id and embedding."""
    spark = embeddings.sparkSession
    data = usable(embeddings)
    sizes = data.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes["d"], sizes["count"]
    data = data.where(F.size("v") == dim)
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    book = Codebook.fit(_matrix(sample["v"], dim))

    def coded(batches):
        for batch in batches:
            codes = book.pack(book.encode(_matrix(pa.chunked_array([batch.column("v")]), dim))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "code"])

    coded_rows = stage(data.mapInArrow(coded, "vec_id long, v array<double>, code binary"), "codes")
    asked = stage(usable(queries).where(F.size("v") == dim).distinct().withColumn("nth", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-n // ROWS_BLOCK))
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    deal = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    rows = coded_rows.withColumn("b", deal(blocks)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asks = asked.withColumn("p", deal(parts)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = rows.groupBy("b", "p").cogroup(asks.groupBy("b", "p")).applyInArrow(_meet(book, k), _SCHEMA)
    nth = F.row_number().over(Window.partitionBy("nth").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return search(embeddings, embeddings.where(F.col("vec_id") % 20 == 0), 20)
