"""Vector search: exact and list-probed top-k for many queries, joined inside Spark.

Rows and queries are packed into blocks where they lie.  A row block meets the
query blocks of its cell by an equi-join on (cell, salt), so neither side is
collected or broadcast, and a crowded cell is worked on by as many tasks as
there are salts.  A task reads one query block and then row block after row
block, keeps the best ``k`` of every query and hands on those alone.

The approximate search draws its lists' centres from a bounded sample of rows
(``MAX_LISTS`` at most) and stores every row under the list of its nearest
centre; a query probes the lists whose centres are nearest to it, and the rows
there are scored exactly.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from jobloom.runtime import top_per_key, union_all

QUERY_BLOCK = 1_000
ROW_BLOCK = 4_096
HELD = 65_536      # rows that a task holds while it packs
WAYS = 32          # tasks that may share the rows of one cell
MAX_LISTS = 4_096  # bound of the fitted centres
FETCH = 120


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays as one expression."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    size = lambda c: F.sqrt(total(F.transform(c, lambda x: x.cast("double") * x.cast("double"))))
    return dot / (size(a) * size(b))


def _unit(matrix):
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks (cell, salt, ids, vectors) of ``rows(cell, id, vector)``, at most ``size`` rows each.

    ``salt`` numbers the blocks of a task from 0 to ``WAYS - 1`` and round again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, made = {}, 0, 0

        def out(cells):
            nonlocal n, made
            for cell in cells:
                part = pd.concat(held.pop(cell))
                n -= len(part)
                for at in range(0, len(part), size):
                    some = part.iloc[at:at + size]
                    vectors = np.stack(some["vector"].to_numpy()).astype("<f8")
                    yield pd.DataFrame({"cell": [cell], "salt": [made % WAYS], "ids": [some["id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()]})
                    made += 1

        for frame in frames:
            for cell, part in frame.groupby("cell", sort=False):
                held.setdefault(cell, []).append(part)
                n += len(part)
            yield from out([c for c, parts in held.items() if sum(map(len, parts)) >= size])
            if n >= HELD:
                yield from out(list(held))
        yield from out(list(held))

    return rows.select("cell", "id", "vector").mapInPandas(run, "cell string, salt int, ids binary, vectors binary")


class _Best:
    """The best ``k`` rows of every query of a block so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, _unit(vectors), k
        self.query, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.vectors @ _unit(vectors).T
        bar = self.least
        if len(ids) > self.k:
            bar = np.maximum(bar, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        at, row = np.nonzero(scores >= bar[:, None])
        query, found, score = np.r_[self.query, at], np.r_[self.row, ids[row]], np.r_[self.score, scores[at, row]]
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.least[query[place == self.k - 1]] = score[place == self.k - 1]
        self.query, self.row, self.score = query[kept], found[kept], score[kept]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.query], "id": self.row, "similarity": self.score})


def _tops(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    best = None
    for frame in frames:
        for asked, ids, vectors in zip(frame["asked"], frame["ids"], frame["vectors"]):
            ids = np.frombuffer(ids, np.int64)
            matrix = np.frombuffer(vectors, "<f8").reshape(len(ids), -1)
            if asked:
                if best is not None:
                    yield best.frame()
                best = _Best(ids, matrix, k)
            else:
                best.add(ids, matrix)
    if best is not None:
        yield best.frame()


def cell_topk(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top-k by cosine of ``queries(cell, query_id, query_vector)`` among ``rows(cell, id, embedding)`` of their cells; ids are long."""
    row_blocks = _packed(rows.select(F.col("cell").cast("string"), "id", F.col("embedding").alias("vector")), ROW_BLOCK)
    query_blocks = _packed(queries.select(F.col("cell").cast("string"), F.col("query_id").alias("id"), F.col("query_vector").alias("vector")), QUERY_BLOCK)
    # A block of queries is told from others of its cell by its ids.
    salted = query_blocks.withColumn("block", F.sha2("ids", 256)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    here = row_blocks.join(salted.select("cell", "salt", "block"), ["cell", "salt"])
    met = union_all([salted.withColumn("asked", F.lit(True)), here.withColumn("asked", F.lit(False))])
    ordered = met.repartition("cell", "block", "salt").sortWithinPartitions("cell", "block", "salt", F.desc("asked"))
    partial = ordered.select("asked", "ids", "vectors").mapInPandas(functools.partial(_tops, k=k), "query_id long, id long, similarity double")
    return top_per_key(partial, ["query_id"], [F.desc("similarity"), F.asc("id")], k)


def vector_topk(rows: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """Exact top-k by cosine for every query (query_id, query_vector)."""
    everywhere = lambda df: df.withColumn("cell", F.lit("all"))
    return cell_topk(everywhere(rows.filter("embedding is not null")), everywhere(queries.filter("query_vector is not null")), k)


def fit_lists(rows: DataFrame, lists: int) -> pd.DataFrame:
    """Centres (list, vector): as many rows as lists, those whose ids have the least digests, unit length.

    ``lists`` is cut to ``MAX_LISTS``, which bounds what the driver gets.
    """
    drawn = rows.filter("embedding is not null").orderBy(F.md5(F.col("id").cast("string")), "id").limit(min(lists, MAX_LISTS))
    out = drawn.select(F.col("id").alias("list"), F.col("embedding").alias("vector")).toPandas().sort_values("list", ignore_index=True)
    if len(out):
        out["vector"] = list(_unit(np.stack(out["vector"].to_numpy()).astype(float)))
    return out


def nearest_lists(vector: Column, centres: pd.DataFrame, n: int) -> Column:
    """The ``n`` lists whose centres are nearest, nearest first; ties go to the lesser list."""
    ids = centres["list"].to_numpy(np.int64)
    matrix = np.stack(centres["vector"].to_numpy()) if len(centres) else np.zeros((0, 0))

    @F.pandas_udf("array<long>")
    def run(batch: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(batch), ROW_BLOCK):
            scores = np.stack(batch.iloc[at:at + ROW_BLOCK].to_numpy()).astype(float) @ matrix.T
            out += list(ids[np.argsort(-scores, axis=1, kind="stable")[:, :n]])
        return pd.Series(out, index=batch.index, dtype=object)

    return run(vector)


def write_lists(rows: DataFrame, path: str, centres: pd.DataFrame) -> None:
    """Store the rows by list; a crowded list is spread over many files."""
    placed = rows.filter("embedding is not null").withColumn("list", nearest_lists(F.col("embedding"), centres, 1)[0])
    placed.write.mode("overwrite").option("maxRecordsPerFile", 200_000).partitionBy("list").parquet(path)


def ann_topk(rows: DataFrame, queries: DataFrame, centres: pd.DataFrame, probes: int, k: int = 50) -> DataFrame:
    """Approximate top-k: rows of the ``probes`` lists nearest to a query are scored exactly.

    ``rows`` are those of ``write_lists``, with their ``list``, or others, which
    are placed here.  The recall follows from ``probes``; where vectors have no
    clusters most lists must be probed.
    """
    if "list" not in rows.columns:
        rows = rows.filter("embedding is not null").withColumn("list", nearest_lists(F.col("embedding"), centres, 1)[0])
    asked = queries.filter("query_vector is not null").withColumn("cell", F.explode(nearest_lists(F.col("query_vector"), centres, probes)))
    return cell_topk(rows.withColumn("cell", F.col("list")), asked, k)
