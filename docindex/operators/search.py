"""Exact filtered vector top-k (V1-V4).

Vectors are dealt by (filter key, salt) and queries by (filter key, slice), and each block of vectors meets each slice of its key's
queries: a hot key is spread over many tasks of bounded size. A task passes over the pieces of its block that cannot hold any of the k best, multiplies
the others, keeps the k best of each query by exact cosines, and one window merges the blocks' finds; pairs are never rows.

Whole rankings (V3) have a row for each pair: a task gets a slice of a document's queries and then its chunks by their numbers, and ranks
them itself; only documents of more than WHOLE chunks are scored by blocks and ranked by a window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from .inference import score_pairs

#: Vectors of a block that a key is cut into, and queries of a slice that meets it.
BLOCK, SLICE = 20_000, 4096
#: Rows of a piece of a block on average: what is passed over at once.
PIECE = 256
#: What a product of matrices may be off by; all that near are scored again pair by pair.
CLOSE = 1e-9
#: What the difference of two angles may be off by: near 0 an angle has half the digits of its cosine.
ANGLE = 1e-7
RERANKED = 20
#: Scores that a task holds to rank them, and chunks of a document up to which it does.
PAIRS, WHOLE = 1 << 22, 1 << 18
#: Queries and chunks whose products stay in a core's cache, scores that are made at once, and rows of an output batch.
TILE, SCORED, OUT = (64, 512), 1 << 20, 1 << 16


def exact_cosines(one: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The cosine of each row with its other one: its bits depend on the two vectors alone, so that ties are the same in every block."""
    norm = lambda m: np.maximum(np.sqrt((m * m).sum(axis=-1)), np.finfo(float).tiny)
    return (rows * one).sum(axis=1) / (norm(rows) * norm(one))


def candidates(q: np.ndarray, m: np.ndarray, k: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(query, row) of all unit rows of m that may be among the k best of unit queries q, the pieces that were scored and all there are,
    each counted once a query.

    Rows are dealt to pieces by their nearest pivot (rows at even distances), and a piece knows its largest angle to the pivot. A query
    scores the piece of its nearest pivot first; then only pieces that the angles leave a chance against its k-th score (the triangle
    inequality on the sphere), so that what is left out is certainly no better."""
    n = len(m) // piece
    pivots = m[np.linspace(0, len(m) - 1, max(n, 1)).astype(np.int64)]
    own = (m @ pivots.T).argmax(axis=1)
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(len(pivots) + 1))
    angle = lambda c: np.arccos(np.clip(c, -1, 1))
    radius = np.array([angle((m[order[a:z]] * pivots[b]).sum(axis=1)).max(initial=0) for b, (a, z) in enumerate(zip(edges, edges[1:], strict=False))])
    away = angle(q @ pivots.T)
    bound = np.cos(np.maximum(away - radius - ANGLE, 0)) if n > 1 else np.ones_like(away)
    first, kth = away.argmin(axis=1), np.full(len(q), -np.inf)
    found, met = [], 0
    for again in (False, True):
        for b, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
            which = np.flatnonzero((first != b) & (bound[:, b] >= kth - 2 * CLOSE) if again else first == b) if z > a else np.empty(0, np.int64)
            for at in range(0, len(which), 256):
                some = which[at : at + 256]
                score = q[some] @ m[order[a:z]].T
                if z - a >= k:
                    kth[some] = np.maximum(kth[some], np.partition(score, -k, axis=1)[:, -k])
                i, j = np.nonzero(score >= kth[some][:, None] - CLOSE)
                found.append((some[i], order[a + j], score[i, j]))
            met += len(which)
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    fine = score >= kth[i] - CLOSE
    return i[fine], j[fine], met, len(q) * int((np.diff(edges) > 0).sum())


def top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str, id_column: str) -> DataFrame:
    """query_id, id_column, score, rank: the k vectors of largest cosine among those with the query's key.

    queries: query_id (long), key, dense. vectors: id_column (of any type that orders, unique), key, dense. Ties go to the smaller id."""
    pieces = lambda df, most, name: df.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = pieces(vectors, BLOCK, "_salts").join(pieces(queries, SLICE, "_slices"), key)
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    v = vectors.join(sizes, key).select(F.col(key).alias("_key"), one_of(id_column, "_salts").alias("_salt"), all_of("_slices").alias("_slice"), F.col(id_column).alias("_id"), as_double("dense").alias("_v"))
    q = queries.join(sizes, key).select(F.col(key).alias("_key"), all_of("_salts").alias("_salt"), one_of("query_id", "_slices").alias("_slice"), F.col("query_id").alias("_q"), as_double("dense").alias("_v"))

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), np.finfo(float).tiny)

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["_q"].iloc[:0], "found": right["_id"].iloc[:0], "score": np.empty(0)})
        ids, asked, given = right["_id"].to_numpy(), left["_q"].to_numpy(), np.stack(right["_v"])
        order, some = np.unique(ids, return_inverse=True)[1], np.stack(left["_v"])
        i, j, _, _ = candidates(unit(some), unit(given), k)
        score = np.concatenate([exact_cosines(some[i[at : at + 50_000]], given[j[at : at + 50_000]]) for at in range(0, len(i), 50_000)])
        best = np.lexsort((order[j], -score, i))
        i, j, score = i[best], j[best], score[best]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pd.DataFrame({"query_id": asked[i[kept]], "found": ids[j[kept]], "score": score[kept]})

    found = q.groupBy("_key", "_salt", "_slice").cogroup(v.groupBy("_key", "_salt", "_slice")).applyInPandas(block, f"query_id long, found {vectors.schema[id_column].dataType.simpleString()}, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumnRenamed("found", id_column)


def candidate_counts(queries: DataFrame, vectors: DataFrame, key: str = "user_id") -> DataFrame:
    """query_id and how many vectors it is scored against, those of its own key."""
    n = vectors.groupBy(key).agg(F.count("*").alias("candidates"))
    return queries.select("query_id", key).join(n, key, "left").select("query_id", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def query_memory(queries: DataFrame, memory: DataFrame, k: int = 5) -> DataFrame:
    """V1: the k nearest points of the same user, with their text, session, number and time. Points go by point_id: chunk numbers
    start anew in every session."""
    if not 1 <= k <= 50:
        raise ValueError("k 1..50")
    found = top_k(queries, memory, k, "user_id", "point_id")
    return found.join(memory.select("point_id", "user_id", "session_id", "chunk_no", "text", "created_at"), "point_id")


def query_notes(queries: DataFrame, notes: DataFrame, k: int = 10, statuses: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """V2: as V1 over notes, filtered by status and type before anything is scored."""
    rows = notes
    if statuses:
        rows = rows.filter(F.col("status").isin(statuses))
    if types:
        rows = rows.filter(F.col("type").isin(types))
    found = top_k(queries, rows, k, "user_id", "point_id")
    return found.join(rows.select("point_id", "user_id", "note_id", "chunk_no", "text", "type", "status", "updated_at"), "point_id")


class Vectors:
    """The vectors of an array column: their numbers, lengths (-1: null, or with a null), and sums of squares. Each is divided by a power
    of two, which changes no bit of a cosine but keeps sums from overflowing."""

    def __init__(self, column: pa.Array):
        self.lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten()
        if values.null_count:
            row = np.repeat(np.arange(len(column)), np.maximum(self.lengths, 0))
            self.lengths[row[values.is_null().to_numpy(zero_copy_only=False)]] = -1
            values = values.filter(pa.array(self.lengths[row] >= 0))
        flat, ends = values.to_numpy(zero_copy_only=False).astype(float), np.cumsum(np.maximum(self.lengths, 0))
        self.rows, self.of, self.squares = {}, {}, np.zeros(len(column))
        for n in np.unique(self.lengths[self.lengths >= 0]).tolist():
            rows = np.flatnonzero(self.lengths == n)
            m = flat.reshape(len(rows), n) if len(rows) == len(column) else flat[(ends[rows] - n)[:, None] + np.arange(n)]
            by = np.ascontiguousarray(np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, initial=0))[1][:, None]).T)
            self.rows[n], self.of[n] = rows, by
            for x in by:
                self.squares[rows] += x * x


@np.errstate(divide="ignore", invalid="ignore")
def cosines(q: Vectors, m: Vectors) -> np.ndarray:
    """The cosine of each pair by sums from the first number to the last, which are those of DuckDB's bit for bit; 0 if a vector is
    zero, -inf for null: a vector is null or has one, or their lengths differ."""
    out = np.full((len(q.lengths), len(m.lengths)), -np.inf)
    for n in q.of.keys() & m.of.keys():
        some, a, b = np.empty((len(q.rows[n]), len(m.rows[n]))), q.of[n], m.of[n]
        for i in range(0, some.shape[0], TILE[0]):
            for j in range(0, some.shape[1], TILE[1]):
                at = slice(i, i + TILE[0]), slice(j, j + TILE[1])
                dot = np.zeros_like(some[at])
                product = np.empty_like(dot)
                for x, y in zip(a[:, at[0], None], b[:, at[1]], strict=True):
                    dot += np.multiply(x, y, out=product)
                some[at] = dot
        some /= np.sqrt(q.squares[q.rows[n], None] * m.squares[m.rows[n]])
        np.clip(some, -1, 1, out=some)
        if some.shape == out.shape:
            out = some
        else:
            out[np.ix_(q.rows[n], m.rows[n])] = some
    zero = lambda v: (v.lengths >= 0) & (v.squares == 0)
    for rows, columns in ((zero(q), m.lengths >= 0), (q.lengths >= 0, zero(m))):
        if rows.any() and columns.any():
            out[np.ix_(rows, columns)] = 0
    return out


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The batches, cut where the named columns (without nulls) change, and whether they changed before it."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(c) for c in names]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        change[0] = [c[0].as_py() for c in columns] != last
        starts = np.unique(np.append(np.flatnonzero(change), 0))
        for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
            yield bool(change[a]), b.slice(a, z - a)
        last = [c[-1].as_py() for c in columns]


def score_chunks(queries: DataFrame, chunks: DataFrame, key: str = "file_id") -> DataFrame:
    """V3: query_id, chunk_no, score, rank: every chunk of the query's document, by falling cosine, then by number; null scores come last.

    queries: query_id (of one document), key, dense; chunks: key, chunk_no, dense. What else they have, the caller joins."""
    asked, number = queries.schema["query_id"].dataType, chunks.schema["chunk_no"].dataType
    queries, chunks = queries.select("query_id", key, "dense"), chunks.select(key, "chunk_no", "dense")
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    at_once = F.when(F.col("_n") <= WHOLE, F.col("_asked") * F.col("_n") / PAIRS).otherwise(0)
    sizes = count(chunks, "_n").join(count(queries, "_asked"), key).select(key, "_n", F.ceil(F.greatest(F.col("_asked") / SLICE, at_once)).cast("int").alias("_slices"), F.ceil(F.col("_n") / WHOLE).cast("int").alias("_blocks"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    group = ["_key", "_slice", "_block"]

    def scored(sizes: DataFrame, ranked: bool) -> DataFrame:
        no = lambda t: F.lit(None).cast(t)
        q = queries.join(sizes, key).select(F.col(key).alias("_key"), one_of("query_id", "_slices").alias("_slice"), all_of("_blocks").alias("_block"), F.lit(0).alias("_side"), F.col("query_id").alias("_q"), no(number).alias("_no"), F.col("dense").alias("_v"))
        m = chunks.join(sizes, key).select(F.col(key).alias("_key"), all_of("_slices").alias("_slice"), one_of("chunk_no", "_blocks").alias("_block"), F.lit(1).alias("_side"), no(asked).alias("_q"), F.col("chunk_no").alias("_no"), F.col("dense").alias("_v"))
        dealt = q.unionByName(m).repartition(*group).sortWithinPartitions(*group, "_side", "_no", "_q")
        return dealt.mapInArrow(lambda batches: rankings(batches, group, ranked), f"query_id {asked.simpleString()}, chunk_no {number.simpleString()}, score double, rank int")

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_no")
    large = scored(sizes.filter(F.col("_n") > WHOLE), False).withColumn("rank", F.row_number().over(order))
    return scored(sizes.filter(F.col("_n") <= WHOLE), True).unionByName(large)


def rankings(batches: Iterator[pa.RecordBatch], group: list[str], ranked: bool) -> Iterator[pa.RecordBatch]:
    """query_id, chunk_no, score and rank (null if not ranked) of batches in which each group's queries come first, by id, then its chunks,
    by number."""
    asked, given, numbers, held, q = [], [], [], [], None
    for new, b in runs(batches, group):
        if new:
            yield from ranks(asked, numbers, held)
            asked, given, numbers, held, q = [], [], [], [], None
        first = pc.sum(pc.equal(b.column("_side"), 0)).as_py()
        if first:
            asked.append(b.column("_q").slice(0, first))
            given.append(b.column("_v").slice(0, first))
        b = b.slice(first)
        if not b.num_rows or not asked:
            continue
        q = q or Vectors(pa.concat_arrays(given))
        step = max(1, SCORED // len(q.lengths))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            score, number = cosines(q, Vectors(part.column("_v"))), part.column("_no")
            if ranked:
                held.append(score)
                numbers.append(number.take(pa.array(np.arange(len(number)))))  # a copy: a slice keeps the batch and its vectors
            else:
                yield from joined((one, number, score[i], None) for i, one in enumerate(pa.concat_arrays(asked)))
    yield from ranks(asked, numbers, held)


def ranks(asked: list[pa.Array], numbers: list[pa.Array], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The ranking of a group by its queries, the numbers of its chunks and pieces of the scores of both."""
    if not held:
        return
    number, ids = pa.concat_arrays(numbers), pa.concat_arrays(asked)
    told = ids.to_pylist()
    starts = [i for i in range(len(told)) if not i or told[i] != told[i - 1]]

    def each() -> Iterator[tuple]:
        for a, z in zip(starts, [*starts[1:], len(told)], strict=True):
            # rows of one id are one query; scores go by number, so that a stable sort leaves ties in that order
            score = np.concatenate([h[a:z].T.ravel() for h in held])
            order = np.argsort(np.where(np.isnan(score), -np.inf, -score), kind="stable")
            yield ids[a], number.take(pa.array(order // (z - a))), score[order], np.arange(1, len(order) + 1, dtype=np.int32)

    yield from joined(each())


def joined(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of at least OUT rows, but for the last, of (query, its chunks' numbers, scores, ranks or None)."""
    some, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*some, strict=True)], ["query_id", "chunk_no", "score", "rank"])

    for one, number, score, rank in found:
        n = len(score)
        some.append((pa.repeat(one, n), number, pa.array(score, mask=score == -np.inf), pa.nulls(n, pa.int32()) if rank is None else pa.array(rank)))
        size += n
        if size >= OUT:
            yield batch()
            some, size = [], 0
    if some:
        yield batch()


def retrieve_rerank(queries: DataFrame, chunks: DataFrame, scorer: Callable, key: str = "file_id") -> DataFrame:
    """V4: cosine order, of which the first RERANKED are scored again and re-sorted; a score of 0 falls back to the cosine."""
    q = queries.select("query_id", key, F.col("dense").alias("_q"), *[c for c in queries.columns if c not in ("query_id", key, "dense")])
    rows = q.join(chunks, key).withColumn("score", cosine(F.col("_q"), F.col("dense"))).drop("_q")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_no")))
    first = score_pairs(rows.filter(F.col("rank") <= RERANKED), scorer)
    rest = rows.filter(F.col("rank") > RERANKED).withColumn("rerank_score", F.lit(None).cast("double"))
    used: Column = F.when(F.coalesce("rerank_score", F.lit(0.0)) != 0, F.col("rerank_score")).otherwise(F.col("score"))
    both = first.unionByName(rest)
    order = W.partitionBy("query_id").orderBy((F.col("rank") > RERANKED).cast("int"), F.desc(F.when(F.col("rank") <= RERANKED, used)), "rank")
    return both.withColumn("final_rank", F.row_number().over(order))


