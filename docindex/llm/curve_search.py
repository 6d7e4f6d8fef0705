"""Approximate nearest neighbours by shifted space-filling curves: several Hilbert orderings of projected vectors,
range-partitioned in Spark; neighbouring key windows merge and are reranked.

1. Vectors are scaled by a power of two, which changes no bit of a cosine, so that neither large nor small components overflow.
   Those with equal components then form a class (told apart by 128 bits), which its smallest vec_id stands for.
2. Each curve projects the classes' unit vectors to DIMENSIONS random directions, shifts them, and gives them the key of a
   Hilbert curve with BITS bits a dimension. The keys of a bounded sample cut each curve into RANGES ranges of about equal size.
3. A query meets all classes in its own range and at most `reach` ranges away, on each curve. Ranges and the queries that meet
   them are dealt into tiles of at most about TILE classes and QUERIES queries; a tile is scored in double precision and keeps
   the best K + 1 of each query, whose scores are then made pair by pair, the same way in every tile. The curves' finds merge per
   query: a pair that several curves found counts once.

The number of curves and their reach are fitted together on the sample (SAMPLE vectors, PROBES queries): the pair that scores the
least share of all pairs, summed over the curves (each also costs CURVE, for sending the vectors), while GOAL of the sample's
true neighbours are found. Every vector is indexed. In data without any structure (all directions alike, as in the test tables)
no ordering finds high-dimensional neighbours in a small share: that share is then large; on clustered vectors it is small.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
with fewer than K candidates all are returned; scores are compared as they are, and equal ones go to the smaller vec_id; an empty
table gives no rows; repeated rows, and ids repeated with other vectors, are vectors of their own, but no query finds its own
id; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

K = 5
#: Numbers of curves that are tried, and the share of all pairs that sending the vectors of one more counts as.
CURVES, CURVE = (2, 4, 8, 12, 16, 24), 0.01
DIMENSIONS, BITS, RANGES = 7, 6, 128
TILE, QUERIES = 8192, 8192
SAMPLE, PROBES, GOAL, SEED = 4096, 256, 0.94, 5


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys (uint64) of integer cells (n x d, below 2**bits); d * bits is 63 at most.

    The cells are turned, from the highest bit down, into the frame of the sub-cube that the curve is in, and Gray-coded."""
    x = np.ascontiguousarray(cells.T.astype(np.int64))
    d = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for i in range(d):
            flip = (x[i] & high) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[i] >> b) & 1).astype(np.uint64)
    return key


class Curves:
    """The projections and shifts of all curves for vectors of one length."""

    def __init__(self, length: int, curves: int = CURVES[-1]):
        rng = np.random.default_rng(SEED)
        d = min(DIMENSIONS, length)
        self.frames = [np.linalg.qr(rng.standard_normal((length, d)))[0] for _ in range(curves)]
        self.shifts = rng.uniform(-0.5, 0.5, (curves, d))
        self.scale = np.sqrt(length)

    def keys(self, unit: np.ndarray, curves: int | None = None) -> list[np.ndarray]:
        out = []
        for frame, shift in zip(self.frames[:curves], self.shifts[:curves], strict=True):
            y = unit @ frame * self.scale + shift
            out.append(hilbert(np.clip((y + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS).view(np.int64))
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / norms(vectors)[:, None]


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with that of b; bits depend on the two rows only."""
    return (a * b).sum(axis=1) / (norms(a) * norms(b))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component to between 1/2 and 1."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None]) + vectors.dtype.type(0)


class Plan:
    """What the sample (unit vectors) decides: how many curves, the bounds of their ranges, and a window's reach in ranges."""

    def __init__(self, sample: np.ndarray):
        self.curves, n = Curves(sample.shape[1]), len(sample)
        keys = self.curves.keys(sample)
        ranges = min(RANGES, max(1, n // 8))
        cuts = np.linspace(0, n, ranges + 1)[1:-1].astype(np.int64)
        self.bounds = [np.unique(np.sort(k)[cuts]) for k in keys]
        self.n_curves, self.reach, self.share = CURVES[0], ranges, 1.0
        if n <= 4 * K:
            return
        probes = np.random.default_rng(SEED).permutation(n)[:PROBES]
        scores = sample[probes] @ sample.T
        scores[np.arange(len(probes)), probes] = -9
        true = np.argpartition(-scores, K, axis=1)[:, :K]
        place = [np.searchsorted(b, k, side="right") for b, k in zip(self.bounds, keys, strict=True)]
        away = np.stack([np.abs(p[true] - p[probes][:, None]) for p in place])
        # the share of all pairs that a reach meets, by curve
        met = np.stack([np.cumsum(np.bincount(np.abs(p - p[probes][:, None]).ravel(), minlength=ranges)) for p in place]) / (n * len(probes))
        least = np.inf
        for c in CURVES:
            reach = int(np.sort(away[:c].min(axis=0), axis=None)[int(np.ceil(GOAL * true.size)) - 1])
            share = float(met[:c, reach].sum())
            if share + CURVE * c < least:
                least, self.n_curves, self.reach, self.share = share + CURVE * c, c, reach, share

    def ranges(self, unit_vectors: np.ndarray) -> list[np.ndarray]:
        """The range of each vector on each curve of the plan."""
        return [np.searchsorted(b, k, side="right") for b, k in zip(self.bounds, self.curves.keys(unit_vectors, self.n_curves), strict=False)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, asks of the vectors that take part."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("embedding") == lengths[0]["n"]) if lengths else rows


def matrix(column, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(n, -1).astype(np.float64)


def tile_scores(asked: np.ndarray, points: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of the k best points of each query, ties to the smaller `least`; places count in the tile."""
    of_points, out = points / norms(points)[:, None], []
    for at in range(0, len(asked), 256):
        some = asked[at : at + 256]
        rough = some / norms(some)[:, None] @ of_points.T
        # a product of matrices rounds by the place in it: all near the k-th are scored again, pair by pair
        kth = np.partition(rough, -k, axis=1)[:, -k] if len(points) > k else np.full(len(some), -np.inf)
        q, p = np.nonzero(rough >= kth[:, None] - 1e-9)
        score = np.concatenate([cosines(some[q[i : i + 50_000]], points[p[i : i + 50_000]]) for i in range(0, len(q), 50_000)])
        order = np.lexsort((least[p], -score, q))
        q, p, score = q[order], p[order], score[order]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < k
        out.append((q[kept] + at, p[kept], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of the rows for which is_query (a column) holds, against all rows."""
    spark = vectors.sparkSession
    # vectors travel in their own precision; scores are made in double
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = "<f4" if single else "<f8"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = [x.tobytes() for x in scaled(b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(kind))]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("asks"), pa.array([xxhash.xxh3_128_digest(x) for x in v], pa.binary()), pa.array(v, pa.binary())], ["vec_id", "asks", "class", "v"])

    rows = cut(usable(own).mapInArrow(named, "vec_id long, asks boolean, class binary, v binary"))
    classes = rows.groupBy("class").agg(F.min("vec_id").alias("least"), F.bool_or("asks").alias("asks"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    total = classes.count()
    # a hash lets about twice as many classes through as are wanted; only those are ordered and cut
    drawn = F.xxhash64("class", F.lit(SEED))
    some = classes.filter(F.pmod(drawn, F.lit(1 << 30)) < int(min(1.0, 2 * SAMPLE / max(total, 1)) * (1 << 30)))
    sample = [bytes(r["v"]) for r in some.orderBy(drawn, "class").limit(SAMPLE).select("v").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan = Plan(unit(matrix(sample, len(sample), kind)))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.stack(plan.ranges(unit(matrix(b.column("v").to_pylist(), b.num_rows, kind))), axis=1).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * at.shape[1]), pa.array(at.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("least"), b.column("asks"), b.column("v"), places], ["node", "least", "asks", "v", "ranges"])

    placed = cut(classes.select("node", "least", "asks", "v").mapInArrow(ranged, "node long, least long, asks boolean, v binary, ranges array<int>"))
    on = placed.select("node", "least", "asks", "v", F.posexplode("ranges").alias("curve", "range"))
    # ranges by curve are as many as the parameters say; what meets in each decides how it is cut into tiles
    met = F.explode(F.sequence(F.greatest(F.col("range") - plan.reach, F.lit(0)), F.least(F.col("range") + plan.reach, F.lit(RANGES))))
    n = on.groupBy("curve", "range").agg(F.count("*").alias("n"))
    asking = on.filter("asks").select("curve", met.alias("range")).groupBy("curve", "range").agg(F.count("*").alias("asking"))
    cells = n.join(asking, ["curve", "range"]).select("curve", "range", F.ceil(F.col("n") / TILE).cast("int").alias("parts"), F.ceil(F.col("asking") / QUERIES).cast("int").alias("slices"))
    cells = F.broadcast(cut(cells.coalesce(1)))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one_of = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c)).cast("int")
    points = on.join(cells, ["curve", "range"]).select("curve", "range", one_of("parts", 7).alias("part"), all_of("slices").alias("slice"), F.lit(False).alias("query"), "node", "least", "v")
    asked = on.filter("asks").withColumn("range", met).join(cells, ["curve", "range"]).select("curve", "range", all_of("parts").alias("part"), one_of("slices", 9).alias("slice"), F.lit(True).alias("query"), "node", "least", "v")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        q, p = pdf[pdf["query"]], pdf[~pdf["query"]]
        if q.empty or p.empty:
            return pd.DataFrame({"asker": [], "node": [], "least": [], "score": []}).astype({"asker": "int64", "node": "int64", "least": "int64"})
        least = p["least"].to_numpy()
        i, j, s = tile_scores(matrix(q["v"], len(q), kind), matrix(p["v"], len(p), kind), least, k + 1)
        return pd.DataFrame({"asker": q["node"].to_numpy()[i], "node": p["node"].to_numpy()[j], "least": least[j], "score": s})

    found = points.unionByName(asked).groupBy("curve", "range", "part", "slice").applyInPandas(score, "asker long, node long, least long, score double")
    found = found.groupBy("asker", "node").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    best = F.desc("score")
    # one of the k + 1 classes may hold nothing but the query itself
    near = W.partitionBy("asker").orderBy(best, "least", "node")
    found = cut(found.withColumn("i", F.row_number().over(near)).filter(F.col("i") <= k + 1).drop("i", "least"))
    # the smallest members of the found classes, for every query of the asking class
    names = classes.select("class", "node")
    wanted = names.join(found.select("node").distinct(), "node", "left_semi")
    members = rows.select("vec_id", "class").join(wanted, "class").withColumn("i", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).filter(F.col("i") <= k + 1)
    candidates = found.join(members.select("node", "vec_id"), "node").select("asker", "vec_id", "score")
    first = W.partitionBy("asker").orderBy(best, "vec_id")
    candidates = candidates.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= k + 1).drop("i")
    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "class").join(names, "class").select("query_id", F.col("node").alias("asker"))
    pairs = queries.join(candidates, "asker").filter("query_id <> vec_id")
    order = W.partitionBy("query_id").orderBy(best, "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
