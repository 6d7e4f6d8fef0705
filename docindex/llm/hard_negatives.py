"""Hard-negative mining over an inverted multi-index: two half-space codebooks form cells; a multi-sequence heap visits the cells by
summed half-score bounds, radii included, and stops on certified windows.

1. Each component c becomes floor(256 c); scores are exact inner products of these. Both halves of the vectors get a codebook (k-means
   on a bounded sample); a cell is a pair of codes. Every row is in the cell of its nearest codes, and a code's radius is the
   largest distance of any row of it, over all rows.
2. For an anchor, |half| * radius above its product with a code bounds what any row of that code can add. Its heap walks
   the pairs of codes by the falling sum of both bounds. A goal is a window of scores [low, high] from which the k best rows are
   wanted. Once the bound of the next cell is below the k-th best row found in the window, or below the window, nothing that follows
   can enter: the goal is certified, and an anchor whose goals all are is done. Cells with nothing but scores above all windows,
   by the same bounds from below, are passed over.
3. The heap runs in waves: cells of FIRST rows, then more, then all that the certificate still leaves open. A wave deals (tile,
   slice) blocks: tiles of at most about TILE rows hold whole cells, or parts of large ones; slices hold at most about ANCHORS of
   the anchors that visit a tile. A block keeps the k best of each goal, which one window merges.
4. Positives are one goal of each anchor (any score, own label), negatives one for each of its positives (other labels).

Results are exact, whatever the data; how many cells are visited depends on them. Where all directions are alike, as in the test tables,
bounds of halves part little, and most cells are visited. The driver gets the sample, and a row for each cell: CODES ** 2 at most.

Defined results: rows with a null vec_id, label or vector, with null or non-finite components, or of another length than most
take no part, nor do those with a component so large (LIMIT / length) that products would leave 64 bits; equal scores go to the
smaller vec_id; no row of the anchor's own vec_id is its positive or negative; repeated rows are rows of their own, repeated anchors too;
an anchor without positives, or a positive without negatives, has no row; an empty table gives none; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .vectors import as_numbers, finite, packed, unpacked

POSITIVES, NEGATIVES = 5, 3
#: A negative's score, in percent of the positive's.
LOW, HIGH = 50, 95
#: Rows of the codebooks' sample and rounds of k-means; rows of a cell on average, and codes of a half at most.
SAMPLE, ROUNDS, CELL, CODES = 8192, 8, 256, 256
#: Rows of a tile, and anchors of a slice.
TILE, ANCHORS = 8192, 4096
#: Rows of the cells that an anchor visits in each wave; None: all that are left open.
FIRST = (2048, 16384, None)
#: A hundred times the inner product of any two vectors stays below this.
LIMIT = 1 << 62
SEED = 13
LEAST, MOST = -(1 << 62), 1 << 62


def codebook(points: np.ndarray, codes: int) -> np.ndarray:
    """Centres (codes x dimensions) of points by k-means."""
    rng = np.random.default_rng(SEED)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:codes]].astype(np.float64)
    for _ in range(ROUNDS if points.shape[1] else 0):
        own = nearest(points, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (points @ centres.T)).argmin(axis=1)


@dataclass
class Index:
    """The codebooks, and of each cell that has rows (code 1, code 2): rows, radii of both halves, first tile and number of tiles."""

    length: int
    centres: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray  # structured: one, two, rows, radius1, radius2, tile, parts

    def __post_init__(self):
        k2 = len(self.centres[1])
        self.at = np.full((len(self.centres[0]), k2), -1, np.int64)
        self.at[self.cells["one"], self.cells["two"]] = np.arange(len(self.cells))
        self.radii = [np.zeros(len(c)) for c in self.centres]
        np.maximum.at(self.radii[0], self.cells["one"], self.cells["radius1"])
        np.maximum.at(self.radii[1], self.cells["two"], self.cells["radius2"])

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (self.length + 1) // 2
        return x[..., :h], x[..., h:]


class Visit:
    """An anchor's walk over the cells by falling bound: next() gives (bound, cell) of cells that have rows."""

    def __init__(self, index: Index, x: np.ndarray):
        self.index = index
        halves = [h.astype(np.float64) for h in index.halves(x)]
        self.norms = [float(np.sqrt(h @ h)) for h in halves]
        self.products = [c @ h for c, h in zip(index.centres, halves, strict=True)]
        bounds = [p + n * r for p, n, r in zip(self.products, self.norms, index.radii, strict=True)]
        #: what rounding may have taken from a bound
        self.slack = 1e-6 + 1e-9 * sum(float(np.abs(p).max(initial=0)) + n * float(r.max(initial=0)) for p, n, r in zip(self.products, self.norms, index.radii, strict=True))
        self.order = [np.argsort(-b, kind="stable") for b in bounds]
        self.sorted = [b[o].tolist() for b, o in zip(bounds, self.order, strict=True)]
        self.heap = [(-(self.sorted[0][0] + self.sorted[1][0]), 0, 0)]

    def next(self) -> tuple[float, int] | None:
        a, b = self.sorted
        while self.heap:
            bound, i, j = heapq.heappop(self.heap)
            # a pair is pushed by its left neighbour, and by the one above it in the first column: each once
            if j + 1 < len(b):
                heapq.heappush(self.heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(self.heap, (-(a[i + 1] + b[0]), i + 1, 0))
            cell = int(self.index.at[self.order[0][i], self.order[1][j]])
            if cell >= 0:
                return -bound + self.slack, cell
        return None

    def least(self, cell: int) -> float:
        """No row of the cell has a score below this."""
        c = self.index.cells[cell]
        return self.products[0][c["one"]] - self.norms[0] * c["radius1"] + self.products[1][c["two"]] - self.norms[1] * c["radius2"] - self.slack


def walked(index: Index, x: np.ndarray, visited: int, low: list[int], high: list[int], worst: list[int], budget: int | None) -> tuple[int, list[int]]:
    """(cells passed so far, cells to visit now) of an anchor that has passed `visited` cells. worst: for each goal the score of its
    k-th best row so far (LEAST if it has fewer)."""
    need = min((max(a, w) for a, b, w in zip(low, high, worst, strict=True) if a <= b), default=MOST)
    most = max((b for a, b in zip(low, high, strict=True) if a <= b), default=LEAST)
    visit, out, rows = Visit(index, x), [], 0
    passed = 0
    while (found := visit.next()) is not None:
        bound, cell = found
        if bound < need or budget is not None and passed >= visited and rows >= budget:
            break
        passed += 1
        if passed > visited and visit.least(cell) <= most:
            out.append(cell)
            rows += int(index.cells["rows"][cell])
    return max(passed, visited), out


def indexed(vectors: DataFrame) -> tuple[DataFrame, Index] | None:
    """(row, vec_id, label, anchor, x, cell, tile of every usable row of vectors (vec_id, embedding, label, anchor), the index)."""
    rows, length = finite(vectors.filter("vec_id is not null and label is not null"))
    if not length:
        return None
    numbers = as_numbers(rows)
    largest = int(np.sqrt(LIMIT / (100 * length)))
    schema = numbers.schema

    def in_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpacked(b.column("x"), length)
            yield b.filter(pa.array(((x <= largest) & (x >= -largest)).all(axis=1)))

    rows = cut(numbers.mapInArrow(in_bounds, schema).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    if not n:
        return None
    # a hash lets about twice as many rows through as are wanted; only those are ordered and cut
    drawn = F.xxhash64("row", F.lit(SEED))
    some = rows.filter(F.pmod(drawn, F.lit(1 << 30)) < int(min(1.0, 2 * SAMPLE / n) * (1 << 30))).orderBy(drawn, "row").limit(SAMPLE).select("x").toArrow()
    sample = unpacked(some.column("x"), length).astype(np.float64)
    codes = min(CODES, max(1, int(np.ceil(np.sqrt(n / CELL)))))
    half = (length + 1) // 2
    centres = codebook(sample[:, :half], codes), codebook(sample[:, half:], codes)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = unpacked(part.column("x"), length).astype(np.float64)
                halves, own, far = (x[:, :half], x[:, half:]), [], []
                for h, c in zip(halves, centres, strict=True):
                    code = nearest(h, c)
                    own.append(pa.array(code.astype(np.int32)))
                    far.append(pa.array(np.sqrt(((h - c[code]) ** 2).sum(axis=1)) * (1 + 1e-12)))
                yield pa.RecordBatch.from_arrays([*part.columns, *own, *far], [*part.schema.names, "one", "two", "radius1", "radius2"])

    placed = cut(rows.mapInArrow(coded, rows.withColumns({"one": F.lit(0), "two": F.lit(0), "radius1": F.lit(0.0), "radius2": F.lit(0.0)}).schema))
    by = placed.groupBy("one", "two").agg(F.count("*").alias("rows"), F.max("radius1").alias("radius1"), F.max("radius2").alias("radius2")).collect()
    by.sort(key=lambda r: (r["one"], r["two"]))
    tile, filled, told = 0, 0, []
    size = max(1, min(TILE, (1 << 26) // (8 * length)))
    for r in by:
        parts = -(-r["rows"] // size)
        if filled and filled + r["rows"] > size:
            tile, filled = tile + 1, 0
        told.append((r["one"], r["two"], r["rows"], r["radius1"], r["radius2"], tile, parts))
        filled += r["rows"]
        if parts > 1:
            tile, filled = tile + parts, 0
    cells = np.array(told, dtype=[("one", "i4"), ("two", "i4"), ("rows", "i8"), ("radius1", "f8"), ("radius2", "f8"), ("tile", "i8"), ("parts", "i8")])
    spark = rows.sparkSession
    where = spark.createDataFrame([(int(c["one"]), int(c["two"]), i, int(c["tile"]), int(c["parts"])) for i, c in enumerate(cells)], "one int, two int, cell int, first long, parts long")
    part = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))
    points = placed.join(F.broadcast(where), ["one", "two"]).select("row", "vec_id", "label", "anchor", "x", "cell", part.alias("tile"))
    return cut(points), Index(length, centres, cells)


def best(scores: np.ndarray, fits: np.ndarray, worst: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of each row among those that fit and are no worse than its `worst`; ties to the smaller id."""
    s = np.where(fits & (scores >= worst[:, None]), scores, LEAST)
    if s.shape[1] > k:
        s[s < np.partition(s, -k, axis=1)[:, -k][:, None]] = LEAST
    i, j = np.nonzero(s > LEAST)
    order = np.lexsort((ids[j], -s[i, j], i))
    i, j = i[order], j[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of whole numbers: in doubles where these hold them."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def searched(points: DataFrame, index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """row, goal, score, vec_id: for each anchor (row, vec_id, label, x, low, high: arrays, one entry a goal) and goal, the k best
    rows with its label (same) or with others, whose score is between low and high."""
    spark, length = points.sparkSession, index.length
    sent = spark.sparkContext.broadcast(index)
    n = anchors.count()
    slices = max(1, -(-n // ANCHORS))
    goals = "array<long>"
    label = points.schema["label"].dataType.simpleString()

    def visits(budget: int | None):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    tiles, cells, who, passed = [], [], [], []
                    lists = (b.column(c).to_pylist() for c in ("visited", "low", "high", "worst"))
                    for i, (x, *state) in enumerate(zip(unpacked(b.column("x"), length), *lists, strict=True)):
                        done, found = walked(sent.value, x, *state, budget)
                        of = {}
                        for c in found:
                            own = sent.value.cells[c]
                            for t in range(int(own["tile"]), int(own["tile"] + own["parts"])):
                                of.setdefault(t, []).append(c)
                        # tile -1 tells how far the anchor is
                        tiles += [-1, *of]
                        cells += [[], *of.values()]
                        who += [i] * (1 + len(of))
                        passed += [done] * (1 + len(of))
                    taken = b.select(["row", "vec_id", "label", "x", "low", "high", "worst"]).take(pa.array(who, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(tiles, pa.int64()), pa.array(cells, pa.list_(pa.int32())), pa.array(passed, pa.int64())], [*taken.schema.names, "tile", "cells", "passed"])

        return work

    def block(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            rows = rows.sort_values("cell", kind="stable")
            ids, labels, cell = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), rows["cell"].to_numpy()
            x, a = unpacked(pa.array(rows["x"], pa.binary()), length), unpacked(pa.array(asked["x"], pa.binary()), length)
            own, labelled = asked["vec_id"].to_numpy(), asked["label"].to_numpy()
            low, high, worst = (np.stack(asked[c].to_numpy()) for c in ("low", "high", "worst"))
            present, first = np.unique(cell, return_index=True)
            wanted = np.zeros((len(asked), len(present)), bool)
            for i, c in enumerate(asked["cells"]):
                wanted[i, np.searchsorted(present, c[np.isin(c, present)])] = True
            of_row = np.repeat(np.arange(len(present)), np.diff(np.append(first, len(cell))))
            for at in range(0, len(asked), 128):
                to = slice(at, at + 128)
                met = np.flatnonzero(wanted[to].any(axis=0)[of_row])
                score = products(a[to], x[met])
                fits = wanted[to][:, of_row[met]] & ((labelled[to][:, None] == labels[met]) == same) & (own[to][:, None] != ids[met])
                for g in range(low.shape[1]):
                    inside = fits & (score >= low[to, g][:, None]) & (score <= high[to, g][:, None])
                    if inside.any():
                        i, j = best(score, inside, worst[to, g], ids[met], k)
                        out.append((asked["row"].to_numpy()[at + i], np.full(len(i), g), score[i, j], ids[met][j]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("row", "goal", "score", "vec_id"), columns, strict=True))).astype({"goal": "int32"})

    # the row's place in a list of equal scores counts too, as repeated rows are rows of their own
    order = W.partitionBy("row", "goal").orderBy(F.desc("score"), "vec_id")
    state = anchors.withColumn("visited", F.lit(0).cast("long")).withColumn("worst", F.transform("low", lambda _: F.lit(LEAST)))
    state = cut(state.select("row", "vec_id", "label", "x", "low", "high", "worst", "visited"))
    found = None
    for wave, budget in enumerate(FIRST):
        schema = f"row long, vec_id long, label {label}, x binary, low {goals}, high {goals}, worst {goals}, tile long, cells array<int>, passed long"
        wants = cut(state.mapInArrow(visits(budget), schema))
        asked = wants.filter("tile >= 0").withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
        # tiles that nobody visits aren't sent
        blocks = asked.groupBy("tile").agg(F.array_sort(F.collect_set("slice")).alias("slices"))
        rows = points.select("vec_id", "label", "x", "cell", "tile").join(blocks, "tile").withColumn("slice", F.explode("slices")).drop("slices")
        now = asked.drop("passed").groupBy("tile", "slice").cogroup(rows.groupBy("tile", "slice")).applyInPandas(block, "row long, goal int, score long, vec_id long")
        both = now if found is None else found.unionByName(now)
        found = cut(both.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k).drop("i"))
        if wave + 1 < len(FIRST):
            full = found.groupBy("row", "goal").agg(F.count("*").alias("n"), F.min("score").alias("worst")).filter(F.col("n") == k)
            full = full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("goal", "worst"))).alias("full"))
            far = wants.filter("tile = -1").select("row", "passed")
            worst = F.transform("low", lambda _, i: F.coalesce(F.element_at("full", i), F.lit(LEAST)))
            state = cut(state.join(far, "row").join(full, "row", "left").withColumn("worst", worst).withColumn("visited", F.col("passed")).select(state.columns))
    return found


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of vectors (vec_id, embedding, label)
    for which is_anchor (a column) holds."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    found = indexed(rows)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    points, index = found
    anchors = cut(points.filter("anchor").select("row", "vec_id", "label", "x"))
    near = searched(points, index, anchors.withColumns({"low": F.array(F.lit(LEAST + 1)), "high": F.array(F.lit(MOST))}), True, positives)
    near = near.withColumn("goal", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id")) - 1)
    near = cut(near.select("row", "goal", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # whole numbers between LOW and HIGH percent; none below a negative score, and for fewer positives none at all
    goals = near.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("goal", "positive_score"))).alias("of"))
    each = lambda of_score, none: F.expr(f"transform(sequence(0, {positives - 1}), g -> coalesce(case when element_at(of, g) >= 0 then {of_score.format('element_at(of, g)')} end, {none}L))")
    low, high = each(f"({{}} * {LOW} + 99) div 100", MOST), each(f"{{}} * {HIGH} div 100", LEAST)
    windows = anchors.join(goals, "row").withColumn("low", low).withColumn("high", high).drop("of")
    hard = searched(points, index, windows, False, negatives)
    rank = F.row_number().over(W.partitionBy("row", "goal").orderBy(F.desc("score"), "vec_id")).cast("int")
    hard = hard.withColumn("rank", rank).select("row", "goal", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(hard, ["row", "goal"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
