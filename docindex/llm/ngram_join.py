"""N-gram Jaccard join by a count-vector R-tree: tokens are hashed into groups, group counts are indexed as points, overlap is
bounded by summed coordinate minima, and surviving pairs are verified.

A document's set holds the distinct 5-word shingles of its A-Z lower-cased words (fewer words: all of them as one). Two
documents link when 9 * overlap >= 4 * (size + size), that is Jaccard >= 0.8.

1. Documents with equal sets form a class; only classes go on, so copies cost nothing further.
2. An R-tree over all count vectors cannot be dealt out exactly by itself: a ball around a point meets most tiles of so many
   dimensions. So the same hash groups also deal the points out. The sets of a linked pair differ in at most
   (size + size) / 9 shingles, each inside one group; a class has more groups than that, so the pair agrees on whole groups,
   and, by the prefix argument, on one among the first (difference + 1) in any order that both share. That order puts group
   contents that many documents share last, so common passages don't gather unlike documents. (The contents counted as common
   are the most frequent ones over all documents, HEAVY at most; any choice gives the same links.)
3. Classes that agree on a group's content meet in the cell of the least of them; of common contents the cell is known
   beforehand, so that no task gathers what many documents share. A cell is one R-tree, or several blocks with every two of
   them compared if it has more than BLOCK_CLASSES classes or BLOCK_SHINGLES shingles.
4. Packed R-tree nodes and then points are dropped when the sum of coordinate minima stays under the overlap needed. Only count
   vectors travel for that. Of the classes that have a near one left, texts are fetched and the surviving pairs verified on
   whole sets, unless earlier links already connect them. Links that come out span the components of all links.

For sizes of 64 and more, a class has too few groups for step 2 with a chance under 1e-9 (groups are at least 0.45 times the
size); smaller sizes use single shingles, where it cannot happen. Shingles are told apart by 64-bit hashes inside a pair of
documents, and sets and rows by 128 bits over the whole table.

Defined results: null, empty and blank texts have empty sets, size 0, and are components of their own; repeated rows are one
component, of which one row is kept; equal doc_ids of different texts are documents of their own; null ids count as largest; a
very long text is one set (hashed in slices); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hashed_words, mixed, own_columns, packed_text, release, rolling, unpacked, unused
from .components import components

SHINGLE = 5
#: Group contents that are ordered last, and the documents of a batch that have to share one for it to be counted.
HEAVY, SHARED_BY = 20_000, 4
BATCH_WORDS = 1_000_000
#: Sizes below this use single shingles as groups.
SINGLE = 64
#: Classes and shingles of a block.
BLOCK_CLASSES, BLOCK_SHINGLES = 2000, 1_500_000
#: Tasks that the rows of a cell of several blocks are dealt to.
SALTS, SEED = 64, 23
#: Dimensions of the count vectors, and children of an R-tree node.
DIMENSIONS, FANOUT = 128, 16


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text of a column."""
    for _, words, firsts in hashed_words(column, lower=True):
        runs = rolling(words, SHINGLE)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            s = np.sort(runs[a : b - SHINGLE + 1]) if b - a >= SHINGLE else rolling(words[a:b], b - a) if b > a else words[a:b]
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def class_of(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of the set, as two signed integers."""
    m = mixed(s)
    sums = np.array([m.sum(dtype=np.uint64), mixed(m + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)])
    return tuple(mixed(sums + np.uint64(len(s) * 0x9FB21C651E98DF25 & (1 << 64) - 1)).view(np.int64).tolist())


def level(n: int) -> int:
    """Bits of the groups' number for sets of n; 64 stands for single shingles."""
    return 64 if n < SINGLE else max(1, int(np.ceil(np.log2(0.45 * n))))


def most_different(n: int, role: int) -> int:
    """How much a set of n and its partner differ at most, if n is the smaller (the partner up to 5/4) or the larger one."""
    return (n + n * 5 // 4) // 9 if role == 0 else 2 * n // 9


def group_contents(s: np.ndarray, bits: int) -> np.ndarray:
    """A hash of the content of each of the 2**bits groups that has any shingle."""
    if bits == 64:
        return mixed(s + np.uint64(64))
    group = s >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return mixed(np.add.reduceat(mixed(s), starts) + mixed(group[starts] + np.uint64(bits << 40)))


def levels(n: int) -> list[tuple[int, int]]:
    """(bits, groups to send) of a set of n: as the smaller of a pair, and as the larger where that is another level."""
    if n < 4:  # sets this small link only when equal
        return []
    own, below = level(n), level(-(-4 * n // 5))
    return [(own, most_different(n, 0) + 1)] + ([(below, most_different(n, 1) + 1)] if below != own else [])


def counts_of(s: np.ndarray) -> np.ndarray:
    return np.bincount((s & np.uint64(DIMENSIONS - 1)).astype(np.int64), minlength=DIMENSIONS)


def packed_counts(s: np.ndarray) -> bytes:
    """A count vector in bytes, one a dimension where that is enough, else four."""
    c = counts_of(s)
    return c.astype(np.uint8 if c.max() < 256 else "<u4").tobytes()


def unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == DIMENSIONS else "<u4").astype(np.int32)


FIRST = "kind int, key long, key2 long, class long, class2 long, n long, doc_id long, counts binary"


def sets_and_heavy(docs: DataFrame) -> DataFrame:
    """kind 0, a row of docs: its key (128 bits), class (128 bits), size n, doc_id and count vector; kind 1: key = a group content,
    class = half the name of the least class that has it, n = documents of a batch that share it."""
    fields = ["kind", "key", "key2", "class", "class2", "n", "doc_id", "counts"]

    def heavy(pending: list[np.ndarray], classes: list[int]) -> pa.RecordBatch:
        contents, owners = np.concatenate(pending), np.repeat(np.array(classes, np.int64), [len(p) for p in pending])
        order = np.argsort(contents)
        contents = contents[order]
        at = np.flatnonzero(np.concatenate([[True], contents[1:] != contents[:-1]]))
        n, least = np.diff(np.append(at, len(contents))), np.minimum.reduceat(owners[order], at)
        at, n, least = at[n >= SHARED_BY], n[n >= SHARED_BY], least[n >= SHARED_BY]
        none = pa.nulls(len(at), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(contents[at].view(np.int64)), none, pa.array(least), none, pa.array(n), none, pa.nulls(len(at), pa.binary())], fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, owners, words_in, met = [], [], 0, set()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                classes, sizes, counts = [], [], []
                for s in shingle_sets(part.column("text")):
                    c = class_of(s)
                    classes.append(c)
                    sizes.append(len(s))
                    counts.append(packed_counts(s) if len(s) > 3 else None)
                    words_in += len(s)
                    if c not in met:
                        met.add(c)
                        for bits, _ in levels(len(s)):
                            pending.append(group_contents(s, bits))
                            owners.append(c[0])
                named = np.array(classes, np.int64).reshape(-1, 2)
                own = [pa.array(np.zeros(part.num_rows, np.int32)), part.column("key"), part.column("key2"), pa.array(named[:, 0]), pa.array(named[:, 1]), pa.array(sizes, pa.int64()), part.column("doc_id"), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(own, fields)
                if words_in >= BATCH_WORDS and pending:
                    yield heavy(pending, owners)
                    pending, owners, words_in, met = [], [], 0, set()
        if pending:
            yield heavy(pending, owners)

    return docs.mapInArrow(work, FIRST)


def signatures(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """key, class, cell: the group contents by which a class (half of its name is enough here) meets others, each once a batch. Of
    common contents the cell is told, and the key is one of the row's own."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def chosen(s: np.ndarray, c: int, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for bits, n in levels(len(s)):
            g = group_contents(s, bits)
            at = np.minimum(np.searchsorted(common["sig"], g), max(len(common) - 1, 0)) if len(common) else None
            weight = np.where(common["sig"][at] == g, common["n"][at], 0) if len(common) else np.zeros(len(g), np.int64)
            first = np.lexsort((g, weight))[:n]
            g, known = g[first], weight[first] > 0
            cell = common["cell"][at[first]] if len(common) else np.zeros(len(g), np.int64)
            yield np.where(known, mixed(g + np.uint64(c & (1 << 64) - 1)), g), cell, known

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found, classes = [], []
                for s in shingle_sets(b.column("text").slice(at, 256)):
                    if len(s) < 4 or (c := class_of(s)) in met:
                        continue
                    met.add(c)
                    if len(met) > 500_000:
                        met.clear()
                    for part in chosen(s, c[0], sent.value):
                        found.append(part)
                        classes.append(np.full(len(part[0]), c[0], np.int64))
                if found:
                    key, cell, known = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate(classes)), pa.array(cell, pa.int64(), mask=~known)], ["key", "class", "cell"])

    return docs.mapInArrow(work, "key long, class long, cell long")


class RTree:
    """A packed R-tree over count vectors: points in the order of recursive halving along the widest dimension, FANOUT to a leaf,
    FANOUT leaves to a node. A node keeps the upper corner of its points and their least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._packed(points, np.arange(len(points)))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.leaves = self._corners(self.points, self.sizes)
        self.nodes = self._corners(*self.leaves)

    @staticmethod
    def _packed(points: np.ndarray, which: np.ndarray) -> np.ndarray:
        if len(which) <= FANOUT:
            return which
        own = points[which]
        widest = int((own.max(axis=0) - own.min(axis=0)).argmax())
        half = -(-len(which) // (2 * FANOUT)) * FANOUT
        parted = which[np.argpartition(own[:, widest], min(half, len(which) - 1), kind="introselect")]
        return np.concatenate([RTree._packed(points, parted[:half]), RTree._packed(points, parted[half:])])

    @staticmethod
    def _corners(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(points), FANOUT)
        return np.maximum.reduceat(points, at), np.minimum.reduceat(sizes, at)

    def within(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points whose bound on the overlap with this one allows a link."""
        which = np.arange(len(self.nodes[0]))
        for (corners, least), last in ((self.nodes, False), (self.leaves, False), ((self.points, self.sizes), True)):
            which = which[which < len(corners)]
            bound = np.minimum(corners[which], point).sum(axis=1, dtype=np.int64)
            which = which[9 * bound >= 4 * (size + np.maximum(least[which], -(-4 * size // 5)))]
            if not last:
                which = (which[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return self.order[which]


def pairs_near(tree: RTree, points: np.ndarray, sizes: np.ndarray, side: np.ndarray, two: bool, i: int) -> np.ndarray:
    """Points before i that may link with it, those of the largest bound first."""
    near = tree.within(points[i], int(sizes[i]))
    near = near[(near < i) & (5 * sizes[near] >= 4 * sizes[i]) & (4 * sizes[near] <= 5 * sizes[i])]
    if two:
        near = near[side[near] != side[i]]
    return near[np.lexsort((near, -np.minimum(points[near], points[i]).sum(axis=1)))] if len(near) > 1 else near


def links(names: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of all links between the sets (of different sides, if there are two)."""
    sizes = np.array([len(s) for s in sets])
    points = np.stack([counts_of(s) for s in sets]).astype(np.int32)
    tree, two = RTree(points, sizes), len(np.unique(side)) > 1
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for i in range(len(sets)):
        near = pairs_near(tree, points, sizes, side, two, i)
        while len(near):
            mine = root(i)
            near = near[[root(j) != mine for j in near.tolist()]]
            some, near = near[:64], near[64:]
            if not len(some):
                break
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            joined = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
            overlap = np.add.reduceat((sets[i][at] == joined).astype(np.int64), starts)
            for j in some[9 * overlap >= 4 * (sizes[some] + sizes[i])].tolist():
                if root(j) != root(i):
                    parent[root(j)] = root(i)
                    found.append((int(names[i]), int(names[j])))
    return found


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal (cell, i, j) from batches that are sorted by it."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        first = tuple(keys[:, 0])
        if rest and tuple(rest[0].column(c)[0].as_py() for c in ("cell", "i", "j")) != first:
            yield pa.Table.from_batches(rest)
            rest = []
        start = 0
        for end in cuts.tolist():
            yield pa.Table.from_batches([*rest, b.slice(start, end - start)])
            rest, start = [], end
        rest.append(b.slice(start))
    if rest:
        yield pa.Table.from_batches(rest)


def by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")


def sides(t: pa.Table) -> np.ndarray:
    """All one where a block is compared with itself."""
    return np.zeros(t.num_rows, np.int64) if t.column("i")[0] == t.column("j")[0] else t.column("block").to_numpy().astype(np.int64)


def with_near(rows: DataFrame) -> DataFrame:
    """rows (cell, node, block, i, j, n, counts) that have a near one in their block, by the bound alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches):
            if t.num_rows < 2:
                continue
            points = np.stack([unpacked_counts(c.as_py()) for c in t.column("counts")])
            sizes, side = t.column("n").to_numpy(), sides(t)
            if t.num_rows == 2:
                ok = 9 * int(np.minimum(points[0], points[1]).sum()) >= 4 * int(sizes.sum()) and 5 * sizes.min() >= 4 * sizes.max()
                hit = np.full(2, ok and (side[0] != side[1] or t.column("i")[0] == t.column("j")[0]))
            else:
                tree, two, hit = RTree(points, sizes), len(np.unique(side)) > 1, np.zeros(t.num_rows, bool)
                if two or t.column("i")[0] == t.column("j")[0]:
                    for i in range(t.num_rows):
                        near = pairs_near(tree, points, sizes, side, two, i)
                        hit[near] = True
                        hit[i] |= len(near) > 0
            if hit.any():
                yield from t.select(["cell", "node", "block", "i", "j"]).filter(pa.array(hit)).to_batches()

    return by_block(rows).mapInArrow(work, "cell long, node long, block int, i int, j int")


def verified(rows: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of each block; rows: cell, node, block, i, j, packed text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches):
            if t.num_rows < 2:
                continue
            found = links(t.column("node").to_numpy(), list(shingle_sets(pa.array(unpacked(t.column("packed")), pa.large_binary()))), sides(t))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return by_block(rows).mapInArrow(work, "a long, b long")


def keys(docs: DataFrame) -> list:
    """Two hashes of a row's id and text, that name it with 128 bits."""
    own = F.col("doc_id").cast("long")
    return [F.xxhash64(own, F.col("text").cast("binary")), F.xxhash64(F.lit(SEED), own, F.col("text").cast("binary"))]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the row's keys, and the text as bytes."""
    key, key2 = keys(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), key2.alias("key2"), F.col("text").cast("binary").alias("text"))


def most_common(contents: DataFrame) -> DataFrame:
    """The contents whose count n has at least as many bits as HEAVY of them at most have: found by counts per number of bits, so
    that no task or driver sees more."""
    bits = F.length(F.bin("n"))
    left, least = HEAVY, 64
    for r in contents.groupBy(bits.alias("bits")).count().orderBy(F.desc("bits")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["bits"]
    return contents.filter(bits >= least)


def in_blocks(cells: DataFrame) -> DataFrame:
    """cells (cell, node, n, counts) of two classes and more, with block, i, j: once for every two blocks of the cell that meet in it.

    A cell of several blocks is joined by (cell, salt), so that no task has all its rows."""
    size = cells.groupBy("cell").agg(F.count("*").alias("m"), F.sum("n").alias("words")).filter("m > 1")
    size = cut(size.select("cell", F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("words") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    zero = F.lit(0)
    out = cells.join(size.filter("blocks = 1").select("cell"), "cell").select("cell", "node", zero.alias("block"), zero.alias("i"), zero.alias("j"), "n", "counts")
    large = size.filter("blocks > 1")
    if large.isEmpty():
        return out
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = cells.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SALTS)).cast("int")).join(salted, ["cell", "salt"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    return out.unionByName(rows.select("cell", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "n", "counts"))


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, key, key2, n_shingles, component_id, kept (the one row that stands for its component) of every row."""
    rows = keyed(docs)
    first = cut(sets_and_heavy(rows).withColumn("row_no", F.monotonically_increasing_id()))
    sets = first.filter("kind = 0").select("row_no", "key", "key2", "class", "class2", "n", "doc_id")
    common = most_common(first.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n"), F.min("class").alias("cell"))).collect()
    heavy = np.array([(r["key"] & (1 << 64) - 1, r["n"], r["cell"]) for r in common], dtype=[("sig", np.uint64), ("n", np.int64), ("cell", np.int64)])
    heavy.sort(order="sig")

    # keys are summed up where they are met, and those that several classes have come back by a join: no task gathers a key's rows
    name = ["class", "class2"]
    met = cut(signatures(rows.select("text"), heavy))
    own = met.filter("cell is null").select("key", "class")
    shared = own.groupBy("key").agg(F.min("class").alias("cell"), F.max("class").alias("most")).filter("cell <> most").select("key", "cell")
    cells = met.filter("cell is not null").select("cell", "class").unionByName(own.join(shared, "key").select("cell", "class")).distinct()

    # one row of each class stands for it, and its number names the class from here on
    classes = first.filter("kind = 0 and n > 3").groupBy(*name).agg(F.min(F.struct("row_no", "key", "key2", "n", "counts")).alias("r")).select(*name, F.col("r.row_no").alias("node"), "r.key", "r.key2", "r.n", "r.counts")
    cells = cut(cells.join(classes, "class").select("cell", "node", "n", "counts", "key", "key2"))
    release(met)
    near = cut(with_near(in_blocks(cells)))
    named = cells.join(near.select("node").distinct(), "node").select("node", "key", "key2").distinct()
    # the texts are shuffled once, whatever the number of rows that are wanted: the plan is the same at every size
    texts = packed_text(rows, ["key", "key2"]).join(named.hint("merge"), ["key", "key2"]).dropDuplicates(["node"])
    found = verified(near.join(texts.select("node", "packed"), "node"))

    tree = components(found)
    some, none = sets.filter("n > 0"), sets.filter("n = 0")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_no")
    best = some.groupBy(*name).agg(F.min(order).alias("best"), F.min("row_no").alias("node"))
    best = best.join(tree, "node", "left").select(*name, F.coalesce("root", "node").alias("root"), "best")
    roots = best.groupBy("root").agg(F.min("best").alias("top"))
    top = best.join(roots, "root").select(*name, "top")
    out = some.join(top, name).select("doc_id", "key", "key2", F.col("n").alias("n_shingles"), F.col("top.doc_id").alias("component_id"), (F.col("top.row_no") == F.col("row_no")).alias("kept"))
    return out.unionByName(none.select("doc_id", "key", "key2", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with its own columns: the one with the smallest doc_id; of rows with its id and text,
    one. A document without words is a component of its own, once for rows of one id and text.

    The keys of the rows that go are few beside the texts, and a table of their own: its size tells Spark whether to send it to
    the texts or to shuffle both."""
    k, k2, kept, n, own, own2 = unused(docs, "_k", "_k2", "_kept", "_n", "_own", "_own2")
    same = linked(docs).groupBy(F.col("key").alias(k), F.col("key2").alias(k2)).agg(F.bool_or("kept").alias(kept), F.count("*").alias(n))
    gone = cut(same.filter(~F.col(kept) | (F.col(n) > 1)))
    key, key2 = keys(docs)
    rows = docs.withColumn(own, key).withColumn(own2, key2)
    on = (F.col(own) == F.col(k)) & (F.col(own2) == F.col(k2))
    once = rows.join(gone, on, "left_anti").select(own_columns(docs))
    twins = gone.filter(kept)
    if twins.isEmpty():
        return once
    plain = [c for c, f in zip(own_columns(docs), docs.schema, strict=True) if not f.dataType.typeName().startswith(("map", "variant", "array", "struct"))]
    again = rows.join(twins, on).groupBy(k, k2).agg(F.max_by(F.struct(*own_columns(docs)), F.xxhash64(*plain)).alias("r")).select("r.*")
    return once.unionByName(again)
