"""Batched model inference with any encoder or scorer.

An encoder is a picklable factory: called once per worker process, which keeps what it made for the tasks that follow, it gives a function from a list of texts to a list of (dense, sparse)
with dense a list of floats and sparse a dict from token id to weight. The encoder here hashes words; it stands where a model
would, and gives the same vectors on every run."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.scalars import caption_text
from .upserts import replace_by_key

BATCH = 8
#: Models that a worker keeps.
MODELS = 2
#: Candidates that a reranker takes in one request.
CANDIDATES = 128
VECTORS = "dense array<float>, sparse struct<indices:array<int>,values:array<float>>"
Encoder = Callable[[list[str]], list[tuple[list[float], dict[int, float]]]]


def hash_encoder(dim: int = 64, excluded: tuple[int, ...] = ()) -> Callable[[], Encoder]:
    """Words hashed into dim signed coordinates; their hashed ids with 1 + log(count) as sparse weights."""

    def make() -> Encoder:
        def encode(texts: list[str]) -> list[tuple[list[float], dict[int, float]]]:
            out = []
            for text in texts:
                counts: dict[int, int] = {}
                for w in re.findall(r"\w+", text.lower()):
                    h = zlib.crc32(w.encode())
                    counts[h] = counts.get(h, 0) + 1
                dense = [0.0] * dim
                for h, n in counts.items():
                    dense[h % dim] += n if h >> 16 & 1 else -n
                length = math.sqrt(sum(x * x for x in dense)) or 1.0
                out.append(([x / length for x in dense], sparse_weights([(h & 0x7FFFFFFF, 1 + math.log(n)) for h, n in counts.items()], excluded)))
            return out

        return encode

    return make


def sparse_weights(tokens: list[tuple[int, float]], excluded: tuple[int, ...] = ()) -> dict[int, float]:
    out: dict[int, float] = {}
    for t, w in tokens:
        if w > 0 and t not in excluded:
            out[t] = max(w, out.get(t, 0.0))
    return out


_models: dict[str, Callable] = {}


def named_model(factory: Callable[[], Callable]) -> tuple[str, Callable]:
    """factory with a name for what it makes, by its own bytes: the same in all tasks of a plan."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest(), factory


def model(named: tuple[str, Callable]) -> Callable:
    """What a factory makes, made once in a worker process; the one that wasn't used for longest goes if there are more than MODELS."""
    name, factory = named
    made = _models.pop(name, None) or factory()
    _models[name] = made
    while len(_models) > MODELS:
        del _models[next(iter(_models))]
    return made


def by_length(texts: list[str], encode: Encoder, batch: int) -> list:
    """What encode gives for each text, asked in batches of texts of about one length, so that short ones aren't padded to long ones."""
    out: list = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        for i, made in zip(some, encode([texts[i] for i in some]), strict=True):
            out[i] = made
    return out


def embed(df: DataFrame, encoder: Callable[[], Encoder], batch: int = BATCH, profile: ResourceProfile | None = None) -> DataFrame:
    """Df (text, ...) with dense and sparse. Give it one row a chunk, spread evenly: one long file is many rows. profile: what the
    stage's executors have to offer, such as GPUs."""
    named = named_model(encoder)
    schema = df.withColumn("dense", F.lit(None).cast("array<float>")).withColumn("sparse", F.lit(None).cast("struct<indices:array<int>,values:array<float>>")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields, encode = to_arrow_schema(schema), model(named)
        for b in batches:
            for at in range(0, b.num_rows, batch * 64):
                part = b.slice(at, batch * 64)
                texts = [t or "" for t in part.column("text").to_pylist()]
                made = by_length(texts, encode, batch)
                sparse = [{"indices": sorted(s), "values": [s[i] for i in sorted(s)]} for _, s in made]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([d for d, _ in made], fields.field("dense").type), pa.array(sparse, fields.field("sparse").type)], schema=fields)

    return df.mapInArrow(work, schema, profile=profile)


def aggregate_sparse(tokens: DataFrame, excluded: list[int]) -> DataFrame:
    """A10: doc, indices, values: the greatest positive weight of every token that isn't excluded."""
    best = tokens.filter(~F.col("token").isin(excluded) & (F.col("weight") > 0)).groupBy("doc", "token").agg(F.max("weight").alias("weight"))
    pairs = F.sort_array(F.collect_list(F.struct("token", "weight")))
    return best.groupBy("doc").agg(pairs.alias("p")).select("doc", F.col("p.token").alias("indices"), F.col("p.weight").alias("values"))


def overlap_scorer() -> Callable[[], Callable[[list[tuple[str, str]]], list[float]]]:
    """A stand-in for a reranker: a logit that grows with the share of the query's words in the text."""

    def make():
        def score(pairs: list[tuple[str, str]]) -> list[float]:
            out = []
            for query, text in pairs:
                q, t = set(query.lower().split()), set(text.lower().split())
                out.append(4.0 * len(q & t) / len(q) - 2.0 if q else -2.0)
            return out

        return score

    return make


def score_pairs(pairs: DataFrame, scorer: Callable, query: str = "query_text", text: str = "text", profile: ResourceProfile | None = None) -> DataFrame:
    """pairs with `rerank_score`: the sigmoid of the scorer's logit, asked in requests of CANDIDATES pairs at most."""
    named = named_model(scorer)
    schema = pairs.withColumn("rerank_score", F.lit(0.0)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model(named)
        for b in batches:
            both = [(q or "", t or "") for q, t in zip(b.column(query).to_pylist(), b.column(text).to_pylist(), strict=True)]
            logits = [x for at in range(0, len(both), CANDIDATES) for x in score(both[at : at + CANDIDATES])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([1 / (1 + math.exp(-x)) for x in logits], pa.float64())], [*b.schema.names, "rerank_score"])

    return pairs.mapInArrow(work, schema, profile=profile)


def rerank(pairs: DataFrame, scorer: Callable, top_k: int | None = None, request: Column | None = None) -> DataFrame:
    """Pairs (query_id, candidate_id, query_text, text) by falling score; ties to the smaller candidate. More than
    CANDIDATES of one request are an error, raised where they are met. A query is one request, or as many as `request` numbers:
    all its candidates are scored, and as each request's top_k hold the query's, merging these is exact."""
    best = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("rerank_score"), "candidate_id"))
    # dealt by both columns, as a join's layout by the query alone would keep a long query's requests in one task
    rows = pairs if request is None else pairs.withColumn("_request", request).repartition("query_id", "_request")
    keys = ["query_id"] if request is None else ["query_id", "_request"]
    n = F.count("*").over(W.partitionBy(*keys))
    checked = rows.withColumn("_n", F.when(n <= CANDIDATES, n).otherwise(F.raise_error(F.lit(f"more than {CANDIDATES} candidates of a request")).cast("long"))).filter("_n > 0").drop("_n")
    out = score_pairs(checked, scorer)
    if request is not None:
        out = (out.withColumn("_of_request", best(*keys)).filter(F.col("_of_request") <= top_k).drop("_of_request") if top_k else out).drop("_request")
    out = out.withColumn("rank", best("query_id"))
    return out.filter(F.col("rank") <= top_k) if top_k else out


def ingest_captions(old: DataFrame, assets: DataFrame, encoder: Callable[[], Encoder], now_ms: int) -> DataFrame:
    """The chunk table with one caption point an asset (source, asset_id, caption, meta, mtime_ms), replaced by file."""
    rows = assets.select(
        ids.asset_file_id(F.col("source"), F.col("asset_id")).alias("file_id"), F.array("source").alias("root_ids"), F.lit("caption").alias("kind"), F.lit("en").alias("lang"),
        F.lit(0).alias("chunk_no"), caption_text(F.col("caption"), F.col("meta")).alias("text"), "mtime_ms", F.lit(now_ms).cast("long").alias("indexed_at"), F.lit(None).cast("long").alias("tombstoned_at"),
    )
    return replace_by_key(old, embed(rows.withColumn("point_id", ids.caption_id(F.col("file_id"))), encoder), ["file_id"])

