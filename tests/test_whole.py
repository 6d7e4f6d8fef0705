"""Queries over tables that have more than a bound of the operator's: nothing may be left out."""

from pyspark.sql import functions as F

from tests_support import DATA, oracle, rows, table
from docindex.plans import queries
from docindex.plans.queries import ORACLES, QUERIES

SMALL = DATA / "sf0.001"


def test_rerank_scores_every_turn(spark, tmp_path):
    best = {1: (399, 250), 2: (3,)}  # turns with all words of the query; others have one of four
    said = [(c, t, "user" if t % 2 == 0 else "assistant", "a b c d" if t == 0 or t in best[c] else f"a x{t}") for c, n in ((1, 400), (2, 8)) for t in range(n)]
    said = [(c, t, "assistant" if t in best[c] else r, x) for c, t, r, x in said]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows(QUERIES["e2_rerank"](spark, str(tmp_path)).select("query_id", "rank", "candidate_id"))
    want = []
    for c in best:
        turns = sorted((t not in best[c], t) for k, t, r, _ in said if k == c and r == "assistant")
        want += [(c, i + 1, t) for i, (_, t) in enumerate(turns[:10])]
    assert got == sorted(want, key=repr)
    assert QUERIES["e2_rerank"](spark, str(tmp_path)).filter(F.col("candidate_id") >= 128).count() == 2


def test_every_text_is_read(spark, tmp_path):
    sizes = [1000] * 300 + [64 * 1024 - 1] * 130 + [64 * 1024, 3 << 20, (4 << 20) - 1, 5 << 20]
    spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n int").selectExpr("doc_id", "repeat('é', n div 2) || repeat('x', n % 2) as text").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["s1_read_files"](spark, str(tmp_path)).collect()
    assert sorted(r["size"] for r in got if r["n_chars"] is None) == [(5 << 20) + 1]  # the reader's own limit
    assert sum(r["size"] for r in got) == sum(sizes) + len(sizes)
    assert sum(r["n_chars"] or 0 for r in got) == sum(n // 2 + n % 2 + 1 for n in sizes[:-1])
    assert len({r["name"] for r in got}) == len(got)


def test_chunks_keep_whole_texts(spark):
    for name, f in (("u1_upsert_chunks", queries.upserted_chunks), ("s6_export_captions", queries.exported_captions)):
        assert table(queries.hashed(f(spark, str(SMALL)))) == oracle(ORACLES[name], SMALL)[0]
    texts = {t for (t,) in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()}
    kept = QUERIES["e3_ingest_captions"](spark, str(SMALL)).filter("point_id like 'pt%'").collect()
    assert any(len(r["text"]) > 80 for r in kept) and all(r["text"] in texts for r in kept)


def test_queries_meet_all_groups(spark):
    for name in ("v3_score_chunks", "v4_retrieve_rerank"):
        got = QUERIES[name](spark, str(DATA / "sf0.1")).select("chunk_no").distinct().count()
        assert got == spark.read.parquet(str(DATA / "sf0.1" / "embeddings.parquet")).count()


def test_a_batch_reindexes_any_number_of_files(spark, tmp_path):
    for t in ("lineitem", "orders"):
        (tmp_path / f"{t}.parquet").symlink_to(SMALL / f"{t}.parquet")
    spark.range(1, 60_001).selectExpr("id as p_partkey", "int(id % 50 + 1) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["m10_reindex"](spark, str(tmp_path))
    want = oracle(ORACLES["m10_reindex"].replace("FROM part)", f"FROM '{tmp_path}/part.parquet/*.parquet')"), SMALL)[0]
    assert table(got) == want and len({n for k, n, _ in want if k == "skipped"}) > 10_000
