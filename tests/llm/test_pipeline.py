"""The pipeline and the registered queries against SQL and brute force on the smallest tables."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docindex.llm import language_id, queries
from docindex.llm.common import cut
from docindex.llm.queries import vocabulary

from . import brute
from .conftest import ODD, SMALL


def test_pipeline_is_its_stages_by_brute_force(spark, documents, texts):
    tokenizers = pytest.importorskip("tokenizers")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "source_mix", "byte_bpe"]
    model = language_id.learn(documents)
    left = [(d, r["text"]) for d, r in texts.items() if not model.predict(r["text"])[2]]
    left = [(d, texts[d]["text"]) for d, _, _, kept, _ in brute.dedup(left) if kept]
    left = [(d, texts[d]["text"]) for d, _, c in brute.linked(left) if d == c]
    sizes = {}
    for d, t in left:
        sizes[texts[d]["source"]] = sizes.get(texts[d]["source"], 0) + len(brute.words(t))
    want = brute.targets(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))})
    rows = corpus_pipeline.run(spark, SMALL).collect()
    lib, words = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), {}
    known = {d for d, _ in left}
    for r in rows:
        assert r["doc_id"] in known
        d = texts[r["doc_id"]]
        ids = lib.encode(d["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        words[d["source"]] = words.get(d["source"], 0) + len(brute.words(d["text"]))
    longest = max(len(brute.words(t)) for _, t in left)
    for s, target in want.items():
        assert target - 1 <= words[s] <= target + longest
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3


def test_stages_on_odd_rows(spark, odd):
    docs, kept = odd, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SMALL))
        assert docs.columns == odd.columns
        kept[name] = [r["doc_id"] for r in docs.collect()]
    assert not {3, 4, 5, 10} & set(kept["language_id"])  # no letters
    assert set(kept["exact_dedup"]) <= set(kept["language_id"]) and len(set(kept["exact_dedup"])) == len(kept["exact_dedup"])
    assert len([d for d in kept["exact_dedup"] if d in (1, 2)]) <= 1
    assert len([d for d in kept["ngram_join"] if d in (8, 9)]) <= 1 and set(kept["ngram_join"]) <= set(kept["exact_dedup"])
    assert set(kept["source_mix"]) <= set(kept["ngram_join"]) and max(Counter(kept["source_mix"]).values(), default=0) <= 3
    # the last stage: one row for each of its own, nulls, blanks and repeats too
    name, stage = corpus_pipeline.STAGES[-1]
    rows = stage(spark, odd, SMALL).collect()
    assert sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(repr(o[0]) for o in ODD)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}


#: Every name that a stage gives a helper column, and names that need quotes.
CLASHES = "_id _kept _sha _sha_own _n _k _k2 _own _own2 _size _source _times _rows _copy _rejected _score _lang_pred rejected score lang_pred i r key key2 node cell row_no digest best taken size Kept a.b c`d e`.f".split() + ["white space", "", "_ID2"]


def test_stages_keep_columns_of_any_name(spark, odd, documents):
    plain = documents.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    names = [c for c in CLASHES if c]
    more = plain.select("*", *[F.lit(n).alias(c) for n, c in enumerate(names)], F.col("text").alias("_text"))
    a, b = plain, more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        a, b = cut(stage(spark, a, SMALL)), cut(stage(spark, b, SMALL))
        assert b.columns == more.columns, name
        ids = [sorted(map(repr, (r["doc_id"] for r in t.select("doc_id").collect()))) for t in (a, b)]
        assert ids[0] == ids[1] and len(ids[0]), name
        quoted = ["`" + c.replace("`", "``") + "`" for c in names]
        assert b.select(*quoted).distinct().collect() == [tuple(range(len(names)))], name
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(map(tuple, last(spark, a, SMALL).collect()), key=repr) == sorted(map(tuple, last(spark, b, SMALL).collect()), key=repr)


def test_pipeline_run_with_columns_that_clash(spark, odd, tmp_path):
    names = ["_id", "_kept", "_sha", "_n", "_k", "_source", "_rejected", "rejected"]
    odd.write.parquet(str(tmp_path / "plain/documents.parquet"))
    odd.select("*", *[F.lit(1).alias(c) for c in names]).write.parquet(str(tmp_path / "more/documents.parquet"))
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path / d)).collect()), key=repr) for d in ("plain", "more"))
    assert a == b


def test_pipeline_of_an_empty_table(spark, odd, tmp_path):
    odd.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_queries_against_sql(spark):
    from tests_support import oracle, table

    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SMALL)
        want, columns = oracle(sql, SMALL)
        assert sorted(df.columns) == columns and table(df) == want, name


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
