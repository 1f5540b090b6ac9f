"""The pipeline's stages, one by one and together."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from dosewell.llm.common import cut, table
from tests.llm.test_ops import linked, odd, shingle_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    kept = cut(stages["language_id"](spark, docs, sf_dir))
    assert kept.columns == COLUMNS
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, t in before if t and any(c.isalpha() for c in t)}

    once = cut(stages["exact_dedup"](spark, kept, sf_dir))
    texts = [r["text"].lower() for r in once.collect()]
    assert once.columns == COLUMNS and len(texts) == len(set(texts))
    assert once.count() == len({r["text"].lower() for r in kept.collect()})

    near = cut(stages["near_dedup"](spark, once, sf_dir))
    want = linked({r["doc_id"]: shingle_set(r["text"], 5) for r in once.collect()})
    assert near.columns == COLUMNS and {r[0] for r in near.select("doc_id").collect()} == {i for i in want if want[i] == i}

    mixed = cut(stages["mix_sources"](spark, near, sf_dir))
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == COLUMNS and set(times) <= {r["doc_id"] for r in near.collect()} and max(times.values()) <= 3

    packed = stages["best_fit_packing"](spark, mixed, sf_dir).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == times
    ends = collections.Counter()
    for r in packed:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024


def test_stages_take_odd_rows(spark, sf_dir):
    docs = odd(spark).withColumn("_id", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("row", F.lit("y"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, sf_dir)
            assert out.columns == docs.columns, name
            out.count()


def test_stages_take_columns_of_any_name(spark, sf_dir):
    extra = ["_row_", "_ROW", "_copies", "Copies", "number", "whole", "a.b", "_ID"]
    docs = odd(spark).drop("_h")
    for k, name in enumerate(extra):
        docs = docs.withColumn(name, F.lit(f"v{k}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf_dir).collect()
        assert rows, name
        assert all(tuple(r[c] for c in extra) == tuple(f"v{k}" for k in range(len(extra))) for r in rows), name


def test_rows_are_told_apart_by_themselves(spark, sf_dir):
    docs = odd(spark)
    rows = [(5, "alpha beta gamma"), (9, "alpha beta gamma"), (5, "a wholly different text"), (9, "alpha beta gamma"), (None, "Alpha beta gamma"), (None, "x"), (None, "x")]
    small = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in stages["exact_dedup"](spark, small, sf_dir).collect()) == [(0, "x"), (5, "a wholly different text"), (9, "alpha beta gamma")]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in stages["near_dedup"](spark, small, sf_dir).collect()) == [(0, "x"), (5, "a wholly different text"), (5, "alpha beta gamma")]
    texts = [(r["text"] or "").lower() for r in stages["exact_dedup"](spark, docs, sf_dir).collect()]
    assert sorted(texts) == sorted({(r["text"] or "").lower() for r in docs.collect()})
    near = stages["near_dedup"](spark, docs, sf_dir).collect()
    want = collections.Counter(shingle_set(r["text"], 5) for r in docs.collect())
    got = collections.Counter(shingle_set(r["text"], 5) for r in near)
    assert got[frozenset()] == want[frozenset()]
    assert all(n == 1 for s, n in got.items() if s)


def test_packing_takes_odd_rows(spark, sf_dir):
    docs = odd(spark)
    packed = dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, sf_dir).collect()
    firsts = collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert firsts == collections.Counter(r["doc_id"] for r in docs.collect())
    assert dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs.limit(0), sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
