"""Each stage of the pipeline on its own input, against what its operator says."""

from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import mixing, sentence_pieces
from pulsegrid.llm.common import written

from . import fixtures as fx


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_copies", "near_copies", "mix", "encode"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        ids = {r.doc_id: r.text for r in before.collect()}
        if name != "encode":
            assert docs.columns == columns
        if name in ("quality", "exact_copies", "near_copies"):
            assert all(ids[r.doc_id] == r.text for r in docs.collect())
        if name == "exact_copies":
            assert docs.count() == len({"".join(fx.WORD.findall(t or "")) for t in ids.values()})
        if name == "near_copies":
            want = fx.near_components(ids.items())
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in want.items() if i == c}
        if name == "mix":
            taken = {r.doc_id: r.taken for r in mixing.mix_sources(before).where("taken > 0").collect()}
            assert {r.doc_id: r.n for r in docs.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()} == taken
        if name == "encode":
            assert docs.count() == before.count() and docs.where("not lossless").count() == 0
            back = sentence_pieces.decode_pieces(docs)
            assert sorted(r.text for r in back.collect()) == sorted(r.text for r in before.collect())


def test_odd_rows(spark, sf_dir):
    for docs in (fx.documents(spark), fx.empty(spark)):
        docs = written(docs, "odd")
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
            assert name == "encode" or "text" in docs.columns
