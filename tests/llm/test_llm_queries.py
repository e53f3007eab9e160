"""Registered queries against their SQL, and the pipeline."""

import os

import duckdb
import pytest

import corpus_pipeline
from lamella.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    want = con.execute(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(want.column_names) == columns
    assert sorted([text(r[c]) for c in columns] for r in df.collect()) == sorted([text(r[c]) for c in columns] for r in want.to_pylist())


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(len(r.doc_ids) == len(r.cu_seqlens) - 1 for r in rows)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage on what the one before kept, against SQL or brute force over the same rows."""
    from collections import defaultdict

    from test_operators import RAW, brute_classes

    from lamella.llm import packing

    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from read_parquet('{SF}/benchmark.parquet')")
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def written(df, name):
        df.write.parquet(str(tmp_path / name))
        con.execute(f"create or replace view documents as select * from read_parquet('{tmp_path}/{name}/*.parquet')")
        return spark.read.parquet(str(tmp_path / name))

    docs = written(docs, "d0")
    good = {r[0] for r in con.execute(registry.oracle_sql()["op2_quality_rules"]).fetchall() if r[-1]}
    next_ = written(stage["quality rules"](spark, docs, SF), "d1")
    assert next_.columns == docs.columns and sorted(r.doc_id for r in next_.collect()) == sorted(good)
    rows = [(r.doc_id, r.text) for r in next_.collect()]
    classes = brute_classes([(i, t) for i, t in rows if RAW.search(t or "")])
    docs, next_ = next_, written(stage["MinHash near-dedup"](spark, next_, SF), "d2")
    assert next_.columns == docs.columns and sorted(r.doc_id for r in next_.collect()) == sorted(i for i, t in rows if classes.get(i, i) == i)
    clean = {r[0] for r in con.execute("select doc_id from (" + registry.oracle_sql()["op8_decontamination"] + ") where not contaminated").fetchall()}
    docs, next_ = next_, written(stage["benchmark decontamination"](spark, next_, SF), "d3")
    assert next_.columns == docs.columns and {r.doc_id for r in next_.collect()} == clean
    copies = {r[0]: r[1] for r in con.execute("select doc_id, copies from (" + registry.oracle_sql()["op1_mixing"] + ")").fetchall()}
    text = {r.doc_id: r.text for r in next_.collect()}
    docs, next_ = next_, written(stage["mixing sources to target weights"](spark, next_, SF), "d4")
    got = [r.doc_id for r in next_.collect()]
    assert next_.columns == docs.columns and sorted(got) == sorted(i for i, n in copies.items() for _ in range(n))
    tokens = defaultdict(list)
    for r in stage["token-ID / binary output"](spark, next_, SF).collect():
        for k, (i, at) in enumerate(zip(r.doc_ids, r.offsets, strict=True)):
            tokens[i].append((at, r.ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]))
    bpe = packing.encoder(packing.default_vocabulary()).bpe
    for i, n in copies.items():
        whole = bpe.encode_ordinary(text[i] or "") + [packing.SEPARATOR]
        want = sorted((at, whole[at : at + packing.LENGTH]) for at in range(0, len(whole), packing.LENGTH)) * n
        assert sorted(tokens[i]) == sorted(want)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
