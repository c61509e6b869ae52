import pytest

import corpus_pipeline as P
from facteng.llm import queries as Q


def test_stages_call_the_agreed_operators():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))


def test_stages_on_awkward_rows(spark, docs, rows, tmp_path):
    d = str(tmp_path)
    bench = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    bench.write.parquet(f"{d}/benchmark.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(20, 60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{d}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars", "line", "k")
    plain.write.parquet(f"{d}/documents.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, d)
        if k < len(P.STAGES) - 1:
            assert out.columns == plain.columns, name
        out.write.parquet(f"{d}/out{k}")
        now = spark.read.parquet(f"{d}/out{k}")
        assert now.count() > 0
    assert {"shard", "epoch", "order_key"} <= set(now.columns)
    texts = {r.text for r in spark.read.parquet(f"{d}/out3").collect()}
    assert rows[3][1] not in texts


@pytest.mark.parametrize("k", range(5))
def test_stages_on_an_empty_table(spark, none, tmp_path, k):
    d = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert P.STAGES[k][1](spark, docs, d).count() == 0
