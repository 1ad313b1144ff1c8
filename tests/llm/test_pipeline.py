"""The pipeline's stages: each works on its input, its decision takes effect, and clean documents stay."""

import pytest

import corpus_pipeline as pipeline
from keelson.llm import leaks, quality, simhash
from keelson.llm.common import remainder

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "mixing"]
    seen = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert seen[-1].columns[:len(columns)] == columns and (k == 4 or seen[-1].columns == columns)
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen]
    assert all(b <= a for a, b in itertools_pairs(ids)) and len(ids[-1]) > 0

    model = quality.fit(docs.where(remainder(F.col("doc_id"), 5) != 0), spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == {r["doc_id"] for r in quality.score(docs, model).where("quality_score >= 0.3").collect()}
    left = [set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in seen[3].collect()]
    near = [(a, b) for i, a in enumerate(left) for b in left[i + 1:] if a and len(a & b) >= 0.8 * len(a | b)]
    assert len(near) <= 0.1 * (len(ids[2]) - len(ids[3]))         # nearly no near copies are left
    leaking = {r["id"] for r in leaks.leaks(seen[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids[4] == ids[3] - leaking
    assert all(0 < r["taken"] <= 3 * r["size"] for r in seen[5].collect())
    assert {r["doc_id"] for r in pipeline.run(spark, SF).collect()} == ids[5]


def itertools_pairs(xs):
    return zip(xs, xs[1:], strict=False)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_null_and_empty_rows(spark, k):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (1, "", "en", "s", 0, "x"), (2, "w " * 30000, None, None, 60000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    assert pipeline.STAGES[k][1](spark, docs.drop("size"), SF).count() <= 4
    assert pipeline.STAGES[k][1](spark, docs.drop("size").limit(0), SF).count() == 0
