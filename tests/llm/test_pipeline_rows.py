import corpus_pipeline

DOCS = "doc_id bigint, text string"


def test_stages_judge_each_row_by_its_own_text(spark, tmp_path):
    leak = "these ten words in a row are an item of benchmark"
    spark.createDataFrame([("b", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "no id"), (None, "no id either"), (1, "a copy"), (2, "a copy"), (2, "its id has another text"), (None, "a  copy"), (None, "no id"), (3, f"x {leak} y"), (3, "clean under the id of a leak"), (None, f"{leak} too"), (4, "plain"), (4, "plain")]
    docs = spark.createDataFrame(rows, DOCS)

    def texts(stage):
        return sorted((str(r.doc_id), r.text) for r in stage(spark, docs, str(tmp_path)).collect())

    every = sorted({(str(i), t) for i, t in rows})
    assert texts(corpus_pipeline.without_copies) == [x for x in every if x not in [("2", "a copy"), ("None", "a  copy")]]
    assert texts(corpus_pipeline.without_benchmarks) == [x for x in every if leak not in x[1]]
