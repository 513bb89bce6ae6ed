import corpus_pipeline
from strandloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string"


def prose(tag):
    return " ".join(f"{tag}{i}" for i in range(80))


def rows_of(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def test_verdicts_are_of_rows(spark, sf_dir):
    a, b, c, d = map(prose, "abcd")
    docs = spark.createDataFrame([(1, a, "en"), (1, a, "en"), (2, b, "en"), (2, "short", "en"), (None, c, "en"), (None, c, "en"), (None, d, "en"), (3, d, "en"), (None, "few words", "en")], SCHEMA)
    good = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert good.count() > 3 and not {"short", "few words"} & {r.text for r in good.collect()}
    good = docs.filter("length(text) > 20")
    for stage in (corpus_pipeline.exact_copies, corpus_pipeline.near_copies):
        kept = stage(spark, good, sf_dir)
        assert kept.columns == docs.columns and rows_of(kept) == sorted([("1", a), ("2", b), ("None", c), ("3", d)])


def test_each_row_has_its_rate(spark):
    docs = spark.createDataFrame([(1, "x", 10), (1, "y", 11), (None, "z", 12)], "doc_id long, text string, row_ long")
    rates = spark.createDataFrame([(10, 3.0), (11, 0.0), (12, 2.0)], "doc_id long, rate double")
    assert sorted(r.text for r in mixing.resample(docs, rates, key="row_").collect()) == ["x", "x", "x", "z", "z"]


def test_a_table_in_files_is_not_copied(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline._numbered(docs)
    assert sorted(rows.inputFiles()) == sorted(docs.inputFiles())
    assert rows.select("row_").distinct().count() == docs.count()


def test_rows_are_picked_without_a_shuffle_of_texts(spark, tmp_path):
    """All of 70,000 rows in two files, some of them once; rows at the borders of bitmaps are among them."""
    spark.range(70_000).selectExpr("id doc_id", "cast(id as string) text").repartition(2).write.parquet(str(tmp_path / "docs"))
    rows = corpus_pipeline._numbered(spark.read.parquet(str(tmp_path / "docs")))
    assert rows.select("row_").distinct().count() == 70_000
    near = "(row_ & 32767) in (0, 1, 2, 32766, 32767) or doc_id % 7 = 3"
    kept = rows.filter(near)
    got = corpus_pipeline._only(rows, kept.select("row_").union(kept.select("row_")))
    assert got.columns == ["doc_id", "text"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in kept.collect())
    assert corpus_pipeline._only(rows, rows.select("row_")).count() == 70_000 and corpus_pipeline._only(rows, rows.select("row_").limit(0)).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = corpus_pipeline._only(rows, kept)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
