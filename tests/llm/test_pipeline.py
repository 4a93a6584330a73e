import corpus_pipeline
from routeloom.llm.queries import ORACLE, QUERIES


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    start = {r.doc_id: r for r in docs.collect()}
    seen = set(start)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert len(ids) == len(rows) and ids <= seen
        if name == "ngram_jaccard_join":
            texts = [r.text for r in rows if r.text]
            assert len(texts) == len(set(texts))
        seen, docs = ids, spark.createDataFrame(rows, out.schema)
    bench = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert not any(b in r.text for r in docs.collect() for b in bench)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in last} == seen and all(r.same and r.n_tokens == len(r.ids) for r in last)
    assert len(seen) > 0.6 * len(start)


def test_odd_rows_pass_every_stage(spark):
    d = "/root/testdata/sf0.001"
    line = "several plain words that make up one more line of this text and go on for a while "
    rows = [(1, line * 2 + "a", None, "s", None), (2, None, "en", None, 0), (3, "", "en", "s", 0), (None, line.upper() + "tail of it", "x", "y", 1), (1, line * 2 + "a", None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame_out = stage(spark, frame, d)
            frame_out.collect()
            frame = frame_out if "text" in frame_out.columns else frame


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE) <= set(QUERIES)
