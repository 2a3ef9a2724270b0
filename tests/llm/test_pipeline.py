import __spark_entry__
import corpus_pipeline
from tabulon.llm import queries
from tabulon.sources import scratch


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(queries.QUERIES) <= set(names)


def test_stages_take_odd_rows(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 11)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "lazy dog and runs away from it")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, str(tmp_path))
            rows, given = out.collect(), docs.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                if name != "secret scans":
                    assert {tuple(r) for r in rows} <= {tuple(r) for r in given}
            want = {"n-gram Jaccard join": [None, 1, 3, 4, 5, 6, 7, 9, 10], "benchmark decontamination": [None, 3, 4, 5, 6, 7, 8, 9, 10]}.get(name)
            got = sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
            if docs is odd and want:
                assert got == want
            elif docs is odd and name in ("secret scans", "SentencePiece encoding"):
                assert got == sorted((r.doc_id for r in given), key=lambda x: (x is not None, x))


def test_stages_judge_rows_that_share_an_id(spark, tmp_path):
    a, b = "one two three four five six seven eight nine ten eleven", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b, "en", "s", 1), (None, a, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, b)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert sorted(((r.doc_id or 0), r.text) for r in by_name["n-gram Jaccard join"](spark, docs, "").collect()) == sorted([(0, a), (1, a), (1, b)])
    assert sorted(((r.doc_id or 0), r.text) for r in by_name["benchmark decontamination"](spark, docs, str(tmp_path)).collect()) == [(0, a), (1, a)]


def test_stage_decisions(spark, tmp_path):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, a, "en", "s", len(a)), (2, a.upper(), "en", "s", len(a)), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s", 9), (4, "password = 0123456789abcdef, nothing else here", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta theta iota kappa lambda")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert sorted(r.doc_id for r in by_name["n-gram Jaccard join"](spark, docs, "").collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in by_name["benchmark decontamination"](spark, docs, str(tmp_path)).collect()) == [1, 2, 4]
    hidden = {r.doc_id: (r.text, r.n_chars) for r in by_name["secret scans"](spark, docs, "").collect()}
    assert hidden[4] == ("[secret], nothing else here", 27) and hidden[1] == (a, len(a))
    assert {r.doc_id for r in by_name["SentencePiece encoding"](spark, docs, "").collect()} == {1, 2, 3, 4}


def test_run_equals_its_stages_one_by_one(spark, odd, tmp_path):
    rows = [(k, ("good plain words about nothing at all number %d and more of them " % k) * 3 if k % 2 else "## 99 @@ spam %d ##" % k) for k in range(100, 160)]
    extra = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd.select(extra.columns).unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "plain words about nothing at all number 111 and more of them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/own-{k}")
        docs = spark.read.parquet(f"{tmp_path}/own-{k}")
    before = set(scratch.children(spark, scratch.shared_folder(spark), "run"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect())) and 5 < got.count() < len(rows)
    left = set(scratch.children(spark, scratch.shared_folder(spark), "run")) - before
    assert len(left) == 1 and not any("steps" in x for x in left)  # the result alone
