from pyspark.sql import functions as F
from test_operators import fingerprint_again, hits_again, linked, removed_lines


def test_pipeline_brute_force(spark, small, duck, texts):
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    from vektorium.llm import quality

    judged = duck.sql(quality.ORACLE).df()
    docs = {i: texts[i] for i in judged.loc[judged["kept"], "doc_id"]}
    gone = removed_lines(docs)
    docs = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in docs.items()}
    docs = {i: docs[i] for i, c in linked({i: fingerprint_again(t) for i, t in docs.items()}).items() if i == c}
    items = {r[0]: r[1] for r in duck.sql("SELECT item_id, text FROM benchmark").df().itertuples(index=False, name=None)}
    docs = {i: t for i, t in docs.items() if not hits_again(t, items)[1]}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["ids"], r["round_trip"]) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {i: (sp.encode(t), True) for i, t in docs.items()}


def test_stages_keep_the_columns(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, small).columns == docs.columns, name
    out = corpus_pipeline.line_dedup(spark, docs, small)
    assert out.where("n_chars != length(text)").isEmpty() and out.count() == docs.count()


def test_stages_take_odd_rows(spark, odd, none, tmp_path):
    """Nulls, empty, blank, long and repeated texts, a null id and clashing columns, through each stage by itself."""
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "One two three four five")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    # n_chars is a column of the documents table, which line dedup keeps up to date
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    kept = {name: [(r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect()] for name, stage in corpus_pipeline.STAGES[:-1]}
    ids = {name: sorted((i for i, _ in rows), key=lambda i: i or -1) for name, rows in kept.items()}
    assert ids["line dedup"] == sorted((r["doc_id"] for r in odd.collect()), key=lambda i: i or -1)
    assert dict(kept["line dedup"])[5] == "" and dict(kept["line dedup"])[1] is None
    assert ids["SimHash near-dedup"] == [None, 1, 4, 6, 7, 8, 9, 11]
    assert not {9, 10, None} & set(ids["benchmark decontamination"]) and len(ids["benchmark decontamination"]) == odd.count() - 3
    assert set(ids["quality rules"]) <= {7}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == odd.count() and all(r["round_trip"] for r in last if r["doc_id"] in (1, 2, 4, 9)) and all(r["n_pieces"] == 0 for r in last if r["doc_id"] in (1, 2))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
