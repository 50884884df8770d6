import corpus_pipeline as P


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == columns, name
        if name != "source mixing":
            assert after.count() <= before.count()
        before = after
    assert P.run(spark, sf).count() >= before.count()
    assert "pipeline" in __import__("__spark_entry__").queries()


def test_near_copies_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (2, text.replace("w3 ", "z ")), (3, "other words " * 30), (3, "other words " * 30), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()) == [1, 3, 4, 5]
    assert {r.n_chars for r in P.hide_secrets(spark, spark.createDataFrame([(1, "token: abcdefgh", 15)], "doc_id long, text string, n_chars long"), "").collect()} == {8}


LARGE = (1 << 60) + 1


def test_stages_leave_other_columns_as_they_are(spark):
    """Large integers beside nulls, columns named as those that stages make, rows without a doc_id."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score long, version long, mix_copies long, other array<long>"
    rows = [
        (LARGE, "plain words about a garden and a lake", "en", "a", 37, LARGE, None, LARGE, [LARGE, None]),
        (LARGE + 1, None, None, None, None, None, LARGE, None, None),
        (None, "a row without an id", "en", "a", 3, 1, 1, 1, []),
        (LARGE + 2, "token: abcdefgh and more words to keep", "en", "a", 38, 7, None, LARGE, None),
    ]
    docs = spark.createDataFrame(rows, schema).coalesce(1)
    for name, stage in P.STAGES[:3]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns, name
        found = {r.doc_id: r for r in after.collect()}
        assert set(found) == {LARGE, LARGE + 1, LARGE + 2}, name
        for r in rows[:2]:
            assert tuple(found[r[0]])[2:4] + tuple(found[r[0]])[5:] == r[2:4] + r[5:], name
        assert found[LARGE].text == rows[0][1] and found[LARGE + 1].text is None
    mixed = P.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and {(r.doc_id, r.score, r.mix_copies) for r in mixed.collect()} <= {(r[0], r[5], r[7]) for r in rows if r[0]}


def test_a_doc_id_with_two_texts_keeps_both(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (7, text.replace("w3 ", "z ")), (7, "quite other words " * 30), (7, "quite other words " * 30)]
    kept = P.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, text), (7, rows[2][1])]


def test_few_rows_go_to_python_at_once(spark):
    key, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame([(1, "a")], "doc_id long, text string")
    before = spark.conf.get(key)
    try:
        for given, held in (("10000", P.BATCH_ROWS), ("0", P.BATCH_ROWS), ("-1", P.BATCH_ROWS), ("7", 7)):
            for stage in (P.hide_secrets, P.pack_windows):
                spark.conf.set(key, given)
                stage(spark, docs, "")
                assert int(spark.conf.get(key)) == held
    finally:
        spark.conf.set(key, before)
