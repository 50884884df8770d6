import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwork.operators import chunking as C
from gleanwork.operators import compare as X
from gleanwork.operators import evalset as E
from gleanwork.operators import maintenance as M
from gleanwork.operators import models as D
from gleanwork.operators import profile as P
from gleanwork.operators import ranking as R


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_twins_ties_and_missing_gold(spark):
    docs = frame(spark, [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.9, 0.1])], "id long, v array<double>")
    queries = frame(spark, [(1, 2, [1.0, 0.0]), (2, 9, [1.0, 0.0]), (3, 3, [1.0, 0.0])], "qid long, gold long, v array<double>")
    twins = frame(spark, [(2, 1), (2, 3), (2, 77), (3, 1)], "gold long, twin long")
    got = {r.qid: r["rank"] for r in R.known_item_ranks(queries, docs, twins).collect()}
    assert got == {1: 1, 3: 3}  # doc 4 ties with 2; twin 1 is above both; no gold, no rank
    evalset = frame(spark, [("q", 1), ("q", 2), ("r", 3)], "query string, answer_id long")
    assert sorted(map(tuple, R.twin_pairs(evalset).collect())) == [(1, 2), (2, 1)]


def test_rerank(spark):
    cand = frame(spark, [(1, 10, 1, 0.5), (1, 11, 2, 0.9), (1, 12, 3, 0.9), (1, 13, 4, 0.1), (2, 10, 1, 0.3)], "qid long, id long, pos int, score double")
    base = frame(spark, [(1, 10, 1), (2, 99, 44)], "qid long, gold long, rank long")
    twins = frame(spark, [(10, 12)], "gold long, twin long")
    assert {r.qid: r["rank"] for r in R.candidate_ranks(cand, base, twins).collect()} == {1: 2, 2: 44}


def test_fusion_and_dedup(spark):
    a = frame(spark, [(1, 5, 1), (1, 6, 2)], "qid long, id long, pos int")
    b = frame(spark, [(1, 6, 1)], "qid long, id long, pos int")
    assert [r.id for r in R.fused([a, b]).orderBy("pos").collect()] == [6, 5]
    found = frame(spark, [(1, 1, 0.9, "x"), (1, 2, 0.8, "x"), (1, 3, 0.7, "y")], "qid long, id long, sim double, payload string")
    assert [(r.id, r.pos) for r in R.one_per(found, F.col("payload"), 5).orderBy("pos").collect()] == [(1, 1), (3, 2)]


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [("b", arm, g, int(rng.integers(1, 9)), int(rng.integers(1, 12))) for arm in ("x", "y") for g in range(400)]
    pairs = frame(spark, rows, "base_arm string, arm string, gold long, rank long, base_rank long")
    both = {r.arm: r for r in X.bootstrap(pairs).collect()}
    alone = X.bootstrap(pairs.where("arm = 'x'")).first()
    assert both["x"] == alone  # another arm does not change an interval
    d = np.array([1 / r - 1 / b for _, arm, _, r, b in rows if arm == "x"])
    means = d[np.random.default_rng(2).integers(0, 400, (4000, 400))].mean(axis=1)
    lo, hi = np.percentile(means, [2.5, 97.5])
    assert abs(lo - alone.lo) < 0.006 and abs(hi - alone.hi) < 0.006
    near = X.hash_bootstrap(pairs.where("arm = 'x'"), 200).first()
    assert abs(lo - near.lo) < 0.02 and near.verdict == alone.verdict


def test_exact_bootstrap(spark, monkeypatch):
    """The digits of plain resampling, also in blocks and beside another arm; ids are in the order of text."""
    rng = np.random.default_rng(1)
    rows = [("b", arm, f"q{g}", int(rng.integers(1, 9)), int(rng.integers(1, 12))) for arm in ("x", "y") for g in range(301)] + [("b", "x", "none", None, 1)]
    pairs = frame(spark, rows, "base_arm string, arm string, gold string, rank long, base_rank long")
    monkeypatch.setattr(X, "DRAWN", 301 * 7)
    multinomial = {r.arm: r for r in X.bootstrap(pairs.where("rank is not null")).collect()}
    for r in X.bootstrap_exact(pairs).collect():
        d = np.array([1.0 / a - 1.0 / b for _, arm, g, a, b in sorted(rows, key=lambda x: x[2]) if arm == r.arm and a])
        means = d[np.random.default_rng(42).integers(0, len(d), size=(2000, len(d)))].mean(axis=1)
        assert [r.lo, r.hi] == np.percentile(means, [2.5, 97.5]).tolist() and (r.n, r.delta_mrr) == (301, d.mean())
        assert abs(r.lo - multinomial[r.arm].lo) < 0.006 and abs(r.hi - multinomial[r.arm].hi) < 0.006
    monkeypatch.setattr(X, "EXACT_MOST", 300)
    with pytest.raises(ValueError, match="use bootstrap"):
        X.bootstrap_exact(pairs)


def test_what_people_wrote_stays(spark):
    old = frame(spark, [("a", "people wrote this", 1), ("b", "", 2), ("c", None, 3), ("d", "old run", 4)], "run string, title string, n int")
    new = frame(spark, [("a", "default", 10), ("b", "default", 20), ("c", "default", 30), ("e", "default", 50)], "run string, title string, n int")
    got = {r.run: (r.title, r.n) for r in M.merged_metrics(old, new, "run", ["title"]).collect()}
    assert got == {"a": ("people wrote this", 10), "b": ("default", 20), "c": ("default", 30), "d": ("old run", 4), "e": ("default", 50)}

def test_paired_and_guards(spark):
    ranks = frame(spark, [("x", 1, 1), ("x", 2, 4), ("x", 3, None), ("b", 1, 2), ("b", 2, 2), ("b", 3, 1)], "arm string, gold long, rank long")
    base = ranks.where("arm = 'b'").select(F.lit("x").alias("arm"), F.lit("b").alias("base_arm"), "gold", "rank")
    got = X.paired(ranks, base).first()
    assert (got.n, got.win, got.lose, got.tie, got.delta_mrr) == (2, 1, 1, 0, 0.125)
    with pytest.raises(ValueError, match="twice"):
        X.fail_on(X.unique_or_fail(ranks, "arm"), "arms that are there twice")


def test_leaks_and_samples(spark):
    rows = [(str(i).zfill(3), f"text {i % 40}", "Validation" if i % 4 == 0 else "Training", "abc"[i % 7 % 3]) for i in range(200)]
    df = frame(spark, rows, "id string, content string, split string, department string")
    valid, train = df.where("split = 'Validation'"), df.where("split = 'Training'")
    seen = {r[1] for r in rows if r[2] == "Training"}
    assert {r.id for r in E.leak_free(valid, train).collect()} == {r[0] for r in rows if r[2] == "Validation" and r[1] not in seen}
    assert E.leak_free(valid, train, leaked=True).count() + E.leak_free(valid, train).count() == valid.count()
    one, two = (sorted(r.id for r in E.stratified(df, "department", 30, 1).collect()) for _ in range(2))
    assert one == two and len(one) == 30
    rare = df.unionByName(frame(spark, [("x", "t", "Validation", "rare"), ("y", "t", "Validation", None)], df.schema))
    assert {"a", "b", "c"} < {r.department for r in E.stratified(rare, "department", 203, 1).collect()}


def test_chunks_rebuild_the_text(spark):
    rng = random.Random(0)
    texts = [(i, "".join(rng.choice("ab .\n") for _ in range(rng.randrange(300)))) for i in range(30)] + [(30, ""), (31, None), (32, "x" * 100)]
    df = frame(spark, texts, "id long, text string")
    parts = C.recursive(df, 40, "id").toPandas()
    for i, t in texts:
        mine = parts[parts.id == i].sort_values("chunk_index").content.tolist()
        assert "".join(mine) == (t or "") and all(len(x) <= 40 for x in mine)
    fixed = C.fixed(df, 50, 10).toPandas()
    for i, t in texts:
        mine = fixed[fixed.id == i].sort_values("chunk_index").content.tolist()
        assert "".join([x if k == 0 else x[10:] for k, x in enumerate(mine)]) == (t or "")
    for r in C.packed(df, 30).collect():
        assert len(r.content) <= 30 or "\n" not in r.content
    with pytest.raises(ValueError):
        C.fixed(df, 10, 10)


def test_decompose_and_clean(spark):
    df = frame(spark, [(1, True, "One? Two? Three"), (2, False, "One? Two?"), (3, True, "Only one")], "id int, flag boolean, content string")
    assert [(r.id, r.part, r.content) for r in C.decomposed(df, "flag").orderBy("id", "part").collect()] == [(1, 0, "One?"), (1, 1, "Two?"), (1, 2, "Three"), (2, 0, "One? Two?"), (3, 0, "Only one")]
    text = frame(spark, [("It ends here.12 Next.\n표 3 증상\nTable 2: x\nplain",)], "t string").select(C.cleaned(F.col("t")).alias("t")).first().t
    assert text == "It ends here. Next.\nplain"


def test_batches():
    rng = random.Random(1)
    for _ in range(200):
        lengths = sorted((rng.randrange(1, 9000) for _ in range(rng.randrange(60))), reverse=True)
        spans = list(D.batches(lengths))
        assert [i for a, b in spans for i in range(a, b)] == list(range(len(lengths)))
        assert all(b - a == 1 or (b - a <= 32 and (b - a) * max(lengths[a:b]) <= 8000) for a, b in spans)


def test_embedding_and_calls(spark):
    items = frame(spark, [("doc", str(i), "w " * i) for i in range(40)] + [("query", "1", "w")], "kind string, id string, text string")
    got = D.embed(items, D.hashing_encoder(8), "m", 8, "q", "p", None, 3).toPandas()
    assert len(got) == 41 and got.max_seq_len.isna().all() and all(abs(np.linalg.norm(v) - 1) < 1e-5 or not np.any(v) for v in got.embedding)

    def fails(text):
        if text == "b":
            raise RuntimeError("limit")
        return text[:1]

    rows = {r.content: (r.query, r.error) for r in D.rewrite(frame(spark, [("abc",), ("b",), ("",)], "content string"), fails).collect()}
    assert rows == {"abc": ("a", None), "b": (None, "API: RuntimeError"), "": (None, "empty")}
    judged = D.judge(frame(spark, [("a", "a b")], "query_text string, context string"), lambda q, c: q in c)
    assert judged.first().judgement == 1.0


def test_upsert(spark):
    t0 = F.lit("2020-01-01").cast("timestamp")
    old = frame(spark, [(1, "a"), (2, "b")], "id int, v string").withColumns({"created_at": t0, "updated_at": t0})
    got = {r.id: r for r in M.upsert(old, frame(spark, [(2, "b"), (3, None)], "id int, v string"), F.lit("2021-01-01").cast("timestamp")).collect()}
    assert got[1].updated_at.year == 2020 and got[2].updated_at.year == 2021 and got[2].created_at.year == 2020 and got[3].created_at.year == 2021 and got[3].v is None


def test_rates_and_audit(spark):
    df = frame(spark, [(True, None), (False, True)], "a boolean, b boolean")
    assert {r.flag: (r.n, r.rate) for r in P.rates(df, ["a", "b"]).collect()} == {"a": (1, 0.5), "b": (1, 0.5)}
    evalset = frame(spark, [("q", "1"), ("q", "2"), ("r", "1"), ("s", "9")], "query string, answer_id string")
    index = frame(spark, [("1", "c", "Validation"), ("2", "c", "Training")], "id string, content string, split string")
    assert {r.check: r.n for r in E.audit(evalset, index).collect()} == {"duplicate_answer_id": 1, "gold_missing": 1, "gold_not_validation": 1, "duplicate_content": 2, "duplicate_query": 1}


def test_mixed_index_has_every_character(spark):
    from gleanwork.plans import texts

    sf = "/root/testdata/sf0.001"
    rows = texts.mixed_index(spark, sf).where("chunk_index is not null").collect()
    assert len({r.id for r in rows}) == len(rows)
    got = {}
    for r in sorted(rows, key=lambda r: (r.id.split("-")[0], r.chunk_index)):
        key = int(r.id.split("-")[0][1:])
        got[key] = got.get(key, "") + (r.content if r.chunk_index == 0 else r.content[50:])
    assert got == {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text}
    assert max(map(len, got.values())) > 400


def test_bm25_searches_with_all_words(spark, tmp_path):
    """Against brute force; a document that has only words after an item's fifth is found."""
    import math

    from gleanwork.plans import texts

    docs = {1: "alpha beta gamma", 2: "omega omega psi x y z", 3: "none of these", 4: "psi beta chi chi chi", 5: ""}
    items = {7: "Alpha beta gamma delta eps zeta omega psi omega", 8: "a b c d e chi"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = {i: t.split() for i, t in docs.items()}
    mean, want = sum(map(len, words.values())) / len(words), {}
    for q, text in items.items():
        for i, own in words.items():
            for term in set(text.lower().split()) & set(own):
                df, tf = sum(term in w for w in words.values()), own.count(term)
                want[q, i] = want.get((q, i), 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / mean))
    got = {(r.qid, r.id): r.score for r in texts.bm25_topk(spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()} and (7, 2) in got and (8, 4) in got


def test_model_jobs_leave_large_ids_beside_nulls(spark):
    big = (1 << 60) + 1
    rows = frame(spark, [(big, "a b", "a c", "x"), (None, "q", "", None)], "id long, query_text string, text string, context string").coalesce(1)
    assert {r.id: r.score for r in D.score_pairs(rows, D.overlap_scorer).collect()} == {big: 0.5, None: 0.0}
    assert {r.id: (r.query, r.error) for r in D.rewrite(rows, str.upper, "text").collect()} == {big: ("A C", None), None: (None, "empty")}
    assert {r.id: r.judgement for r in D.judge(rows, lambda q, c: len(q)).collect()} == {big: 3.0, None: 1.0}


def test_answered_and_generated(spark):
    turns = frame(spark, [(1, 1, "user", "q"), (1, 2, "assistant", "long answer"), (1, 3, "user", "r"), (1, 4, "user", "s"), (2, 1, "user", "t"), (2, 2, "assistant", "no")], "c long, turn int, role string, text string")
    assert [tuple(r) for r in E.answered(turns, "c", "turn", "role", "text", 5).collect()] == [(1, "q", "long answer")]
    chunks = frame(spark, [(1, "a? b? a?  ?"), (2, ""), (3, "Column x moon ?lump")], "id long, content string")
    got = E.generated_questions(chunks, lambda c: F.split(c, r"\?")).collect()
    assert [(r.id, r.question_index, r.question) for r in got] == [(1, 0, "a"), (1, 1, "b"), (3, 0, "Column x moon"), (3, 1, "lump")]


def test_no_common_queries(spark):
    ranks = frame(spark, [("x", 1, 2), ("y", 5, 1)], "arm string, gold long, rank int")
    base = frame(spark, [("x", "b", 1, 3), ("y", "b", 9, 3)], "arm string, base_arm string, gold long, rank int")
    with pytest.raises(Exception, match="'y'"):
        X.common_or_fail(ranks, base).collect()
    assert X.common_or_fail(ranks.where("arm = 'x'"), base).first().win == 1


def test_duplicates_and_requests(spark):
    rows = frame(spark, [("a", 1), ("a", 2), (None, 2)], "c string, k int")
    assert P.duplicates(rows, ["c", "k"]).first().asDict() == {"dup_c": 2, "dup_k": 1}
    asked = frame(spark, [("q", None), ("", 3), ("r", 11), ("x" * 1001, 1)], "question string, k int")
    assert [(r.question, r.top_k) for r in P.valid_requests(asked, "question", F.col("k")).collect()] == [("q", 3)]
    assert P.mismatched(rows, "c", "c").count() == 0


def test_semantic_chunks_rebuild_the_text(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice(["ab. ", "zz! ", "a.b ", "qq\n", "ä? ", "  ", "... "]) for _ in range(rng.randrange(90)))) for i in range(25)] + [(30, ""), (31, None), (32, "no end")]
    df = frame(spark, texts, "id long, text string").repartition(2)
    one = {t: C.semantic(df, D.letter_encoder, "id", threshold=t, most=m).toPandas() for t, m in ((0.5, 64), (0.9, 3), (0.90, 1))}
    for parts in one.values():
        for i, t in texts:
            mine = parts[parts.id == i].sort_values("chunk_index")
            assert "".join(mine.content) == (t or "") and all((t or "")[s : s + len(c)] == c for s, c in zip(mine.start, mine.content, strict=True))
    least = C.semantic(df, D.letter_encoder, "id", percentile=0).toPandas()
    assert len(least) == sum(bool(t) for _, t in texts)  # nothing is under the smallest
    assert len(C.semantic(df, D.letter_encoder, "id", percentile=60).toPandas()) > len(least)
    long = C.semantic(frame(spark, [(1, "aa. " * 70 + "zz. " * 70)], "id long, text string"), D.letter_encoder, "id", threshold=0.5, most=7).toPandas()
    assert long.sentences.tolist() == [70, 70]
    with pytest.raises(ValueError):
        C.semantic(df, D.letter_encoder, "id")


def test_round_trip(spark):
    """A question that fits another chunk better goes; equal chunks: the smaller id has it."""
    chunks = frame(spark, [(1, "aaa b. ccc"), (2, "ccc. ccc"), (3, "ccc. ccc"), (4, None), (5, "")], "id long, content string")
    got = E.round_trip(chunks, lambda c: F.split(c, r"\."), D.letter_encoder).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "aaa b"), (2, 0, "ccc")]


def test_sketches_merge(spark):
    """Sketches of splits merged are those of all rows, and the estimate is within its bound."""
    rows = spark.range(60_000).selectExpr("id % 7 as split", "id % 20011 as v", "if(id % 3 = 0, null, id) as w")
    parts = P.distinct_sketches(rows, ["split"], ["v", "w"]).withColumn("run", F.lit(1))
    got = {r.column: r.distinct for r in P.merged_counts(parts, ["run"], ["v", "w"]).collect()}
    whole = {r.column: r.distinct for r in P.merged_counts(P.distinct_sketches(rows.withColumn("run", F.lit(1)), ["run"], ["v", "w"]), ["run"], ["v", "w"]).collect()}
    assert got == whole and abs(got["v"] - 20011) < 0.07 * 20011 and abs(got["w"] - 40000) < 0.07 * 40000


def test_counted_tokens(spark):
    rows = frame(spark, [(1, "a b\n c"), (2, None), (3, "")], "id long, content string")
    assert {r.id: r.n_tokens for r in D.count_tokens(rows, D.word_counter).collect()} == {1: 3, 2: 0, 3: 0}


def test_multinomial_draws_in_blocks():
    """The numbers of one draw of all resamples, but not held at once: 20,000 distinct pairs of ranks are 320 MB."""
    import tracemalloc

    rng = np.random.default_rng(1)
    n, d = rng.integers(1, 4, size=20_000), rng.normal(size=20_000)
    tracemalloc.start()
    means = X._drawn_means(n, d, 2000, 42)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000_000
    few = np.random.default_rng(42).multinomial(n.sum(), n / n.sum(), size=250) @ d / n.sum()
    assert len(means) == 2000 and np.allclose(means[:250], few, rtol=0, atol=1e-12)


def test_hash_bootstrap_moves_no_resample(spark):
    """The draws of md5, for comparisons of two sizes and with unknown ranks; a row that moves is a task's share, not a resample."""
    from hashlib import md5

    rng = np.random.default_rng(4)
    rows = [("b", arm, g, int(rng.integers(1, 9)), int(rng.integers(1, 12))) for arm, n in (("x", 60), ("y", 60), ("z", 37)) for g in range(n)] + [("b", "x", 99, None, 1)]
    out = X.hash_bootstrap(frame(spark, rows, "base_arm string, arm string, gold long, rank long, base_rank long"), 200)
    got = {r.arm: (r.lo, r.hi) for r in out.collect()}
    for arm, n in (("x", 60), ("y", 60), ("z", 37)):
        d = np.array([1 / r - 1 / b for _, a, _, r, b in rows if a == arm and r])
        means = [d[[int(md5(f"{r}:{j}".encode()).hexdigest()[:8], 16) % n for j in range(n)]].mean() for r in range(200)]
        assert np.allclose(got[arm], np.percentile(means, [2.5, 97.5]), rtol=0, atol=2e-9)
    assert "sequence(0, 199" not in out._jdf.queryExecution().toString()
