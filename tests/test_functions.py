import re

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import text as T
from gleanwork.functions import vectors as V
from gleanwork.operators import profile as P


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(c.alias("x")).first().x


def test_strip(spark):
    assert one(spark, T.strip(F.col("a")), a=" \t 　\x1c내과 과\x85\n") == "내과 과"
    assert one(spark, T.strip(F.col("a")), a=None) is None


SENTENCES = [
    "밥을 줘도 되나요? 병원에 갈까요? 얼마인가요", "갈까요? 되나요요", "비용이 3 만원인지 궁금해요", "수술비 30 원대, 동물병원 수의사", "원인은 무엇이고 언제 어디로 가야 하는지요??",
    "그리고 1. 사료\n\n2.  간식 - 물 * 약\n또한 아울러", "진료를 문의드립니다. 알고 싶습니다 합니까", "괜찮습니까가요 안돼요", "plain text?", "",
]


@pytest.mark.parametrize("name", ["ENDING", "EXPRESSION", "EXPRESSION_LOOSE", "SHIFT", "FORMAL", "COST", "QUESTION"])
def test_patterns_count_as_python_does(spark, name):
    pattern = getattr(T, name)
    rows = spark.createDataFrame(list(enumerate(SENTENCES)), "i int, t string").select("i", T.count(F.col("t"), pattern).alias("n"), F.col("t").rlike(pattern).alias("any"))
    plain = re.compile(pattern.removeprefix("(?U)"))
    assert {r.i: (r.n, r.any) for r in rows.collect()} == {i: (len(plain.findall(t)), bool(plain.search(t))) for i, t in enumerate(SENTENCES)}


def test_rules_and_flags(spark):
    text = "밥을 줘도 되나요? 병원에 갈까요? 얼마인가요 그리고 " + "가" * 480
    got = P.with_compound_rules(spark.createDataFrame([(text,)], "content string")).first()
    assert (got.endings, got.expressions, got.shifts) == (2, 5, 1)
    assert got.endings3_or_2long and got.expressions5 and got.shifts1 and got.long400_or_expressions3 and not got.endings3
    flags = spark.createDataFrame([("동물병원에서 3만원", "되나요")], "a string, q string").select(*(c.alias(n) for n, c in P.text_flags(F.col("a"), F.col("q")).items())).first()
    assert flags.asDict() == {"hospital": True, "vet": False, "cost": True, "question": True}
    bad = spark.createDataFrame([(" 궁금합니다 ", "궁금합니다", None)], "q string, o string, a string").select(*(c.alias(n) for n, c in P.query_quality(F.col("q"), F.col("o"), F.col("a")).items())).first()
    assert bad.asDict() == {"formal": True, "same": True, "too_long": False, "no_answer": True}
    assert P.normalized(spark.createDataFrame([("되나요 갈까?", "x", None, None, None)], "content string, payload string, department string, life_cycle string, disease string"), "s").first().question_marks == 2


def test_clean_generated(spark):
    assert one(spark, T.clean_generated(F.col("a")), a="  \"'언제 먹이나요?'\"\n second") == "언제 먹이나요?'\""
    assert one(spark, T.clean_generated(F.col("a")), a=' "a b"\n') == "a b"


def test_prefixes_and_choices(spark):
    with pytest.raises(ValueError):
        T.prefixed(F.col("k"), F.col("t"), "", "")
    with pytest.raises(ValueError):
        T.embed_field(F.col("k"), F.col("t"), "title")
    assert one(spark, T.prefixed(F.col("k"), F.col("t"), "q: ", "p: "), k="query", t="x") == "q: x"


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("a"), "bigrams"), a="A b c") == ["ab", "bc"]
    assert one(spark, T.tokens(F.col("a"), "bigrams"), a="x") == []
    assert one(spark, T.tokens(F.col("a")), a=" A  b ") == ["a", "b"]


def test_vectors(spark):
    assert one(spark, V.unit(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, V.unit(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    df = spark.createDataFrame([(1, [3.0, 4.0, 0.0])], "id long, v array<double>")
    assert V.truncated(df, [2]).first().v == [0.6, 0.8]
    with pytest.raises(Exception, match="only 3 components"):
        V.truncated(df, [4]).collect()
    off = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.005])], "id long, v array<double>")
    assert V.force_normalized(off).where("id = 2").first().v == [0.0, 1.005]


def test_percentile_rules(spark):
    rows = spark.createDataFrame([(x,) for x in [5, 1, 9, 3, 7, 7]], "v int").withColumn("g", F.lit(1))
    got = P.order_statistics(rows, ["g"], "v", {"half": F.floor(F.col("n") / 2), "p9": P.plain_index(0.9), "all": P.clamped_index(1.0), "r": P.rounded_index(0.5)}).first()
    s = sorted([5, 1, 9, 3, 7, 7])
    assert (got.half, got.p9, got.all, got.r) == (s[3], s[int(6 * 0.9)], s[5], s[round(0.5 * 5)])


def test_limits(spark):
    assert [one(spark, P.over_limit(F.length("a"), 512), a="x" * n) for n in (665, 666)] == [False, True]


def test_rejects(spark):
    rows = spark.createDataFrame([(1, "food"), (2, "toys"), (3, None)], "id int, category string")
    got = P.rejects(rows, {"category": F.col("category").isin("food", "care"), "id": F.col("id") < 3}).collect()
    assert [r.broken for r in got] == ["", "category", "category,id"]


def test_lists_give_arrow_memory_back(monkeypatch):
    """What Arrow keeps of a batch is given back before the next one is read, and after the last."""
    import pyarrow as pa

    from gleanwork.functions import batches

    seen, pool = [], pa.default_memory_pool()
    monkeypatch.setattr(batches.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: (seen.append("back"), pool.release_unused())})())
    read = (seen.append("read") or pa.RecordBatch.from_arrays([pa.array(["a b", None, "c"])], names=["text"]) for _ in range(2))
    assert [t for _, (t,) in batches.lists(read, ["text"], "text", 4)] == [["a b", None, "c"]] * 2
    assert seen == ["read", "back", "read", "back", "back"]
