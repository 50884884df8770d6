import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanwork.sources import io
from gleanwork.sources import waves
from gleanwork.streaming import ingest as S
from gleanwork.streaming.ingest import ingest


def record(dept, text):
    return json.dumps({"meta": {"lifeCycle": "성견", "department": dept, "disease": None}, "qa": {"instruction": "", "input": text, "output": "답"}}, ensure_ascii=False, indent=2)


def test_zips(spark, tmp_path):
    for split, name in (("Training", "TL_질의응답_내과"), ("Validation", "VL_질의응답_외과"), ("Training", "TS_말뭉치_내과")):
        folder = tmp_path / split
        folder.mkdir(exist_ok=True)
        with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
            body = json.dumps({"disease": "긴 글", "title": "책"}, ensure_ascii=False) if name[1] == "S" else record(" 내과", f"{split} 질문?")
            z.writestr(f"{name[:2]}/id-{split}-{name[:2]}.json", "﻿" + body)
    got = sorted(io.read_qa_zips(spark, str(tmp_path)).collect())
    assert [(r.id, r.split, r.dept_from_filename, r.department, r.content) for r in got] == [("id-Training-TL", "Training", "내과", " 내과", "Training 질문?"), ("id-Validation-VL", "Validation", "외과", " 내과", "Validation 질문?")]
    assert [(r.id, r.text, r.author) for r in io.read_corpus_zips(spark, str(tmp_path)).collect()] == [("id-Training-TS", "긴 글", None)]


def test_a_zip_is_read_by_many_tasks(spark, tmp_path):
    """Ranges of members from the central directory; an archive's content is never a column; the same rows as reading it whole."""
    with zipfile.ZipFile(tmp_path / "TL_x_y.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(300):
            z.writestr(f"d/id-{i}.json" if i % 50 else f"d/skip-{i}.txt", record("dept", f"text {i} " * (i % 7)))
    with zipfile.ZipFile(tmp_path / "TL_none.zip", "w") as z:
        z.writestr("only.txt", "x")
    cuts = sorted(map(tuple, io.member_ranges(io._archives(spark, str(tmp_path), ("TL_",)).select("path"), 3000).collect()))
    assert len(cuts) > 10 and sum(n for _, _, n in cuts) == 294 and [s for _, s, _ in cuts] == [sum(n for _, _, n in cuts[:k]) for k in range(len(cuts))]
    rows = io.unzipped(spark, str(tmp_path), ("TL_",), 3000)
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString()
    by_task = rows.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n")).collect()
    assert len(by_task) > 3 and max(r.n for r in by_task) < 294
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, io.unzipped_whole(spark, str(tmp_path), ("TL_",)).collect()))


def test_folder_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "abc.json").write_text("﻿" + record("외과", "질문"), encoding="utf-8")
    row = io.read_qa_folder(spark, str(tmp_path)).first()
    assert (row.id, row.department, row.content) == ("abc", "외과", "질문")


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "한글\n줄"), (2, None)], "id long, text string")
    io.write_jsonl(rows, str(tmp_path / "x"))
    assert sorted(io.read_jsonl(spark, str(tmp_path / "x"), "id long, text string").collect()) == sorted(rows.collect())


def test_shards(spark, tmp_path):
    path = str(tmp_path / "arm")
    old = spark.createDataFrame([("doc", "1", [1.0], "m", 1, "", "")], io.EMBEDDING.rsplit(", ", 1)[0])
    io.write_shards(old, path)
    io.write_shards(spark.createDataFrame([("doc", str(i), [1.0], "m", 1, "", "", 512) for i in range(5)], io.EMBEDDING), path, 2)
    got = io.read_shards(spark, path)
    assert got.count() == 6 and got.where("max_seq_len is null").count() == 1


def test_ranks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, "d", True, 3), ("a", 1, "d", True, 2), ("a", 2, "e", False, 7)], "arm string, gold long, department string, orig_is_multi boolean, rank long")
    io.write_ranks(io.wide_ranks(rows, ["b", "a"]), str(tmp_path / "r"))
    back = io.read_ranks(spark, str(tmp_path / "r"))
    assert back.columns == ["answer_id", "department", "orig_is_multi", "b", "a"]
    assert sorted(map(tuple, io.long_ranks(back, ["a", "b"]).collect())) == [("1", "a", 2), ("1", "b", 3), ("2", "a", 7)]
    with pytest.raises(ValueError):
        io.long_ranks(back, ["c"])


def test_runs(spark, tmp_path):
    for name, version in (("r2", 1), ("r1", 1), ("r0", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"schema_version": version, "experiment_id": name, "arms": [{"arm_id": "x", "metrics": {"Hit@1": 0.5, "MRR": 0.6, "n": 3}}]}, indent=1))
    got = io.read_runs(spark, str(tmp_path)).collect()
    assert [r.experiment_id for r in got] == ["r1", "r2"] and got[0].arms[0].metrics["Hit@1"] == 0.5 and got[0].title is None
    (tmp_path / "bad.json").write_text('{"schema_version": 1, "experi')
    with pytest.raises(Exception, match="bad.json"):
        io.read_runs(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("files", [1, 3])
def test_several_runs_are_read_again(spark, tmp_path, files):
    """Three records in one file and in three; a run that is written again keeps what people wrote, in all records."""
    runs = spark.createDataFrame([(1, x, f"by hand {x}" if x != "b" else None) for x in "abc"], "schema_version int, experiment_id string, title string").repartitionByRange(files, "experiment_id")
    io.write_runs(runs.coalesce(files), None, f"{tmp_path}/x")
    back = io.read_runs(spark, f"{tmp_path}/x")
    assert [(r.experiment_id, r.title, r.question) for r in back.collect()] == [("a", "by hand a", None), ("b", None, None), ("c", "by hand c", None)]
    io.write_runs(runs.withColumn("title", F.lit("default")), back, f"{tmp_path}/y")
    assert [r.title for r in io.read_runs(spark, f"{tmp_path}/y").collect()] == ["by hand a", "default", "by hand c"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type").limit(300).cache()
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(source)
    ingest(spark, source, events.schema, target, checkpoint, "event_id")
    events.coalesce(1).write.mode("append").parquet(source)  # half of it is known
    ingest(spark, source, events.schema, target, checkpoint, "event_id")
    ingest(spark, source, events.schema, target, checkpoint, "event_id")
    assert sorted(S.ingested(spark, target).collect()) == sorted(events.collect())


def test_replays_late_repeats_and_files_read(spark, tmp_path):
    """Batches of few keys read their own folders only; a lost checkpoint replays all and changes nothing; repeats early and late are dropped."""
    schema = "id long, at timestamp, site string, body string"
    rows = lambda ids, hour, body: spark.createDataFrame([(i, f"2026-01-01 {hour:02d}:00:00", None if i is None else f"s{i % 2}", body) for i in ids], "id long, at string, site string, body string").selectExpr("id", "timestamp(at) as at", "site", "body").coalesce(1)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda checkpoint: ingest(spark, source, schema, target, str(tmp_path / checkpoint), "id", 1, "at", "site", "2 hours", 16)
    rows(range(40), 1, "first").write.mode("append").parquet(source)
    first = run("a")
    assert first[0]["files"] == [] and len(first[0]["buckets"]) > 8
    rows([3, 3, 100], 2, "early repeat").write.mode("append").parquet(source)
    rows([3, 7, 101, None], 9, "late repeat").write.mode("append").parquet(source)
    later = [b for b in run("a") if b["buckets"]]
    assert later and all(len(b["buckets"]) <= 3 and len(b["files"]) <= 3 * 3 for b in later)
    assert all(any(f"bucket={k}/" in f for k in b["buckets"]) for b in later for f in b["files"])
    want = {i: "first" for i in range(40)} | {100: "early repeat", 101: "late repeat"}
    got = S.ingested(spark, target).collect()
    assert {r.id: r.body for r in got} == want and len(got) == len(want)
    raw = spark.read.parquet(f"{target}-raw").count()
    seen = {r.source: r.last_seen.hour for r in S.last_seen(spark, target).collect()}
    assert raw == 47 and seen == {"s0": 2, "s1": 9, None: 9}
    run("b")  # from the beginning, into the same target
    assert {r.id: r.body for r in S.ingested(spark, target).collect()} == want and S.ingested(spark, target).count() == len(want)
    assert spark.read.parquet(f"{target}-raw").count() == raw and {r.source: r.last_seen.hour for r in S.last_seen(spark, target).collect()} == seen


SETTINGS = {"model_name": "m", "dim": 4, "query_prefix": "q: ", "passage_prefix": "", "max_seq_len": None}


def letters(fail_on=None, never=()):
    """A factory of encoders that count four letters; fails on a text, or where a text is seen that was done before."""

    def factory():
        def encode(texts):
            if any(fail_on is not None and t.endswith(fail_on) for t in texts) or set(texts) & set(never):
                raise RuntimeError("killed")
            return [[t.count(c) for c in "aeio"] for t in texts]

        return encode

    return factory


def test_a_killed_run_goes_on(spark, tmp_path):
    root = str(tmp_path / "arm")
    items = spark.createDataFrame([("doc", str(i), "a" * (i % 50) + f" text {i}") for i in range(120)] + [("query", "7", "what"), ("query", "7", "zz"), ("doc", "x", None), ("doc", None, "no id")], "kind string, id string, text string")
    late = items.where("kind = 'doc' and id != 'x' and pmod(xxhash64(id, kind), 6) = 3").first().text
    with pytest.raises(Exception, match="killed"):
        waves.encode_into(root, items, letters(fail_on=late), SETTINGS | {"run": 1}, waves=6, partitions=2)
    digest = waves.settings_digest(SETTINGS | {"run": 1})
    before = waves.committed(spark, root, io.EMBEDDING, digest)
    done = {r.id for r in before.where("kind = 'doc'").collect()}
    spark.createDataFrame([("doc", "0", [1.0], "m", 1, "", "", None)], io.EMBEDDING).write.parquet(f"{root}/parts/left-behind")
    texts = {f"{'a' * (int(i) % 50)} text {i}" for i in done if i != "x"}
    waves._made.clear()
    new = waves.encode_into(root, items, letters(never=texts), SETTINGS | {"run": 1}, waves=6, partitions=2)
    rows = waves.committed(spark, root, io.EMBEDDING, digest).collect()
    keys = [(r.kind, r.id) for r in rows]
    assert len(keys) == len(set(keys)) == 122 and new == 122 - before.count() and 0 < len(done) < 121
    v = {k: r.embedding for k, r in zip(keys, rows, strict=True)}
    assert v["query", "7"] == pytest.approx([1.0, 0, 0, 0]) and v["doc", "x"] == [0.0] * 4
    assert waves.encode_into(root, items, letters(fail_on=""), SETTINGS | {"run": 1}, waves=2, partitions=2) == 0
    assert waves.committed(spark, root, io.EMBEDDING, waves.settings_digest(SETTINGS)).count() == 0


def test_only_missing_arms_are_computed(spark, tmp_path):
    root, asked = str(tmp_path / "ranks"), []

    def compute(names):
        asked.append(sorted(names))
        return spark.createDataFrame([(n, g, len(asked)) for n in names for g in range(3)], "arm string, gold long, rank int")

    arms = {"a": {"k": 20}, "b": {"k": 20, "dim": 64}}
    read = lambda: {(r.arm, r.gold): r["rank"] for r in waves.reused(spark, root, arms, compute, "arm string, gold long, rank int").collect()}
    assert read() == read() and asked == [["a", "b"]]
    arms["b"] = {"k": 20, "dim": 32}
    got = read()
    assert asked == [["a", "b"], ["b"]] and got["a", 0] == 1 and got["b", 2] == 2 and len(got) == 6


def test_a_run_as_baseline(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "d", 1, 3, None), ("q2", None, 0, None, 2)], "answer_id string, department string, orig_is_multi int, `E-7` int, other int")
    io.write_ranks(rows, f"{tmp_path}/first/ranks.csv")
    assert [tuple(r) for r in io.baseline_ranks(spark, str(tmp_path), "first:E-7").collect()] == [("first", "E-7", "q1", 3)]
    for spec, why in (("first", "run:arm"), ("first:none", "no arm")):
        with pytest.raises(ValueError, match=why):
            io.baseline_ranks(spark, str(tmp_path), spec)


def test_shards_of_two_settings(spark, tmp_path):
    rows = spark.createDataFrame([("doc", "1", [1.0], "m", 1, "", "", None)], io.EMBEDDING)
    io.write_shards(rows, str(tmp_path / "a"))
    assert io.read_arm(spark, str(tmp_path / "a")).count() == 1
    io.write_shards(rows.withColumn("max_seq_len", F.lit(0)), str(tmp_path / "a"))
    with pytest.raises(ValueError, match="different settings"):
        io.read_arm(spark, str(tmp_path / "a"))


def test_run_records(spark, tmp_path):
    """Nulls stay nulls, people's words survive, and what is written is read again."""
    ranks = spark.createDataFrame([("a", 1, True, "d"), ("a", 6, False, "d"), ("a", 2, None, "e")], "arm string, rank int, orig_is_multi boolean, department string")
    arms = io.arm_records(ranks).agg(F.collect_list("record").alias("arms"))
    paired = "array(struct(struct('r' as run, 'b' as arm_id) as base, 'a' as arm_id, 3L as n, 0.5D as delta_mrr, array(0.1D, 0.9D) as ci95, 1L as win, 1L as lose, 1L as tie, 'v' as verdict))"
    run = arms.selectExpr("1 as schema_version", "'x' as experiment_id", "'new' as title", "map('gpu', 'none') as run_env", "named_struct('file', 'f', 'n_docs', 3L, 'embedded_field', 'content') as index", f"{paired} as paired_tests", "transform(arms, a -> named_struct('arm_id', a.arm_id, 'label', string(null), 'model', 'm', 'config', null, 'metrics', a.metrics, 'latency_ms', named_struct('search_p50', double(null), 'rerank_p50', double(null), 'e2e_p95', double(null)), 'groups', a.`groups`, 'depts', a.depts)) as arms")
    run = run.select(F.from_json(F.to_json(F.struct("*")), io.METRICS).alias("r")).select("r.*")
    old = spark.createDataFrame([("x", "title by hand", "")], "experiment_id string, title string, verdict string").withColumn("question", F.lit("why"))
    io.write_runs(run, old, f"{tmp_path}/x")
    got = io.read_runs(spark, f"{tmp_path}/x").first()
    assert (got.title, got.question, got.verdict, got.phase) == ("title by hand", "why", None, None)
    arm = got.arms[0]
    assert arm.metrics["Hit@5"] == pytest.approx(2 / 3) and arm.latency_ms.search_p50 is None
    assert arm.groups["multi"].n == 1 and arm.groups["single"]["Hit@5"] == 0 and set(arm.depts) == {"d", "e"} and arm.depts["d"].n == 2
    assert got.paired_tests[0].ci95 == [0.1, 0.9] and got.run_env == {"gpu": "none"}
