"""Queries over vectors and ranks: search, known-item ranks, metrics, comparison, reranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanwork.functions import text as T
from gleanwork.functions import vectors as V
from gleanwork.functions.staging import shared_dir
from gleanwork.operators import compare as C
from gleanwork.operators import maintenance as M
from gleanwork.operators import ranking as R
from gleanwork.plans import fixtures as X
from gleanwork.plans.fixtures import ARMS, ATTRIBUTED, EV, RANKS, VEC
from gleanwork.plans.registry import query
from gleanwork.sources import io, waves

ARM_IDS = ["d64", "d32", "d16"]
_SIM = f"{VEC}, sim as (select q.qid, q.label as qlabel, e.id, e.label, round(list_dot_product(q.v, e.v), 9) as sim from q, e)"
_TOP = lambda k, where="true", by="sim": f"top as (select *, row_number() over (partition by qid order by {by} desc, id) as pos from sim where {where} qualify pos <= {k})"


@query(f"with {_SIM} select qid, id, sim from sim")
def pairwise_sim(spark, sf):
    docs, queries = X.vectors(spark, sf)
    return R.pairwise(queries, docs)


@query(f"with {_SIM}, {_TOP(3)} select qid, id, sim, pos from top")
def cosine_topk(spark, sf):
    docs, queries = X.vectors(spark, sf)
    return R.top_k(queries, docs, 3)


@query(f"with {_SIM}, {_TOP(20)} select qid, id, sim, pos from top")
def candidates(spark, sf):
    docs, queries = X.vectors(spark, sf)
    return R.top_k(queries, docs, 20)


@query(f"with {_SIM}, {_TOP(5, 'label % 5 = qlabel % 5')} select qid, id, sim, pos from top")
def filtered_topk(spark, sf):
    """Only documents of the query's department are searched."""
    docs = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"), (F.col("label") % 5).alias("grp"))
    found = R.top_k(X.vectors(spark, sf)[1].withColumn("grp", F.col("label") % 5), docs, 5, ("grp",))
    return found.select("qid", "id", "sim", "pos")


_AB = """, a as (select 'all' as arm, qid, id, sim from sim union all select 'no_label_0', qid, id, sim from sim where label <> 0),
r as (select *, row_number() over (partition by arm, qid order by sim desc, id) as pos from a)"""


@query(f"with {_SIM} {_AB} select arm, count(*) as n, round(avg(sim), 9) as mean_sim from r where pos <= 5 group by 1")
def source_ab(spark, sf):
    """Search with and without the rows of one origin, in one pass."""
    docs = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"), F.explode(F.when(F.col("label") != 0, F.array(F.lit("all"), F.lit("no_label_0"))).otherwise(F.array(F.lit("all")))).alias("arm"))
    queries = X.vectors(spark, sf)[1].withColumn("arm", F.explode(F.array(F.lit("all"), F.lit("no_label_0"))))
    both = R.top_k(queries, docs, 5, ("arm",))
    return both.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 9).alias("mean_sim"))


@query(f"with {RANKS} select arm, qid, gold, rank from ranks")
def known_item_rank(spark, sf):
    return X.ranks(spark, sf)


_METRICS = "round(avg((rank <= 1)::int), 9) as hit1, round(avg((rank <= 5)::int), 9) as hit5, round(avg((rank <= 20)::int), 9) as hit20, round(avg(1.0 / rank), 9) as mrr, count(*) as n"


@query(f"with {RANKS} select arm, {_METRICS} from ranks group by 1")
def hit_mrr(spark, sf):
    return C.metrics(X.ranks(spark, sf), "arm")


@query(f"with {ATTRIBUTED} select arm, orig_is_multi, round(avg((rank <= 5)::int), 9) as hit5, round(avg(1.0 / rank), 9) as mrr, count(*) as n from attr where orig_is_multi is not null group by 1, 2")
def hit_mrr_groups(spark, sf):
    return C.metrics(X.attributed(spark, sf).where("orig_is_multi is not null"), "arm", "orig_is_multi", ks=(5,))


@query(f"with {ATTRIBUTED} select arm, department, round(avg((rank <= 5)::int), 9) as hit5, count(*) as n from attr group by 1, 2")
def hit_by_dept(spark, sf):
    return C.metrics(X.attributed(spark, sf), "arm", "department", ks=(5,)).drop("mrr")


_GAP = f"""with {ATTRIBUTED}, g as (select arm, avg((rank <= 5)::int) filter (where orig_is_multi) - avg((rank <= 5)::int) filter (where not orig_is_multi) as gap from attr group by 1)
select g.arm, round(g.gap, 9) as gap, round(g.gap - b.gap, 9) as recovery from g, (select gap from g where arm = 'd64') b"""


@query(_GAP)
def group_gap(spark, sf):
    """Hit@5 of compound questions less that of single ones, and its change against the first arm."""
    hit5, multi = (F.col("rank") <= 5).cast("double"), F.col("orig_is_multi")
    gaps = X.attributed(spark, sf).groupBy("arm").agg((F.avg(F.when(multi, hit5)) - F.avg(F.when(~multi, hit5))).alias("gap"))
    base = gaps.where("arm = 'd64'").select(F.col("gap").alias("base"))
    return gaps.crossJoin(F.broadcast(base)).select("arm", F.round("gap", 9).alias("gap"), F.round(F.col("gap") - F.col("base"), 9).alias("recovery"))


def _base(spark, sf):
    """Every arm against d64, and d64 against d32: an arm's own baseline, or that of '*'."""
    ranks = X.ranks(spark, sf)
    named = spark.createDataFrame([("d64", "d32"), ("*", "d64")], "arm string, base_arm string")
    arms = ranks.select("arm").distinct()
    star = named.where("arm = '*'").select(F.col("base_arm").alias("general"))
    of_arm = arms.join(F.broadcast(named), "arm", "left").crossJoin(F.broadcast(star)).select("arm", F.coalesce("base_arm", "general").alias("base_arm"))
    return ranks, of_arm, of_arm.join(ranks.withColumnRenamed("arm", "base_arm").select("base_arm", "gold", "rank"), "base_arm")


_BASED = f"{RANKS}, base as (select arm, case arm when 'd64' then 'd32' else 'd64' end as base_arm from (select distinct arm from ranks)), pairs as (select b.base_arm, r.arm, r.gold, r.rank, o.rank as base_rank from ranks r join base b on b.arm = r.arm join ranks o on o.arm = b.base_arm and o.gold = r.gold where r.arm <> b.base_arm)"


@query(f"with {_BASED} select arm, base_arm from base")
def per_arm_baseline(spark, sf):
    return _base(spark, sf)[1]


_PAIRED = "select base_arm, arm, count(*) as n, round(avg(1.0 / rank - 1.0 / base_rank), 9) as delta_mrr, count(*) filter (where rank < base_rank) as win, count(*) filter (where rank > base_rank) as lose, count(*) filter (where rank = base_rank) as tie from pairs group by 1, 2"


@query(f"with {_BASED} {_PAIRED}")
def paired_compare(spark, sf):
    """An arm without a common query would be an error."""
    ranks, _, base = _base(spark, sf)
    return C.common_or_fail(ranks, base)


_BOOT = f"""with {_BASED}, d as (select base_arm, arm, row_number() over (partition by base_arm, arm order by gold) - 1 as i, count(*) over (partition by base_arm, arm) as n, 1.0::double / rank - 1.0::double / base_rank as d from pairs),
r as (select unnest(range(2000)) as r), draws as (select a.base_arm, a.arm, r.r, ('0x' || substr(md5(r.r || ':' || a.i), 1, 8))::bigint % a.n as i from d a, r),
m as (select base_arm, arm, r, avg(d.d) as m from draws join d using (base_arm, arm, i) group by 1, 2, 3),
edges as (select base_arm, arm, round(quantile_cont(m, 0.025), 9) as lo, round(quantile_cont(m, 0.975), 9) as hi from m group by 1, 2)
select *, case when lo <= 0 and hi >= 0 then 'no difference' when lo > 0 then 'other better' else 'base better' end as verdict from edges"""


@query(_BOOT)
def paired_bootstrap(spark, sf):
    """2,000 resamples drawn by hash, which SQL can repeat."""
    ranks, _, base = _base(spark, sf)
    pairs = ranks.join(base.withColumnRenamed("rank", "base_rank"), ["arm", "gold"]).where("arm != base_arm")
    return C.hash_bootstrap(pairs)


@query()
def paired_bootstrap_exact(spark, sf):
    """2,000 resamples of indices by a seeded generator a comparison; tested against plain numpy."""
    ranks, _, base = _base(spark, sf)
    pairs = ranks.join(base.withColumnRenamed("rank", "base_rank"), ["arm", "gold"]).where("arm != base_arm")
    return C.bootstrap_exact(pairs)


@query()
def paired_bootstrap_multinomial(spark, sf):
    """2,000 resamples over the distinct rank pairs; tested against plain resampling."""
    ranks, _, base = _base(spark, sf)
    pairs = ranks.join(base.withColumnRenamed("rank", "base_rank"), ["arm", "gold"]).where("arm != base_arm")
    return C.bootstrap(pairs)


@query(f"with {RANKS}, w as (select a.gold, 1.0 / a.rank - 1.0 / b.rank as before, 1.0 / (1 + (a.rank - 1) // 2) - 1.0 / (1 + (b.rank - 1) // 2) as after from ranks a join ranks b using (gold) where a.arm = 'd64' and b.arm = 'd16') select round(1 - avg(after) / avg(before), 9) as absorbed from w")
def gap_absorbed(spark, sf):
    """How much of the difference of two arms a second run (here: halved ranks) takes away."""
    ranks = X.ranks(spark, sf)
    halved = ranks.withColumn("rank", 1 + F.floor((F.col("rank") - 1) / 2))
    delta = lambda r: r.groupBy().agg((F.avg(F.when(F.col("arm") == "d64", 1 / F.col("rank"))) - F.avg(F.when(F.col("arm") == "d16", 1 / F.col("rank")))).alias("d"))
    before, after = delta(ranks).withColumnRenamed("d", "before"), delta(halved).withColumnRenamed("d", "after")
    return before.crossJoin(F.broadcast(after)).select(F.round(1 - F.col("after") / F.col("before"), 9).alias("absorbed"))


@query(f"with {RANKS}, m as (select arm, avg(1.0 / rank) as mrr from ranks group by 1), b as (select arm as base_arm from m order by mrr desc, arm limit 1), pairs as (select b.base_arm, r.arm, r.gold, r.rank, o.rank as base_rank from ranks r, b join ranks o on o.arm = b.base_arm where o.gold = r.gold and r.arm <> b.base_arm) {_PAIRED}")
def auto_baseline(spark, sf):
    """Without a named baseline it is the arm with the best MRR."""
    ranks = X.ranks(spark, sf)
    best = C.best_by(C.metrics(ranks, "arm").withColumn("run", F.lit(1)), ["run"], "mrr", "arm").select(F.col("arm").alias("base_arm"))
    base = ranks.select("arm").distinct().crossJoin(F.broadcast(best)).join(ranks.withColumnRenamed("arm", "base_arm").select("base_arm", "gold", "rank"), "base_arm")
    return C.paired(ranks, base)


@query(f"with {ATTRIBUTED}, m as (select department, arm, round(avg(1.0 / rank), 9) as mrr from attr group by 1, 2) select department, arm from m qualify row_number() over (partition by department order by mrr desc, arm) = 1")
def best_arm(spark, sf):
    """Per department, standing in for runs."""
    return C.best_by(C.metrics(X.attributed(spark, sf), "department", "arm"), ["department"], "mrr", "arm")


@query(f"with {_BASED}, p as ({_PAIRED}), m as (select arm, {_METRICS} from ranks group by 1) select m.arm, m.mrr, m.n, p.base_arm, p.delta_mrr, p.win, p.lose, p.tie from m left join p using (arm)")
def arm_report(spark, sf):
    ranks, _, base = _base(spark, sf)
    tests = C.paired(ranks, base).drop("n")
    return C.metrics(ranks, "arm").join(tests, "arm", "left").select("arm", "mrr", "n", "base_arm", "delta_mrr", "win", "lose", "tie")


_EXPLORE = f"{ATTRIBUTED}, x as (select a.gold, a.department, a.orig_is_multi, b.rank as base, a.rank as cmp from attr a join ranks b using (gold) where a.arm = 'd16' and b.arm = 'd64')"


def _explorer(spark, sf):
    rows = X.attributed(spark, sf)
    base = rows.where("arm = 'd64'").select("gold", F.col("rank").alias("base"))
    return rows.where("arm = 'd16'").select("gold", "department", "orig_is_multi", F.col("rank").alias("cmp")).join(base, "gold")


@query(f"with {_EXPLORE} select gold, department, base, cmp from x where orig_is_multi and cmp > base and cmp > 5")
def rank_explorer(spark, sf):
    """Compound questions that got worse and are not among the first five."""
    worse = C.explored(_explorer(spark, sf), True, show="worse")
    return C.explored(worse, show="miss").select("gold", "department", "base", "cmp")


@query(f"with {_EXPLORE} select count(*) filter (where cmp > base) as worse, count(*) filter (where cmp < base) as better, count(*) filter (where cmp = base) as tie from x where not orig_is_multi")
def rank_explorer_counts(spark, sf):
    n = lambda c: F.sum(F.expr(c).cast("long"))
    return C.explored(_explorer(spark, sf), False).agg(n("cmp > base").alias("worse"), n("cmp < base").alias("better"), n("cmp = base").alias("tie"))


@query(f"with {_EXPLORE} select gold, base, cmp, cmp - base as change from x order by change desc, gold limit 200")
def rank_changes(spark, sf):
    return _explorer(spark, sf).select("gold", "base", "cmp", (F.col("cmp") - F.col("base")).alias("change")).orderBy(F.desc("change"), "gold").limit(200)


@query("with a as (select label as arm, count(*) as n from embeddings group by 1) select arm, n from a where n > 1")
def arm_dups(spark, sf):
    return C.unique_or_fail(X.table(spark, sf, "embeddings").select(F.col("label").alias("arm")), "arm")


@query(f"with {ATTRIBUTED} select gold as answer_id, department, orig_is_multi::int as orig_is_multi, max(rank) filter (where arm = 'd64') as d64, max(rank) filter (where arm = 'd32') as d32, max(rank) filter (where arm = 'd16') as d16 from attr group by 1, 2, 3")
def ranks_wide(spark, sf):
    return io.wide_ranks(X.attributed(spark, sf), ARM_IDS)


@query(f"with {RANKS} select gold as answer_id, arm, rank from ranks where arm <> 'd16'")
def ranks_long(spark, sf):
    return io.long_ranks(io.wide_ranks(X.attributed(spark, sf), ARM_IDS), ["d64", "d32"])


_MERGE = f"""with {RANKS}, new as (select arm, 'default title' as title, round(avg(1.0 / rank), 9) as mrr from ranks where arm <> 'd16' group by 1),
old as (select arm, case when arm = 'd16' then '' else 'title of ' || arm end as title, count(*)::double as mrr from ranks where arm <> 'd32' group by 1)
select coalesce(n.arm, o.arm) as arm, case when o.title <> '' then o.title else n.title end as title, case when n.arm is null then o.mrr else n.mrr end as mrr from new n full join old o on n.arm = o.arm"""


@query(_MERGE)
def metrics_merge(spark, sf):
    """A rewritten run keeps the titles that people gave it, against its own default; an empty one does not count."""
    ranks = X.ranks(spark, sf)
    new = ranks.where("arm != 'd16'").groupBy("arm").agg(F.lit("default title").alias("title"), F.round(C.mrr(), 9).alias("mrr"))
    old = ranks.where("arm != 'd32'").groupBy("arm").agg(F.count("*").cast("double").alias("mrr")).select("arm", F.when(F.col("arm") == "d16", "").otherwise(F.concat(F.lit("title of "), "arm")).alias("title"), "mrr")
    return M.merged_metrics(old, new, "arm", ["title"])


@query("with e as (select sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings) select round(min(n), 6) as least, round(max(n), 6) as most, bool_and(abs(n - 1) <= 0.01) as ok from e")
def norm_check(spark, sf):
    n = V.norm(V.doubles(F.col("embedding")))
    return X.table(spark, sf, "embeddings").agg(F.round(F.min(n), 6).alias("least"), F.round(F.max(n), 6).alias("most"), F.bool_and(F.abs(n - 1) <= 0.01).alias("ok"))


@query(f"with {ARMS} select arm, id, len(v)::int as width, round(v[1], 9) as first, round(list_sum(v), 9) as total from ad")
def truncate_arms(spark, sf):
    docs, _ = X.arms(spark, sf)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return docs.select("arm", "id", F.size("v").alias("width"), F.round(F.col("v")[0], 9).alias("first"), F.round(total, 9).alias("total"))


@query("with e as (select vec_id as id, list_transform(embedding::double[], lambda x: case when vec_id = 3 then 2 * x else x end) as v from embeddings), n as (select id, v, sqrt(list_dot_product(v, v)) as n, max(abs(sqrt(list_dot_product(v, v)) - 1)) over () as off from e) select id, round(v[1] / case when off > 0.01 then greatest(n, 1e-9) else 1 end, 9) as first from n")
def force_normalize(spark, sf):
    """One vector of double length makes all be normalized."""
    docs, _ = X.vectors(spark, sf)
    off = docs.withColumn("v", F.when(F.col("id") == 3, F.transform("v", lambda x: 2 * x)).otherwise(F.col("v")))
    return V.force_normalized(off).select("id", F.round(F.col("v")[0], 9).alias("first"))


@query("""select distinct label as arm, sha1('{"k": 20, "label": ' || label || '}') as fingerprint from embeddings""")
def run_fingerprint(spark, sf):
    labels = X.table(spark, sf, "embeddings").select(F.col("label").alias("arm")).distinct()
    return labels.select("arm", F.coalesce(*(F.when(F.col("arm") == n, T.fingerprint({"label": n, "k": 20})) for n in range(10))).alias("fingerprint"))


@query(f"with {RANKS} select arm, gold, rank from ranks")
def reused_ranks(spark, sf):
    """The first run stores one arm under the digest of its settings; the second reads it and computes the two others."""
    root, schema = f"{shared_dir(spark)}/ranks-{uuid.uuid4().hex}", "arm string, gold long, rank long"
    arms = {a: {"dim": int(a[1:]), "k": 20} for a in ARM_IDS}
    compute = lambda names: X.ranks(spark, sf, names).select("arm", "gold", "rank")
    waves.reused(spark, root, {"d64": arms["d64"]}, compute, schema)
    return waves.reused(spark, root, arms, compute, schema)


_PAYLOADS = "doc as (select vec_id as id, 'answer ' || (vec_id // 4) as payload, 's' || (vec_id % 6) as source, 'text ' || label || ' ' || (vec_id % 7) || ' ' || (vec_id // 90) as body from embeddings)"


def _docs(spark, sf):
    d = F.col("vec_id")
    return X.table(spark, sf, "embeddings").select(
        d.alias("id"), F.concat(F.lit("answer "), F.floor(d / 4).cast("string")).alias("payload"), F.concat(F.lit("s"), (d % 6).cast("string")).alias("source"),
        F.concat_ws(" ", F.lit("text"), F.col("label").cast("string"), (d % 7).cast("string"), F.floor(d / 90).cast("string")).alias("body"),
    )


_CAND = f"{_SIM}, {_PAYLOADS}, {_TOP(20)}, cand as (select t.qid, t.id, t.sim, t.pos, d.payload, d.source, d.body from top t join doc d using (id))"


def _candidates(spark, sf):
    return candidates(spark, sf).join(_docs(spark, sf), "id")


@query(f"with {_CAND}, f as (select *, row_number() over (partition by qid, payload order by sim desc, id) as n from cand) select * from (select qid, id, payload, row_number() over (partition by qid order by sim desc, id) as pos from f where n = 1) where pos <= 5")
def payload_dedup(spark, sf):
    return R.one_per(_candidates(spark, sf), F.sha2("payload", 256), 5).select("qid", "id", "payload", "pos")


@query(f"with {_CAND}, f as (select *, row_number() over (partition by qid, source order by sim desc, id) as n from cand) select * from (select qid, id, source, row_number() over (partition by qid order by sim desc, id) as pos from f where n <= 2) where pos <= 10")
def source_cap(spark, sf):
    return R.one_per(_candidates(spark, sf), F.col("source"), 10, each=2).select("qid", "id", "source", "pos")


@query(f"with {_CAND}, p as (select qid, payload as parent, max(sim) as sim from cand group by 1, 2) select qid, parent, sim, row_number() over (partition by qid order by sim desc, parent) as pos from p qualify pos <= 5")
def parent_child(spark, sf):
    """Each parent once, with its best child's similarity."""
    best = _candidates(spark, sf).groupBy("qid", F.col("payload").alias("parent")).agg(F.max("sim").alias("sim"))
    return R.positioned(best, ["qid"], [F.desc("sim"), F.col("parent")], 5)


@query(f"with {_CAND} select qid, string_agg(payload, chr(10) order by pos) as context from cand where pos <= 3 group by 1")
def context(spark, sf):
    return R.context(_candidates(spark, sf), 3)


_EVQ = "evq as (select answer_id as qid, 'text ' || split_part(query, '-', 2) || ' ' || split_part(substr(query, 2), '-', 1) as query_text from ev)"


def _query_texts(spark, sf):
    q = F.col("query")
    return X.evalset(spark, sf).select(F.col("answer_id").alias("qid"), F.concat_ws(" ", F.lit("text"), F.split(q, "-")[1], F.split(F.substring(q, 2, 100), "-")[0]).alias("query_text"))


@query(f"with {_CAND}, {EV}, {_EVQ} select c.qid, c.id, c.pos, query_text, coalesce(body, '') as text from cand c join evq using (qid)")
def rerank_pairs(spark, sf):
    rows = candidates(spark, sf).join(_docs(spark, sf).select("id", "body"), "id", "left").join(_query_texts(spark, sf), "qid")
    return rows.select("qid", "id", "pos", "query_text", F.coalesce("body", F.lit("")).alias("text"))


_WORDS = lambda c: f"list_distinct(string_split({c}, ' '))"
_SCORED = f"""{_CAND}, {EV}, {_EVQ}, scored as (select c.qid, c.id, c.pos, round(len(list_intersect({_WORDS('query_text')}, {_WORDS('body')})) / len({_WORDS('query_text')}), 9) as score from cand c join evq using (qid))"""


@query(f"with {_SCORED} select qid, id, pos, score from scored")
def rerank_job(spark, sf):
    from gleanwork.operators.models import overlap_scorer, score_pairs

    return score_pairs(rerank_pairs(spark, sf), overlap_scorer).select("qid", "id", "pos", "score")


_RERANK = f"""with {_SCORED}, placed as (select *, row_number() over (partition by qid order by score desc, pos) as place from scored),
twins as (select distinct a.answer_id as gold, b.answer_id as twin from ev a join ev b on a.query = b.query and a.answer_id <> b.answer_id),
g as (select sim.qid, sim.sim as gs from sim where sim.id = sim.qid),
base as (select s.qid, 1 + count(*) filter (where s.sim > g.gs and t.twin is null) as rank from sim s join g using (qid) left join twins t on t.gold = s.qid and t.twin = s.id group by 1),
mine as (select b.qid, b.rank, p.place from base b left join placed p on p.qid = b.qid and p.id = b.qid)
select m.qid, m.qid as gold, case when m.place is null then m.rank else 1 + (select count(*) from placed p where p.qid = m.qid and p.place < m.place and not exists (select 1 from twins t where t.gold = m.qid and t.twin = p.id)) end as rank from mine m"""


@query(_RERANK)
def rerank_rank(spark, sf):
    docs, queries = X.vectors(spark, sf)
    texts = R.gold_texts(X.evalset(spark, sf))
    base = R.known_item_ranks(queries.select("qid", "gold", "v"), docs, texts=texts)
    return R.candidate_ranks(rerank_job(spark, sf), base, texts)


@query(f"with {_SCORED}, l as (select qid, id, pos from top where pos <= 20 union all select qid, id, row_number() over (partition by qid order by score desc, pos) from scored), s as (select qid, id, round(sum(1.0::double / (60 + pos)), 12) as score from l group by 1, 2) select qid, id, score, row_number() over (partition by qid order by score desc, id) as pos from s qualify pos <= 20")
def rrf(spark, sf):
    """The vector list and the list by word overlap of the same candidates."""
    first = candidates(spark, sf)
    second = R.positioned(rerank_job(spark, sf), ["qid"], [F.desc("score"), F.col("pos")], name="place").select("qid", "id", F.col("place").alias("pos"))
    return R.fused([first, second])


@query(f"with {_SIM} select qid, max(sim) as best from sim where id <> qid group by 1 having max(sim) < 0.55")
def coverage_gap(spark, sf):
    """Queries whose best other document stays under a threshold."""
    docs, queries = X.vectors(spark, sf)
    best = R.top_k(queries, docs, 2).where("id != qid").groupBy("qid").agg(F.max("sim").alias("best"))
    return best.where("best < 0.55")


@query(f"with {_SCORED} select case when d.source in ('s0', 's1') then 'first' else 'rest' end as mix, round(avg((score >= 0.6)::int), 9) as mean, count(*) as n from scored s join doc d on d.id = s.id where pos <= 5 group by 1")
def judge_mean(spark, sf):
    """Mean 0/1 judgement of the first results by origin; the stand-in judge wants three fifths of the query's words."""
    from gleanwork.operators.models import judge, overlap_scorer

    mix = F.when(F.col("source").isin("s0", "s1"), "first").otherwise("rest").alias("mix")
    results = rerank_pairs(spark, sf).where("pos <= 5").withColumnRenamed("text", "context").join(_docs(spark, sf).select("id", "source"), "id")
    judged = judge(results, lambda q, c: overlap_scorer([q], [c])[0] >= 0.6)
    return judged.groupBy(mix).agg(F.round(F.avg("judgement"), 9).alias("mean"), F.count("*").alias("n"))


@query(f"with {VEC}, s as (select a.id, a.id // 100 as doc, round(list_dot_product(a.v, b.v), 9) as sim from e a left join e b on b.id = a.id - 1) select id, doc, sum(case when sim < 0.1 then 1 else 0 end) over (partition by doc order by id)::bigint as chunk from s")
def vector_breaks(spark, sf):
    """Rows in order of id, in documents of a hundred for the similarity to the row before; a break under 0.1."""
    from gleanwork.operators.chunking import breaks

    docs, _ = X.vectors(spark, sf)
    before = docs.select((F.col("id") + 1).alias("id"), F.col("v").alias("p"))
    rows = docs.join(before, "id", "left").select("id", F.floor(F.col("id") / 100).alias("doc"), F.round(V.dot(F.col("v"), F.col("p")), V.DIGITS).alias("sim"))
    return breaks(rows, ["doc"], "id", "sim", 0.1).select("id", "doc", "chunk")


@query(f"with {_SIM}, {_TOP(1)} select qid, id from top where id = qid")
def roundtrip_filter(spark, sf):
    """Queries that find their own document first."""
    docs, queries = X.vectors(spark, sf)
    return R.top_k(queries, docs, 1).where("id = qid").select("qid", "id")
