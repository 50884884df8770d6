"""Queries over the normalized corpus: cleaning, profile, integrity, evaluation set."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.functions import text as T
from gleanwork.operators import evalset as E
from gleanwork.operators import profile as P
from gleanwork.plans import fixtures as X
from gleanwork.plans.fixtures import EV, QA
from gleanwork.plans.registry import query

_NORM = "id, department, dept_from_filename, content, payload, split, life_cycle, disease, source, content_len, question_marks"
_COLUMNS = _NORM.split(", ")


@query(f"with {QA} select {_NORM} from kept")
def normalize(spark, sf):
    return X.kept(spark, sf).select(*_COLUMNS)


@query(f"with {QA} select {_NORM} from kept order by split, coalesce(department, ''), id")
def normalized_sorted(spark, sf):
    return X.kept(spark, sf).select(*_COLUMNS).orderBy("split", F.coalesce("department", F.lit("")), "id")


@query(f"with {QA} select id, split from norm where content = '' or payload = ''")
def skipped_empty(spark, sf):
    return P.empty_rows(X.norm(spark, sf)).select("id", "split")


@query(f"with {QA} select id, department, dept_from_filename from qa where department is distinct from dept_from_filename")
def meta_mismatch(spark, sf):
    """On the unstripped departments, which differ by a space in the stand-in."""
    return P.mismatched(X.qa(spark, sf), "department", "dept_from_filename").select("id", "department", "dept_from_filename")


@query(f"with {QA} select id, contains(content, 'tion') as hospital, contains(content, 'ing') as vet, regexp_matches(content, 'ment|lich|ci') as cost, regexp_matches(content, '[.]$') as question from kept")
def text_flags(spark, sf):
    """With patterns that occur in the stand-in."""
    c = F.col("content")
    flags = P.text_flags(c, c, "tion", "ing", "ment|lich|ci", "[.]$")
    return X.kept(spark, sf).select("id", *(f.alias(n) for n, f in flags.items()))


@query(f"with {QA} select id, content_len > 665 as content_512, content_len > 10649 as content_8192, content_len + length(payload) > 665 as both_512, content_len + length(payload) > 10649 as both_8192 from kept")
def over_limit(spark, sf):
    n, both = F.col("content_len"), F.col("content_len") + F.length("payload")
    return X.kept(spark, sf).select("id", P.over_limit(n, 512).alias("content_512"), P.over_limit(n, 8192).alias("content_8192"), P.over_limit(both, 512).alias("both_512"), P.over_limit(both, 8192).alias("both_8192"))


#: The stand-in's counterparts of endings, expressions and shifts.
_END, _EXPR, _SHIFT = "tion|ment|lich", "ing|eux|ung", "aber|mais|but"
_COUNTS = f"""counts as (select *, len(regexp_extract_all(content, '{_END}')) as endings, len(regexp_extract_all(content, '{_EXPR}')) as expressions, len(regexp_extract_all(content, '{_SHIFT}')) as shifts from kept)"""


def _rules(spark, sf):
    return P.with_compound_rules(X.kept(spark, sf), "content", _END, _EXPR, _SHIFT)


_RULE_SQL = {
    "endings3": "endings >= 3", "endings3_or_2long": "endings >= 3 or (endings = 2 and content_len >= 500)", "expressions3": "expressions >= 3", "expressions5": "expressions >= 5",
    "shifts1": "shifts >= 1", "long400": "content_len >= 400", "long400_or_expressions3": "content_len >= 400 or expressions >= 3",
}
_RULED = f"{QA}, {_COUNTS}, ruled as (select *, {', '.join(f'({c}) as {n}' for n, c in _RULE_SQL.items())} from counts)"


@query(f"with {_RULED} select id, {', '.join(_RULE_SQL)} from ruled")
def multi_rules(spark, sf):
    return _rules(spark, sf).select("id", *_RULE_SQL)


@query(f"with {_RULED} select id, content_len as orig_len, long400_or_expressions3 as orig_is_multi from ruled")
def multi_flag(spark, sf):
    return _rules(spark, sf).select("id", F.col("content_len").alias("orig_len"), F.col("long400_or_expressions3").alias("orig_is_multi"))


@query(f"with {_RULED} select id, content_len, endings, expressions from ruled where (content_len >= 600 and endings = 0) or (content_len < 250 and expressions >= 3)")
def rule_disagree(spark, sf):
    rows = _rules(spark, sf).where("(content_len >= 600 and endings = 0) or (content_len < 250 and expressions >= 3)")
    return rows.select("id", "content_len", "endings", "expressions")


@query(f"with {_RULED}, long as (select unnest([{', '.join(repr(n) for n in _RULE_SQL)}]) as flag, unnest([{', '.join(_RULE_SQL)}]) as v from ruled) select flag, count(*) filter (where v) as n, round(avg(v::int), 9) as rate from long group by 1")
def rule_rates(spark, sf):
    return P.rates(_rules(spark, sf), list(_RULE_SQL))


@query(f"with {_RULED} select case when expressions <= 1 then '<=1' when expressions = 2 then '2' when expressions = 3 then '3' else '>=4' end as bucket, count(*) as n, round(avg(case when content_len > 1000 then expressions end), 9) as mean_long from ruled group by 1")
def question_hist(spark, sf):
    e = F.col("expressions")
    bucket = F.when(e <= 1, "<=1").when(e == 2, "2").when(e == 3, "3").otherwise(">=4").alias("bucket")
    return _rules(spark, sf).groupBy(bucket).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("content_len") > 1000, e)), 9).alias("mean_long"))


_F1 = f"""with {_RULED}, t as (select r.*, quality = 1 as truth from ruled r join labels l on l.doc_id = r.id::bigint),
long as (select unnest([{', '.join(repr(n) for n in _RULE_SQL)}]) as rule, unnest([{', '.join(_RULE_SQL)}]) as p, truth as t from t),
s as (select rule, count(*) filter (where p and t) as tp, count(*) filter (where p and not t) as fp, count(*) filter (where not p and t) as fn from long group by 1)
select rule, case when tp + fp = 0 then 0.0 else round(tp / (tp + fp), 9) end as precision, case when tp + fn = 0 then 0.0 else round(tp / (tp + fn), 9) end as recall,
 case when 2 * tp + fp + fn = 0 then 0.0 else round(2 * tp / (2 * tp + fp + fn), 9) end as f1 from s"""


@query(_F1)
def rule_f1(spark, sf):
    rows = _rules(spark, sf).withColumn("doc_id", F.col("id").cast("long")).join(X.table(spark, sf, "labels"), "doc_id")
    return P.rule_quality(rows, list(_RULE_SQL), "quality")


@query(f"with {QA} select id, regexp_matches(content, 'the|und|les') as formal, content = payload as same, content_len > 120 as too_long, payload = '' as no_answer from norm")
def query_quality(spark, sf):
    flags = P.query_quality(F.col("content"), F.col("payload"), F.col("payload"), "the|und|les")
    return X.norm(spark, sf).select("id", *(f.alias(n) for n, f in flags.items()))


@query(f"with {QA}, items as (select 'query' as kind, id, content as text from kept where split = 'Validation' union all select 'doc', id, content from kept) select kind, id, case when kind = 'query' then 'query: ' else 'passage: ' end || text as text from items")
def prefixing(spark, sf):
    return embed_items(spark, sf).select("kind", "id", T.prefixed(F.col("kind"), F.col("text"), "query: ", "passage: ").alias("text"))


@query(f"with {QA} select 'query' as kind, id, content as text from kept where split = 'Validation' union all select 'doc', id, content from kept")
def embed_items(spark, sf):
    rows = X.kept(spark, sf)
    asked = rows.where("split = 'Validation'").select(F.lit("query").alias("kind"), "id", F.col("content").alias("text"))
    return asked.unionByName(rows.select(F.lit("doc").alias("kind"), "id", F.col("content").alias("text")))


@query(f"with {QA} select id, content as content_only, content || chr(10) || payload as both from kept")
def embed_field(spark, sf):
    c, p = F.col("content"), F.col("payload")
    return X.kept(spark, sf).select("id", T.embed_field(c, p, "content").alias("content_only"), T.embed_field(c, p, "content+payload").alias("both"))


@query(f"with {QA} select id, concat_ws(',', case when department in ('en', 'fr', 'de') then null else 'department' end, case when content <> '' then null else 'content' end, case when length(payload) between 8 and 10 then null else 'payload' end) as broken from norm")
def constraint_check(spark, sf):
    rules = {"department": F.col("department").isin("en", "fr", "de"), "content": F.col("content") != "", "payload": F.length("payload").between(8, 10)}
    return P.rejects(X.norm(spark, sf), rules).select("id", "broken")


@query("select conv_id, turn, coalesce(nullif(turn % 12, 0), 3) as top_k from conversations where length(text) between 1 and 1000 and coalesce(nullif(turn % 12, 0), 3) between 1 and 10")
def request_check(spark, sf):
    """Questions of 1 to 1000 characters with top_k of 1 to 10, 3 where none is given (here: turn mod 12 = 0)."""
    rows = X.table(spark, sf, "conversations")
    return P.valid_requests(rows, "text", F.nullif(F.col("turn") % 12, F.lit(0))).select("conv_id", "turn", "top_k")


def _splits(spark, sf):
    rows = X.kept(spark, sf)
    return rows.where("split = 'Validation'"), rows.where("split = 'Training'")


@query(f"with {QA} select id, department from kept v where split = 'Validation' and not exists (select 1 from kept t where t.split = 'Training' and t.content = v.content)")
def leak_free(spark, sf):
    return E.leak_free(*_splits(spark, sf)).select("id", "department")


@query(f"with {QA} select id, department from kept v where split = 'Validation' and exists (select 1 from kept t where t.split = 'Training' and t.content = v.content)")
def leaked(spark, sf):
    return E.leak_free(*_splits(spark, sf), leaked=True).select("id", "department")


@query(f"with {QA} select count(*) as n from (select content from kept where split = 'Validation' intersect select content from kept where split = 'Training')")
def leak_count(spark, sf):
    valid, train = _splits(spark, sf)
    return E.leak_free(valid, train, leaked=True).select(F.sha2("content", 256).alias("digest")).distinct().agg(F.count("*").alias("n"))


@query(f"with {QA} select kind, id from (select 'query' as kind, id from kept where split = 'Validation' union all select 'doc', id from kept) i where not exists (select 1 from kept k where k.id = i.id and i.kind = 'doc' and k.disease <> 'other')")
def resume_todo(spark, sf):
    """What is not embedded yet, where documents of a named disease are."""
    done = X.kept(spark, sf).where("disease != 'other'").select(F.lit("doc").alias("kind"), "id")
    return E.remaining(embed_items(spark, sf).select("kind", "id"), done, ["kind", "id"])


@query(f"with {EV} select distinct a.answer_id as gold, b.answer_id as twin from ev a join ev b on a.query = b.query and a.answer_id <> b.answer_id")
def twins(spark, sf):
    from gleanwork.operators.ranking import twin_pairs

    return twin_pairs(X.evalset(spark, sf))


_AUDIT = f"""with {QA}, {EV}, es as (select lpad(answer_id::varchar, 10, '0') as answer_id, query from ev),
c as (select content from kept group by 1 having count(*) > 1)
select 'duplicate_answer_id' as check, (select count(*) from (select answer_id from es group by 1 having count(*) > 1)) as n
union all select 'gold_missing', (select count(*) from es where answer_id not in (select id from kept))
union all select 'gold_not_validation', (select count(*) from kept where split <> 'Validation' and id in (select answer_id from es))
union all select 'duplicate_content', (select count(*) from kept where id in (select answer_id from es) and content in (select content from c))
union all select 'duplicate_query', (select count(*) from (select query from es group by 1 having count(*) > 1))"""


@query(_AUDIT)
def evalset_audit(spark, sf):
    asked = X.evalset(spark, sf).withColumn("answer_id", F.lpad(F.col("answer_id").cast("string"), 10, "0"))
    return E.audit(asked, X.kept(spark, sf))


@query(f"with {QA} select department, split, count(*) as n, grouping_id(department, split) as gid from kept group by cube (department, split)")
def dept_split_cube(spark, sf):
    return P.cross_tab(X.kept(spark, sf), "department", "split")


@query(f"with {QA} select count(*) - count(distinct content) as dup_content, count(*) - count(distinct payload) as dup_payload, count(*) - count(distinct id) as dup_id from kept")
def dup_counts(spark, sf):
    return P.duplicates(X.kept(spark, sf), ["content", "payload", "id"])


@query(f"with {QA} select disease, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from kept group by 1")
def category_share(spark, sf):
    return P.shares(X.kept(spark, sf), "disease")


@query(f"with {QA} select disease, n from (select disease, count(*) as n from kept group by 1 order by 2 desc, 1 limit 6) where disease <> 'other'")
def top_values(spark, sf):
    """The six most common first, and only then without the catch-all."""
    return X.kept(spark, sf).groupBy("disease").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "disease").limit(6).where("disease != 'other'")


_LEN = "s as (select department, content_len as v, row_number() over (partition by department order by content_len) - 1 as i, count(*) over (partition by department) as n from kept)"
_AT = lambda index, name: f"max(v) filter (where i = {index}) as {name}"


@query(f"with {QA}, {_LEN} select department, round(avg(v), 9) as mean, {_AT('n // 2', 'median')}, {_AT('floor(n * 0.9)', 'p90')}, max(v) as max from s group by 1")
def length_stats(spark, sf):
    rows = X.kept(spark, sf)
    at = P.order_statistics(rows, ["department"], "content_len", {"median": F.floor(F.col("n") / 2), "p90": P.plain_index(0.9)})
    return rows.groupBy("department").agg(F.round(F.avg("content_len"), 9).alias("mean"), F.max("content_len").alias("max")).join(at, "department").select("department", "mean", "median", "p90", "max")


@query(f"with {QA}, {_LEN} select department, {_AT('floor(n * 0.95)', 'plain')}, {_AT('least(floor(n * 1.0), n - 1)', 'clamped')}, {_AT('round_even(0.95 * (n - 1), 0)', 'rounded')}, round(quantile_cont(v, 0.95), 9) as linear from s group by 1")
def length_percentiles(spark, sf):
    rows = X.kept(spark, sf)
    rules = {"plain": P.plain_index(0.95), "clamped": P.clamped_index(1.0), "rounded": P.rounded_index(0.95)}
    linear = rows.groupBy("department").agg(F.round(F.percentile("content_len", F.lit(0.95)), 9).alias("linear"))
    return P.order_statistics(rows, ["department"], "content_len", rules).join(linear, "department")


@query(f"with {QA} select sum(content_len)::bigint as total, (sum(content_len) // 400)::bigint as chunks_400, (sum(content_len) // 800)::bigint as chunks_800, round((sum(content_len) // 400) / count(*), 9) as share from kept")
def chunk_estimate(spark, sf):
    total = F.sum("content_len")
    rows = X.kept(spark, sf).agg(total.alias("total"), F.count("*").alias("n"))
    return rows.select("total", F.floor(F.col("total") / 400).alias("chunks_400"), F.floor(F.col("total") / 800).alias("chunks_800"), F.round(F.floor(F.col("total") / 400) / F.col("n"), 9).alias("share"))


@query(f"with {QA} select split, dept_from_filename, count(*) as n from qa group by all order by n desc, split, dept_from_filename")
def archive_counts(spark, sf):
    return X.qa(spark, sf).groupBy("split", "dept_from_filename").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "split", "dept_from_filename")


@query(f"with {QA} select id, content_len from kept order by content_len desc, id limit 2")
def longest_texts(spark, sf):
    return X.kept(spark, sf).select("id", "content_len").orderBy(F.desc("content_len"), "id").limit(2)


@query(f"with {QA} select distinct department from kept order by 1")
def departments(spark, sf):
    return X.kept(spark, sf).select("department").distinct().orderBy("department")


_SAMPLE = f"""with {QA}, v as (select *, count(*) over (partition by department) as n, count(*) over () as total, row_number() over (partition by department order by md5('42:' || id), id) as r from kept where split = 'Validation')
select id, department from v where r <= greatest(1, round_even(n * 40 / total, 0)) order by id limit 40"""


@query(_SAMPLE)
def strat_sample(spark, sf):
    return E.stratified(_splits(spark, sf)[0], "department", 40, 42).select("id", "department")


_SUMMARY = f"""with {_RULED}, v as (select id, department, content_len as orig_len, length(split_part(content, chr(10), 1)) as query_len, long400_or_expressions3 as multi from ruled where split = 'Validation'),
o as (select *, row_number() over (partition by department order by query_len) - 1 as a, row_number() over (partition by department order by orig_len) - 1 as b, count(*) over (partition by department) as n from v)
select department, max(query_len) filter (where a = n // 2) as median_query, max(orig_len) filter (where b = n // 2) as median_orig, round(avg(query_len / orig_len), 9) as ratio, count(*) filter (where multi) as n_multi, count(*) as n from o group by 1"""


@query(_SUMMARY)
def evalset_summary(spark, sf):
    rows = _rules(spark, sf).where("split = 'Validation'").withColumn("query_len", F.length(T.first_line(F.col("content"))))
    half = F.floor(F.col("n") / 2)
    q = P.order_statistics(rows, ["department"], "query_len", {"median_query": half})
    o = P.order_statistics(rows, ["department"], "content_len", {"median_orig": half})
    rest = rows.groupBy("department").agg(F.round(F.avg(F.col("query_len") / F.col("content_len")), 9).alias("ratio"), F.sum(F.col("long400_or_expressions3").cast("long")).alias("n_multi"), F.count("*").alias("n"))
    return q.join(o, "department").join(rest, "department")


@query("select user_id, user_text as content, answer as payload from (select conv_id as user_id, turn, role, text as user_text, lead(text) over w as answer, lead(role) over w as next_role from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant' and length(answer) >= 40")
def qa_filter(spark, sf):
    """Question and answer pairs whose answer is long enough."""
    rows = E.answered(X.table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", 40)
    return rows.select(F.col("conv_id").alias("user_id"), "content", "payload")


@query(f"with {QA} select id, trim(regexp_replace(lower(source || ' ' || disease || '/' || department), '[^a-z0-9]+', '-', 'g'), '-') as slug from kept")
def slug(spark, sf):
    return X.kept(spark, sf).select("id", T.slug(F.concat("source", F.lit(" "), "disease", F.lit("/"), "department")).alias("slug"))


_PATHS = "paths as (select distinct 'runs/' || disease || '/' || upper(department) as path, 'models/' || disease as model, 64 as dim from kept)"


@query(f"with {QA}, {_PATHS} select path, coalesce(case when contains(lower(path), 'src1') then 'one' when contains(lower(path), '/fr') then 'french' end, regexp_extract(model, '[^/]*$')) as arm, coalesce(case when contains(lower(path), 'src1') then 'one' when contains(lower(path), '/fr') then 'french' end, regexp_extract(model, '[^/]*$')) || '@' || dim || 'd' as swept from paths")
def arm_ids(spark, sf):
    rows = X.kept(spark, sf).select(F.concat(F.lit("runs/"), "disease", F.lit("/"), F.upper("department")).alias("path"), F.concat(F.lit("models/"), "disease").alias("model"), F.lit(64).alias("dim")).distinct()
    rules = [("src1", "one"), ("/fr", "french")]
    return rows.select("path", T.arm_id(F.col("path"), F.col("model"), rules).alias("arm"), T.arm_id(F.col("path"), F.col("model"), rules, F.col("dim")).alias("swept"))
