"""Queries over texts and tables: chunking, keyword search, model jobs, maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanwork.functions.staging import shared_dir, staged
from gleanwork.functions.text import clean_generated as strip_generated
from gleanwork.functions.text import tokens as token_list
from gleanwork.operators import chunking as C
from gleanwork.operators import evalset as E
from gleanwork.operators import keyword as K
from gleanwork.operators import maintenance as M
from gleanwork.operators import models as D
from gleanwork.operators import profile as P
from gleanwork.operators import ranking as R
from gleanwork.plans import corpus
from gleanwork.plans import fixtures as X
from gleanwork.plans.fixtures import QA
from gleanwork.plans.registry import query
from gleanwork.sources import io, waves
from gleanwork.sources.io import EMBEDDING, SETTINGS

_FOREIGN = "(?i)license"


def _documents(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", "text")


def _bare(spark, sf):
    return _documents(spark, sf).withColumnRenamed("doc_id", "id")


@query(r"select doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '([.!?])\d{1,3}(\s|$)', '\1\2', 'g'), chr(10)), lambda x: not regexp_matches(x, '(?i)^\s*(table|figure|fig\.|표|그림)\s*\d+') and not regexp_matches(x, '(?i)license')), chr(10)) as text from documents")
def clean_corpus(spark, sf):
    return _documents(spark, sf).select("doc_id", C.cleaned(F.col("text"), _FOREIGN).alias("text"))


@query(r"with f as (select regexp_matches(text, '(?i)license') as a, regexp_matches(text, '[^.!?\s]\s*$') as b, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)^\s*(table|figure|fig\.|표|그림)\s*\d+'))) > 0 as c from documents) select unnest(['foreign', 'broken_end', 'caption']) as flag, unnest([count(*) filter (where a), count(*) filter (where b), count(*) filter (where c)]) as n, unnest([round(avg(a::int), 9), round(avg(b::int), 9), round(avg(c::int), 9)]) as rate from f")
def damage_rates(spark, sf):
    from gleanwork.operators.profile import rates

    flags = C.damage(F.col("text"), _FOREIGN)
    return rates(_documents(spark, sf).withColumns(flags), list(flags))


@query("with i as (select doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 350)) as st from documents where length(text) > 0) select doc_id, (st // 350)::int as chunk_index, substr(text, st + 1, 400) as content from i")
def chunk_fixed(spark, sf):
    return C.fixed(_documents(spark, sf), 400, 50)


_LINES = "lines as (select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as content, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 as chunk_index from documents)"


@query(f"with {_LINES} select doc_id, chunk_index::int as chunk_index, content from lines")
def chunk_paragraph(spark, sf):
    return C.by_line(_documents(spark, sf))


@query()
def chunk_packed(spark, sf):
    return C.packed(_documents(spark, sf), 800)


@query()
def chunk_recursive(spark, sf):
    return C.recursive(_documents(spark, sf), 400, "doc_id")


@query(f"with {_LINES}, i as (select doc_id, chunk_index as parent_index, content as payload, unnest(range(0, greatest(length(content) - 20, 1), 180)) as st from lines) select doc_id, parent_index::int as parent_index, (st // 180)::int as chunk_index, substr(payload, st + 1, 200) as content, payload from i")
def chunk_parent_child(spark, sf):
    return C.parent_child(_documents(spark, sf), 200, 20, "doc_id").select("doc_id", "parent_index", "chunk_index", "content", "payload")


_PARTS = "list_filter(string_split_regex(content, '[.] '), lambda x: trim(x) <> '')"


@query(f"with {corpus._RULED}, p as (select id, case when long400_or_expressions3 and len({_PARTS}) > 1 then {_PARTS} else [content] end as parts from ruled) select id, unnest(range(len(parts)))::int as part, unnest(parts) as content from p")
def decompose(spark, sf):
    rows = corpus._rules(spark, sf).select("id", "content", F.col("long400_or_expressions3").alias("flag"))
    return C.decomposed(rows, "flag", pattern="[.] ").select("id", "part", "content")


@query(f"with {QA}, st as (select doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 350)) as st from documents where length(text) > 0), i as (select id, content, payload, null::int as chunk_index from kept union all by name select 'c' || doc_id || '-' || (st // 350) as id, substr(text, st + 1, 400) as content, substr(text, st + 1, 400) as payload, (st // 350)::int as chunk_index from st) select id, content, payload, chunk_index from i")
def mixed_index(spark, sf):
    """Q&A rows and all chunks of each document in one index."""
    chunk_id = F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-"), F.col("chunk_index").cast("string"))
    chunks = C.fixed(_documents(spark, sf), 400, 50).select(chunk_id.alias("id"), "content", F.col("content").alias("payload"), "chunk_index")
    return X.kept(spark, sf).select("id", "content", "payload").unionByName(chunks, allowMissingColumns=True)


_TOK = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"


@query(f"select doc_id, len({_TOK}) as n, len(list_distinct({_TOK})) as n_distinct, {_TOK}[1] as first from documents")
def tokens(spark, sf):
    t = token_list(F.col("text"))
    return _documents(spark, sf).select("doc_id", F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("n_distinct"), F.get(t, 0).alias("first"))


@query(r"with t as (select doc_id, regexp_replace(lower(text), '\s+', '', 'g') as p from documents), g as (select doc_id, unnest(list_transform(range(1, greatest(length(p), 1)), lambda i: substr(p, i, 2))) as gram from t) select gram, count(*) as n from g group by 1")
def bigrams(spark, sf):
    return _documents(spark, sf).select(F.explode(token_list(F.col("text"), "bigrams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"with t as (select doc_id, unnest({_TOK}) as term from documents) select term, count(distinct doc_id) as df, count(*) as cf from t group by 1")
def term_stats(spark, sf):
    return K.term_statistics(_bare(spark, sf), token_list(F.col("text")))


_BM25 = f"""with d as (select doc_id as id, {_TOK} as toks from documents), w as (select count(*) as n_docs, avg(len(toks)) as mean from d),
q as (select distinct item_id as qid, unnest(list_distinct({_TOK})) as term from benchmark),
t as (select id, len(toks) as dl, unnest(toks) as term from d), f as (select id, dl, term, count(*) as tf from t where term in (select term from q) group by 1, 2, 3),
c as (select term, count(*) as df from f group by 1),
s as (select q.qid, f.id, round(sum(ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / mean))), 9) as score from f join c using (term) join q using (term), w group by 1, 2)
select qid, id, score, row_number() over (partition by qid order by score desc, id) as pos from s qualify pos <= 30"""


@query(_BM25)
def bm25_topk(spark, sf):
    """Searches with all words of an item."""
    asked = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("asked"))
    return K.bm25(asked, _bare(spark, sf), token_list(F.col("asked")), token_list(F.col("text")))


def _letters(c: str) -> str:
    """models.letter_encoder() as SQL."""
    return f"list_transform(range(97, 123), lambda i: (length({c}) - length(replace({c}, chr(i::int), '')))::double)"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-9))"


_SETTINGS = {"model_name": "letters", "dim": 26, "query_prefix": "query: ", "passage_prefix": "passage: ", "max_seq_len": None}
_ITEMS = f"{QA}, items as (select 'query' as kind, id, 'query: ' || content as t from kept where split = 'Validation' union all select 'doc', id, 'passage: ' || content from kept)"


def _encoded(spark, sf):
    """The items' vectors, made by two runs into one folder: the first has a third of the keys, the second goes on."""
    items, root = corpus.embed_items(spark, sf), f"{shared_dir(spark)}/arm-{uuid.uuid4().hex}"
    waves.encode_into(root, items.where(F.crc32(F.encode("id", "utf-8")) % 3 == 0), D.letter_encoder, _SETTINGS, waves=1, partitions=8)
    waves.encode_into(root, items, D.letter_encoder, _SETTINGS, waves=2, partitions=8)
    return waves.committed(spark, root, EMBEDDING, waves.settings_digest(_SETTINGS))


@query(f"with {_ITEMS}, v as (select kind, id, {_letters('t')} as v from items) select kind, id, 'letters' as model_name, 26 as dim, round((v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-9))::float::double, 6) as first, round((v[5] / greatest(sqrt(list_dot_product(v, v)), 1e-9))::float::double, 6) as fifth from v")
def embed_job(spark, sf):
    """Letter counts stand in for the model. Part of the keys was encoded by a run before."""
    return _encoded(spark, sf).select("kind", "id", "model_name", "dim", *(F.round(F.col("embedding")[k].cast("double"), 6).alias(c) for k, c in ((0, "first"), (4, "fifth"))))


@query(f"with {_ITEMS} select 'letters' as model_name, 26 as dim, 'query: ' as query_prefix, 'passage: ' as passage_prefix, null::int as max_seq_len, count(*) as n from items")
def meta_consistency(spark, sf):
    """An arm's rows are counted once they are known to have one kind of settings."""
    return M.one_setting(_encoded(spark, sf), SETTINGS).groupBy(*SETTINGS).agg(F.count("*").alias("n"))


_HYBRID = f"""dv as (select doc_id as id, {_letters("coalesce(text, '')")} as u from documents), qv as (select item_id as qid, {_letters("coalesce(text, '')")} as u from benchmark),
near as (select qid, id, round(list_dot_product({_unit('q.u')}, {_unit('d.u')}), 9) as sim from qv q, dv d),
both_lists as (select qid, id, row_number() over (partition by qid order by sim desc, id) as pos from near qualify pos <= 30 union all select qid, id, pos from bm),
fused as (select qid, id, round(sum(1.0::double / (60 + pos)), 12) as score from both_lists group by 1, 2)"""


@query(f"with bm as ({_BM25}), {_HYBRID} select qid, id, score, row_number() over (partition by qid order by score desc, id) as pos from fused qualify pos <= 20")
def hybrid_rrf(spark, sf):
    """The first 30 documents by vector and the first 30 by keyword, fused to 20."""
    items = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    near = R.top_k(D.vectors(items, D.letter_encoder, "text", ["qid"]), D.vectors(_bare(spark, sf), D.letter_encoder, "text", ["id"]), 30)
    return R.fused([near, bm25_topk(spark, sf)])


_SENT = r"(?s).*?[.!?]+[\t\n\r ]+|.+"


@query(f"""with s as (select doc_id, unnest(regexp_extract_all(text, '{_SENT}')) as sentence, generate_subscripts(regexp_extract_all(text, '{_SENT}'), 1) as k from documents where text <> ''),
v as (select *, {_letters('sentence')} as u from s), w as (select doc_id, k, sentence, {_unit('u')} as u from v),
b as (select a.doc_id, a.k, a.sentence, case when round(list_dot_product(a.u, p.u), 9) < 0.6 then 1 else 0 end as new from w a left join w p on p.doc_id = a.doc_id and p.k = a.k - 1),
c as (select *, sum(new) over (partition by doc_id order by k)::int as chunk_index, sum(length(sentence)) over (partition by doc_id order by k) - length(sentence) as pos from b)
select doc_id, chunk_index, min(pos)::bigint as start, count(*)::int as sentences, string_agg(sentence, '' order by k) as content from c group by 1, 2""")
def semantic_chunks(spark, sf):
    """Whole texts, cut where a sentence has other letters than the one before."""
    return C.semantic(_documents(spark, sf), D.letter_encoder, "doc_id", threshold=0.6)


_ANSWER = """case when conv_id % 3 = 0 then '"' || text || '"' when conv_id % 3 = 1 then ' ''' || text || '''' else text || chr(10) end"""


@query(rf"""with a as (select conv_id, turn, {_ANSWER} as t from conversations), b as (select conv_id, turn, string_split(trim(trim(trim(t, e' \t\n\r'), '"'), ''''), chr(10))[1] as t from a)
select conv_id, turn, trim(t, e' \t\n\r') as cleaned from b""")
def clean_generated(spark, sf):
    """Turns as a model's answers: some in quotes, some with blanks around them; the first line stays."""
    n = F.col("conv_id") % 3
    answer = F.when(n == 0, F.concat(F.lit('"'), "text", F.lit('"'))).when(n == 1, F.concat(F.lit(" '"), "text", F.lit("'"))).otherwise(F.concat("text", F.lit("\n")))
    return X.table(spark, sf, "conversations").select("conv_id", "turn", strip_generated(answer).alias("cleaned"))


_TURN = "turn as (select conv_id * 1000 + turn as id, text as content from conversations)"
_ASKED = "asked as (select id, unnest(q) as question, generate_subscripts(q, 1)::int - 1 as question_index from (select id, list_filter(list_transform(string_split(content, '.'), lambda x: trim(x, e' \t\n\r')), lambda x: x <> '') as l, list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i])[1:3] as q from turn))"


@query(f"with {_TURN}, {_ASKED}, c as (select id, {_letters('content')} as u from turn), cv as (select id, {_unit('u')} as v from c), a as (select *, {_letters('question')} as u from asked), av as (select id, question_index, question, {_unit('u')} as v from a), s as (select av.id, question_index, question, cv.id as found, round(list_dot_product(av.v, cv.v), 9) as sim from av, cv) select id, question_index, question from s qualify row_number() over (partition by id, question_index order by sim desc, found) = 1 and found = id")
def roundtrip_chain(spark, sf):
    """Turns as chunks: up to three sentences each are asked, encoded and searched among all turns; kept are those that find their own."""
    turns = X.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    return E.round_trip(turns, lambda c: F.split(c, r"\."), D.letter_encoder, most=3)


def _plainer(text: str) -> str:
    """The stand-in reads the whole text: its longest sentence, of equal ones the first."""
    return max(text.replace("\n", " ").split(". "), key=len).strip(" ")


_PLAINER = r"trim(list_reduce(string_split(replace(content, chr(10), ' '), '. '), lambda a, b: case when length(b) > length(a) then b else a end))"


@query(f"with {QA}, r as (select id, {_PLAINER} as q from norm where split = 'Validation') select id, case when q <> '' then q end as query, case when q = '' then 'empty' end as error from r")
def rewrite_job(spark, sf):
    """A deterministic stand-in; empty answers go to the reject side with a reason."""
    rows = X.norm(spark, sf).where("split = 'Validation'").select("id", "content")
    return D.rewrite(rows, _plainer).select("id", "query", "error")


@query(f"with {QA}, t as (select id, len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')) as n_tokens from kept) select id, n_tokens, n_tokens > 128 as over_128, n_tokens > 512 as over_512 from t")
def token_limits(spark, sf):
    """Tokens are counted by a plug-in (here: words), and the limit is one of tokens."""
    counted = D.count_tokens(X.kept(spark, sf).select("id", "content"), D.word_counter)
    return counted.select("id", "n_tokens", *(P.over_limit(F.col("n_tokens"), n, counted=True).alias(f"over_{n}") for n in (128, 512)))


@query(f"with {QA} select split, 'content' as column, count(distinct content) as exact, true as within from kept group by 1 union all select split, 'payload', count(distinct payload), true from kept group by 1 union all select 'all', 'content', count(distinct content), true from kept union all select 'all', 'payload', count(distinct payload), true from kept")
def merged_distinct(spark, sf):
    """Sketches stored per split and department, merged per split and over all; within: at most 7 % off the exact count."""
    rows, columns = X.kept(spark, sf), ["content", "payload"]
    stored = staged(P.distinct_sketches(rows, ["split", "department"], columns), "sketches")
    both = P.merged_counts(stored, ["split"], columns).unionByName(P.merged_counts(stored.withColumn("split", F.lit("all")), ["split"], columns))
    twice = rows.unionByName(rows.withColumn("split", F.lit("all")))
    exact = twice.groupBy("split").agg(*(F.count_distinct(F.sha2(c, 256)).alias(c) for c in columns)).unpivot(["split"], columns, "column", "exact")
    return both.join(exact, ["split", "column"]).select("split", "column", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= 0.07 * F.col("exact")).alias("within"))


@query("select doc_id, text, lang, source from documents")
def jsonl_round_trip(spark, sf):
    """Documents written as JSON lines and read with a declared schema."""
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    io.write_jsonl(X.table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path)
    return io.read_jsonl(spark, path, "doc_id long, text string, lang string, source string")


_NOW = "2026-01-02 00:00:00"
_UPSERT = f"""with o as (select doc_id as id, lang, n_chars, timestamp '2026-01-01' as created_at, timestamp '2026-01-01' as updated_at from documents where doc_id % 5 <> 0),
n as (select doc_id as id, upper(lang) as lang, n_chars from documents where doc_id % 3 = 0)
select coalesce(n.id, o.id) as id, case when n.id is null then o.lang else n.lang end as lang, case when n.id is null then o.n_chars else n.n_chars end as n_chars,
 coalesce(o.created_at, timestamp '{_NOW}') as created_at, case when n.id is null then o.updated_at else timestamp '{_NOW}' end as updated_at from o full join n on o.id = n.id"""


@query(_UPSERT)
def upsert(spark, sf):
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    then = F.lit("2026-01-01 00:00:00").cast("timestamp")
    old = docs.where("id % 5 != 0").withColumns({"created_at": then, "updated_at": then})
    return M.upsert(old, docs.where("id % 3 = 0").withColumn("lang", F.upper("lang")), F.lit(_NOW).cast("timestamp"))


@query("with c as (select min(ts) + (max(ts) - min(ts)) / 2 as cut from events) select event_id, event_type from events, c where ts > cut and event_id not in (select event_id from events, c where ts <= cut)")
def ingest_new(spark, sf):
    """Events after the middle of their time that are not known from before."""
    from gleanwork.streaming.ingest import new_rows

    events = X.table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = events.agg((F.min(micros) + F.floor((F.max(micros) - F.min(micros)) / 2)).alias("cut"))
    marked = events.crossJoin(F.broadcast(cut)).withColumn("late", micros > F.col("cut"))
    return new_rows(marked.where("late").select("event_id", "event_type"), marked.where("not late"), "event_id")


@query("select event_type, max(ts) as last_seen from events group by 1")
def high_water(spark, sf):
    return M.high_water(X.table(spark, sf, "events"), "event_type", "ts")
