"""Queries over the driver's tables, one or more per operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..operators import answer as A
from ..operators import forms, geometry, language, layout, passages, pdf, search
from ..sources import form_input, tsv

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Fixtures: the same derivation on both sides

_STOP = "[" + ",".join(f"'{w}'" for w in C.STOP_WORDS) + "]"
_STEM = "case " + " ".join(f"when length(w) > {len(s) + 3} and ends_with(w, '{s}') then substr(w, 1, length(w) - {len(s)})" for s in C.SUFFIXES) + " else w end"


def _words_sql(text: str) -> str:
    return f"list_transform(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 and not list_contains({_STOP}, w)), lambda w: {_STEM})"


_CHUNKS = """chunks as (
  select doc_id, ix - 1 as chunk_ix, trim(line, ' ') as text from (
    select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as ix from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))
  where trim(line, ' ') <> '')"""
_QUESTIONS = """questions as (
  select b.item_id * 1000000 + d.doc_id as q_id, d.doc_id, b.question from documents d
  join (select item_id, array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ') as question from benchmark) b on contains(d.text, b.question))"""


def chunks_of(spark, d):
    return passages.line_chunks(read(spark, d, "documents"))


def questions_of(spark, d):
    """First eight words of each benchmark passage, asked of the documents that contain them.

    Where a passage's words stand in a document, all but the first and the last of them stand between blanks. Those six
    in a row are the key of the join; what it finds is then checked. Passages of less than eight words have no such key
    and are looked for in every document, if there are any.
    """
    b = read(spark, d, "benchmark").select("item_id", F.slice(F.split("text", " "), 1, 8).alias("ws")).select("item_id", "ws", F.array_join("ws", " ").alias("question"))
    docs = read(spark, d, "documents").select("doc_id", "text")
    key = lambda ws, i: F.xxhash64(*[F.get(ws, i + j) for j in range(6)])
    held = docs.select("doc_id", F.explode(F.array(F.split("text", " "))).alias("ws")).where("size(ws) >= 6")
    grams = held.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("ws") - 6), lambda i: key(F.col("ws"), i)))).alias("k"))
    long = b.where("size(ws) = 8").select("item_id", "question", key(F.col("ws"), F.lit(1)).alias("k"))
    few = long.count() <= 100_000  # hashes and eight words each
    found = grams.join(F.broadcast(long) if few else long, "k").select("doc_id", "item_id", "question").distinct()
    pairs = docs.join(found, "doc_id").where(F.contains("text", "question")).select("doc_id", "item_id", "question")
    short = b.where("size(ws) < 8")
    if not short.isEmpty():
        pairs = pairs.unionByName(docs.join(short, F.contains("text", "question")).select("doc_id", "item_id", "question"))
    # a few rows that a query asks for several times: kept, as a table of questions would be
    return pairs.select((F.col("item_id") * 1000000 + F.col("doc_id")).alias("q_id"), "doc_id", "question").cache()


_TERMS = f"""{_CHUNKS}, toks as (select doc_id, chunk_ix, unnest({_words_sql("text")}) as token from chunks),
terms as (select doc_id, chunk_ix, token, count(*)::bigint as tf from toks group by all)"""


@query(f"with {_TERMS} select doc_id, chunk_ix, token, tf from terms")
def term_freq(spark, d):
    return search.postings(chunks_of(spark, d))


@query(f"with {_TERMS} select doc_id, token, count(*)::bigint as df from terms group by all")
def doc_freq(spark, d):
    return search.doc_freq(search.postings(chunks_of(spark, d)))


@query(f"with {_CHUNKS} select doc_id, count(*)::bigint as n_chunks, round(greatest(avg(len({_words_sql('text')})), 1.0), 6) as avg_len from chunks group by doc_id")
def bm25_stats(spark, d):
    return search.chunk_stats(chunks_of(spark, d)).withColumn("avg_len", F.round("avg_len", 6))


_BM25 = f"""{_TERMS}, {_QUESTIONS},
asked as (select q_id, doc_id, token, count(*) as times from (select q_id, doc_id, unnest({_words_sql("question")}) as token from questions) group by all),
stats as (select doc_id, count(*) as n, greatest(avg(len({_words_sql("text")})), 1.0) as av from chunks group by doc_id),
lens as (select doc_id, chunk_ix, sum(tf) as len from terms group by all),
dfs as (select doc_id, token, count(*) as df from terms group by all),
hit as (select q_id, t.doc_id, t.chunk_ix, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))) as score
  from terms t join asked a on a.doc_id = t.doc_id and a.token = t.token join dfs f on f.doc_id = t.doc_id and f.token = t.token
  join lens l on l.doc_id = t.doc_id and l.chunk_ix = t.chunk_ix join stats s on s.doc_id = t.doc_id group by all),
kw as (select q.q_id, q.doc_id, c.chunk_ix, coalesce(score, 0.0) as score from questions q join chunks c on c.doc_id = q.doc_id
  left join hit h on h.q_id = q.q_id and h.chunk_ix = c.chunk_ix)"""


@query(f"with {_BM25} select q_id, doc_id, chunk_ix, round(score, 6) as score from kw")
def bm25_scores(spark, d):
    return search.bm25(chunks_of(spark, d), questions_of(spark, d)).withColumn("score", F.round("score", 6))


@query(f"with {_BM25} select * from (select q_id, chunk_ix, round(score, 6) as score, row_number() over (partition by q_id order by round(score, 6) desc, chunk_ix) as rank from kw) where rank <= 8")
def bm25_topk(spark, d):
    rows = search.bm25(chunks_of(spark, d), questions_of(spark, d)).withColumn("score", F.round("score", 6))
    return search.ranks(rows, "rank").withColumn("rank", F.col("rank") + 1).where("rank <= 8").select("q_id", "chunk_ix", "score", "rank")


_VEC = f"""{_BM25}, vec as (select q.q_id, q.doc_id, c.chunk_ix,
  len(list_intersect(list_distinct({_words_sql("question")}), list_distinct({_words_sql("text")})))::double / greatest(len(list_distinct({_words_sql("question")})), 1) as score
  from questions q join chunks c on c.doc_id = q.doc_id),
fused as (select k.q_id, k.chunk_ix, 1.0 / (60 + v.r) + case when k.top > 0 then 1.0 / (60 + k.r) else 0 end as fused
  from (select *, row_number() over (partition by q_id order by round(score, 6) desc, chunk_ix) - 1 as r, max(round(score, 6)) over (partition by q_id) as top from kw) k
  join (select *, row_number() over (partition by q_id order by round(score, 6) desc, chunk_ix) - 1 as r from vec) v on v.q_id = k.q_id and v.chunk_ix = k.chunk_ix)"""


@query(f"with {_VEC} select q_id, chunk_ix, round(fused, 9) as fused from fused")
def rrf_fusion(spark, d):
    return search.rrf(search.scored(chunks_of(spark, d), questions_of(spark, d))).select("q_id", "chunk_ix", F.round("fused", 9).alias("fused"))


@query(f"with {_VEC} select * from (select q_id, chunk_ix, row_number() over (partition by q_id order by round(fused, 9) desc, chunk_ix) as rank from fused) where rank <= 8")
def top_chunks(spark, d):
    return search.top_chunks(search.rrf(search.scored(chunks_of(spark, d), questions_of(spark, d)))).select("q_id", "chunk_ix", "rank")


@query("""with s as (select q.vec_id as q_id, v.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::double * v.embedding[i]::double)), 6) as score
  from embeddings q join embeddings v on true where q.vec_id % 20 = 0)
select * from (select q_id, vec_id, score, row_number() over (partition by q_id order by score desc, vec_id) as rank from s) where rank <= 8""")
def cosine_topk(spark, d):
    e = read(spark, d, "embeddings").withColumn("scope", F.lit(0))
    return search.similarity_topk(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "scope", F.col("embedding").alias("q")), e.select("vec_id", "scope", F.col("embedding").alias("v")), 8)


@query("select vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) as norm, round(u[1], 6) as first from (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as u from embeddings)")
def unit_vectors(spark, d):
    e = search.unit(read(spark, d, "embeddings"), "embedding")
    return e.select("vec_id", F.round(F.sqrt(search.dot("embedding", "embedding")), 6).alias("norm"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query(f"with {_CHUNKS} select doc_id, chunk_ix, text from chunks")
def paragraph_chunks(spark, d):
    return chunks_of(spark, d).select("doc_id", "chunk_ix", "text")


_CUT = """cuts as (select doc_id, chunk_ix, ix - 1 as pos, s as sentence from (select doc_id, chunk_ix, unnest(ss) as s, generate_subscripts(ss, 1) as ix
  from (select doc_id, chunk_ix, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) as ss from chunks)) where s <> '')"""


@query(f"with {_CHUNKS}, {_CUT} select * from cuts")
def sentence_split_simple(spark, d):
    return passages.simple_sentences(chunks_of(spark, d))


@query(f"with {_CHUNKS}, {_CUT} select doc_id, sentence, chunk_ix from (select *, row_number() over (partition by doc_id, sentence order by chunk_ix, pos) as rn from cuts) where rn = 1")
def dedup_sentences(spark, d):
    return search.dedup_first(passages.simple_sentences(chunks_of(spark, d)), ["doc_id", "sentence"], ["chunk_ix", "pos"]).select("doc_id", "sentence", "chunk_ix")


@query()
def sentences_full(spark, d):
    return passages.sentences(chunks_of(spark, d))


@query()
def page_chunks(spark, d):
    """Chunks of documents whose lines are paragraphs and whose first line is a heading."""
    pages = read(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("# "), F.regexp_replace("text", "\n", "\n\n")).alias("text"))
    return passages.chunks(pages)


@query()
def answer(spark, d):
    return A.answer(chunks_of(spark, d), questions_of(spark, d))


# Text predicates and functions

_VOCAB = "select distinct w from (select unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')) as w from documents) where w <> ''"


@query(f"select w as word, {_STEM} as stem from ({_VOCAB})")
def stem(spark, d):
    w = read(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^\\p{L}\\p{N}_]+")).alias("word")).where("word != ''").distinct()
    return w.select("word", T.stem(F.col("word")).alias("stem"))


@query(f"select w as word from ({_VOCAB}) where length(w) > 1 and not list_contains({_STOP}, w)")
def stopword_filter(spark, d):
    w = read(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^\\p{L}\\p{N}_]+")).alias("word")).where("word != ''").distinct()
    return w.where((F.length("word") > 1) & ~F.col("word").isin(*C.STOP_WORDS))


_IN = lambda words: "[" + ",".join(f"'{w}'" for w in words) + "]"
_COUNT = lambda words: f"len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: list_contains({_IN(words)}, w)))"


@query(f"select doc_id, g + u as german, e as english, case when g + u > e then 'de' else 'en' end as marked from (select doc_id, {_COUNT(C.GERMAN)} as g, len(regexp_extract_all(lower(text), '[äöüß]')) as u, {_COUNT(C.ENGLISH)} as e from documents)")
def language_markers(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", (T.count_words(t, C.GERMAN) + T.count_of(F.lower(t), "[äöüß]")).alias("german"), T.count_words(t, C.ENGLISH).alias("english"), T.language_markers(t, F.lit("Latin")).alias("marked"))


_FORM = """form as (
  select c_nationkey as doc_id, c_custkey as ix, 1 + c_custkey % 3 as page, unnest([case when c_nationkey % 2 = 0 or c_custkey % 5 < 2 then 'Name: ' else 'Name ' end || c_name,
    case when c_nationkey % 2 = 0 or c_custkey % 5 < 2 then 'SEGMENT: ' else 'SEGMENT ' end || c_mktsegment, 'Effective from ' || c_name || ' of ' || c_mktsegment, c_mktsegment, '• ' || c_name]) as text from customer)"""


def form_lines(spark, d):
    """Lines of customers; of odd nations most have no colon, so that pages differ in their share of rows."""
    c = read(spark, d, "customer")
    colon = (F.col("c_nationkey") % 2 == 0) | (F.col("c_custkey") % 5 < 2)
    row = lambda name, value: F.concat(F.when(colon, f"{name}: ").otherwise(f"{name} "), value)
    parts = F.array(row("Name", "c_name"), row("SEGMENT", "c_mktsegment"), F.concat(F.lit("Effective from "), "c_name", F.lit(" of "), "c_mktsegment"), F.col("c_mktsegment"), F.concat(F.lit("• "), "c_name"))
    return c.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("ix"), (1 + F.col("c_custkey") % 3).alias("page"), F.explode(parts).alias("text"))


_LABEL = "regexp_extract(text, '^([^:：]*)[:：]', 1)"
_VALUE = "trim(regexp_extract(text, '(?s)^[^:：]*[:：](.*)$', 1))"
_ROW = f"(regexp_matches(text, '[:：]') and length({_LABEL}) <= 40 and regexp_matches({_LABEL}, '\\p{{L}}') and {_VALUE} <> '' and length({_VALUE}) <= 60)"
_BARE = "(length(text) <= 60 and regexp_matches(text, '\\p{L}') and not regexp_matches(text, '[:：]') and not regexp_matches(text, '[.!?؟;,،]$'))"


@query(f"with {_FORM} select doc_id, ix, text, {_LABEL} as label, {_VALUE} as value, {_ROW} as is_row, {_BARE} as bare, regexp_matches(text, '^[{C.BULLETS}](\\s|$)') as bullet, regexp_matches(text, '(?i)({C.AMENDMENT})') as amends from form")
def label_value_rows(spark, d):
    t = F.col("text")
    return form_lines(spark, d).select("doc_id", "ix", "text", T.label_of(t).alias("label"), T.value_of(t).alias("value"), T.is_row(t).alias("is_row"), T.is_bare_label(t).alias("bare"), T.starts_with_bullet(t).alias("bullet"), T.is_amendment(t).alias("amends"))


@query(f"with {_FORM} select doc_id, ix, text, case when {_ROW} and len(regexp_extract_all({_LABEL}, '\\p{{L}}')) >= 2 and not regexp_matches({_LABEL}, '\\p{{Ll}}') then lower({_LABEL}) || substr(text, length({_LABEL}) + 1) else text end as scored from form")
def scoring_text(spark, d):
    return form_lines(spark, d).select("doc_id", "ix", "text", T.scoring_text(F.col("text")).alias("scored"))


@query(f"""with {_FORM}, p as (select doc_id, page, count(*) as n, count_if{'(' + _ROW + ')'} as r from form group by all),
s as (select *, sum(n) over w as dn, sum(r) over w as dr, count(*) over w as pages from p window w as (partition by doc_id))
select doc_id, page from s where (dr > 0 and dr >= 0.4 * dn) or (not (dr > 0 and dr >= 0.4 * dn) and pages <= 10 and r >= 3 and r >= 0.4 * n)""")
def form_pages(spark, d):
    return passages.form_pages(form_lines(spark, d).select("doc_id", "page", "text"))


@query("""with l as (select n_regionkey as doc_id, n_nationkey * 100 as ix, '# ' || n_name as text from nation union all select n_regionkey, n_nationkey * 100 + 1 + s_suppkey % 90, s_name from supplier join nation on s_nationkey = n_nationkey)
select doc_id, ix, text, case when not starts_with(text, '#') then last_value(case when starts_with(text, '#') then trim(regexp_replace(text, '^#+', '')) end ignore nulls) over (partition by doc_id order by ix, text rows between unbounded preceding and 1 preceding) end as section from l""")
def section_carry(spark, d):
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    heads = n.select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") * 100).cast("long").alias("ix"), F.concat(F.lit("# "), "n_name").alias("text"))
    rest = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") * 100 + 1 + F.col("s_suppkey") % 90).alias("ix"), F.col("s_name").alias("text"))
    return passages.sections(heads.unionByName(rest))


@query(f"with {_CHUNKS} select doc_id, chunk_ix, replace(text, '**', '') as plain, len(regexp_extract_all(text, ': ')) >= 3 as flat from chunks")
def markup(spark, d):
    t = F.col("text")
    return chunks_of(spark, d).select("doc_id", "chunk_ix", T.strip_markup(t).alias("plain"), T.maybe_rows(t).alias("flat"))


@query("select event_id, 'date: ' || strftime(ts, '%Y-%m-%d %a %H:%M') as line from events")
def date_line(spark, d):
    e = read(spark, d, "events")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return e.select("event_id", T.date_line(seconds).alias("line"))


@query("select event_id, round(1 / (1 + exp(-value / 100)), 6) as p from events")
def sigmoid(spark, d):
    return read(spark, d, "events").select("event_id", F.round(T.sigmoid(F.col("value") / 100), 6).alias("p"))


_COMMANDS = """commands as (select o_orderkey as cmd_id, case o_orderkey % 8 when 0 then 'Please sign here' when 1 then 'Owner: ' || o_orderpriority when 2 then 'The total is ' || o_orderstatus
  when 3 then 'clear the total' when 4 then 'tick the box' when 5 then 'uncheck the box' when 6 then 'Invoice date today' else 'set price to 12 now' end as command from orders)"""


def commands_of(spark, d):
    k = F.col("o_orderkey") % 8
    c = F.when(k == 0, "Please sign here").when(k == 1, F.concat(F.lit("Owner: "), "o_orderpriority")).when(k == 2, F.concat(F.lit("The total is "), "o_orderstatus")).when(k == 3, "clear the total").when(k == 4, "tick the box").when(k == 5, "uncheck the box").when(k == 6, "Invoice date today").otherwise("set price to 12 now")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("cmd_id"), c.alias("command"))


_VALUE_OF = """coalesce(case when contains(command, ':') then nullif(trim(regexp_extract(command, '(?s)^.*:(.*)$', 1)), '')
    else coalesce(nullif(trim(regexp_extract(command, '(?s)\\b(?:is|are|was)\\s+(.+)$', 1)), ''), nullif(trim(regexp_extract(command, '(?s)(?:^|\\s)(\\S*\\d.*)$', 1)), '')) end,
    case when regexp_matches(command, '(?i)\\btoday\\b') then '2024-05-01' end)"""
_SIGN = "regexp_matches(command, '(?i)^\\s*(please\\s+)?(sign\\b|add\\s+(my\\s+|a\\s+)?signature\\b)')"


@query(f"with {_COMMANDS} select cmd_id, command, {_VALUE_OF} as value, {_SIGN} as signing from commands")
def value_extract(spark, d):
    c, none = F.col("command"), F.lit(None).cast("string")
    return commands_of(spark, d).select("cmd_id", "command", T.extracted_value(c, none, none, F.lit("2024-05-01")).alias("value"), T.is_signing(c).alias("signing"))


_TICK, _UNTICK = "(?i)\\b(tick|untick|check|uncheck|select|mark)\\b", "(?i)\\b(untick|uncheck|unmark|deselect)\\b"
_CLEAR = "(?i)^\\s*(please\\s+)?(clear|empty|erase|delete|remove)\\b"
_COLON_COUNT = "(length(command) - length(replace(command, ':', '')))"


@query(f"""with {_COMMANDS} select cmd_id, case when {_SIGN} then 'not_supported' when regexp_matches(command, '(?i)\\bsame\\s+as\\b') then 'same_as' when regexp_matches(command, '{_CLEAR}') then 'clear'
  when case when regexp_matches(command, '{_TICK}') then {_COLON_COUNT} = 0 and not contains(command, ',') and not contains(command, ' and ') else {_COLON_COUNT} = 1 end then 'rules' else 'ask' end as step,
  regexp_matches(command, '{_TICK}') as tick, regexp_matches(command, '{_UNTICK}') as untick, regexp_matches(command, '\\d|@|:\\s*\\S') as value_like from commands""")
def command_rules(spark, d):
    c = F.col("command")
    return commands_of(spark, d).select("cmd_id", forms.plan(c).alias("step"), T.is_ticking(c).alias("tick"), T.is_unticking(c).alias("untick"), T.is_value_like(c).alias("value_like"))


@query("""with k as (select o_orderkey as cmd_id, 'my ' || lower(o_orderpriority) || ' Name ' || o_clerk as command, o_orderpriority || ' name' as label from (select *, 'Clerk#' || o_custkey as o_clerk from orders))
select cmd_id, 'Clerk#' || regexp_extract(command, '#(\\d+)$', 1) as rest, array_to_string(list_filter(list_transform(string_split_regex(command, '\\s+'), lambda w: lower(regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g'))), lambda w: w <> ''), ' ') as keys from k""")
def label_rest(spark, d):
    """Commands that begin with a filler and the words of their field's label."""
    o = read(spark, d, "orders")
    command = F.concat(F.lit("my "), F.lower("o_orderpriority"), F.lit(" Name Clerk#"), F.col("o_custkey").cast("string"))
    rows = o.select(F.col("o_orderkey").alias("cmd_id"), command.alias("command"), F.concat("o_orderpriority", F.lit(" name")).alias("label"))
    return rows.select("cmd_id", T.after_label(F.col("command"), F.col("label")).alias("rest"), F.array_join(T.word_keys(F.col("command")), " ").alias("keys"))


@query("""with k as (select c_custkey as id, case c_custkey % 7 when 0 then '1.2 ' || c_mktsegment || ' name:' when 1 then '(' || c_mktsegment || ')' when 2 then 'a) Town ____ *' when 3 then 'a t S' when 4 then '12' when 5 then c_name || ' . . . ' else '01.05.2027 due' end as text,
  case c_custkey % 6 when 0 then 'Text' || c_custkey when 1 then c_mktsegment || '_name_Row_' || c_custkey when 2 then 'Check Box ' || c_custkey when 3 then repeat(c_name, 9) when 4 then 'Field name' else 'ab' end as tip from customer),
w as (select id, tip, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: not regexp_full_match(x, '[_.…-]*')) as ws from k),
n as (select id, tip, case when (regexp_full_match(ws[1], '\\(*[0-9.]*[0-9][.)]*') and length(ws[1]) <= 5) or (length(ws[1]) = 2 and ends_with(ws[1], ')')) then ws[2:] else ws end as ws from w),
j as (select id, tip, ws, trim(regexp_replace(trim(regexp_replace(array_to_string(ws, ' '), '[:：* ]+$', '')), '^\\((.*)\\)$', '\\1')) as label from n),
t as (select *, regexp_replace(trim(regexp_replace(replace(tip, '_', ' '), '\\s+', ' ', 'g')), '^(.*) Row [0-9]*$', '\\1') as tool from j)
select id, case when not (len(ws) > 1 and len(list_filter(ws, lambda x: length(x) = 1)) = len(ws)) and len(regexp_extract_all(label, '\\p{L}')) >= 2 then label end as label,
  case when not regexp_matches(lower(tool), '^(text|textfeld|check box|checkbox|kontrollk|topmostsubform|formular|field|feld|untitled|undefined)[0-9 .\\[\\]]*$') and len(regexp_extract_all(tool, '\\p{L}')) >= 3 and length(tool) <= 80 then tool end as tooltip from t""")
def label_clean_up(spark, d):
    c = read(spark, d, "customer")
    k, seg, name = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_name")
    text = F.when(k % 7 == 0, F.concat(F.lit("1.2 "), seg, F.lit(" name:"))).when(k % 7 == 1, F.concat(F.lit("("), seg, F.lit(")"))).when(k % 7 == 2, "a) Town ____ *").when(k % 7 == 3, "a t S").when(k % 7 == 4, "12").when(k % 7 == 5, F.concat(name, F.lit(" . . . "))).otherwise("01.05.2027 due")
    tip = F.when(k % 6 == 0, F.concat(F.lit("Text"), k.cast("string"))).when(k % 6 == 1, F.concat(seg, F.lit("_name_Row_"), k.cast("string"))).when(k % 6 == 2, F.concat(F.lit("Check Box "), k.cast("string"))).when(k % 6 == 3, F.repeat(name, F.lit(9))).when(k % 6 == 4, "Field name").otherwise("ab")
    return c.select(k.alias("id"), T.clean_label(text).alias("label"), T.tooltip_label(tip).alias("tooltip"))


@query(f"with {_FORM}, p as (select doc_id, ix, text, lead(text) over (partition by doc_id, ix order by text) as value from form) select doc_id, ix, text, value, {_BARE} and not regexp_matches(value, '^\\d+\\.(\\d+\\.?)*\\s') and not regexp_matches(value, '^[{C.BULLETS}](\\s|$)') and not regexp_matches(value, '[.!?؟]$') and length(value) <= 120 as joins from p where value is not null")
def joined_labels(spark, d):
    """Whether each line of a customer is a bare label of which the next one, in the order of text, is the value."""
    value = F.lead("text").over(Window.partitionBy("doc_id", "ix").orderBy("text"))
    rows = form_lines(spark, d).withColumn("value", value).where("value is not null")
    return rows.select("doc_id", "ix", "text", "value", T.joins_label(F.col("text"), F.col("value")).alias("joins"))


@query("""with n as (select o_orderkey as id, case o_orderkey % 5 when 0 then '1.2 Date' when 1 then '01.05.2027' when 2 then '3. Rent' when 3 then 'Sign ____ here' else 'Wait... then 0170 123' end as text from orders)
select id, regexp_matches(text, '^\\d+\\.(\\d+\\.?)*\\s') as numbered, regexp_replace(text, '[_.]*_{2,}[_.]*|\\.{4,}', ' ', 'g') as plain from n""")
def numbered_lines(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "1.2 Date").when(k % 5 == 1, "01.05.2027").when(k % 5 == 2, "3. Rent").when(k % 5 == 3, "Sign ____ here").otherwise("Wait... then 0170 123")
    return read(spark, d, "orders").select(k.alias("id"), T.is_numbered(text).alias("numbered"), T.without_fill_in(text).alias("plain"))


_CANDS = """cands as (select l_suppkey as form_id, l_orderkey * 10 + l_linenumber as field_ix, case l_returnflag when 'A' then 'text' when 'N' then 'tick' else 'choice' end as grp, max(l_discount) as score from lineitem group by all)"""


def candidates_of(spark, d):
    grp = F.when(F.col("l_returnflag") == "A", "text").when(F.col("l_returnflag") == "N", "tick").otherwise("choice")
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("form_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("field_ix"), grp.alias("grp"), F.col("l_discount").alias("score"))
    return rows.groupBy("form_id", "field_ix", "grp").agg(F.max("score").alias("score"))


@query(f"with {_CANDS} select * from (select *, row_number() over (partition by form_id, grp order by score desc, field_ix) as place from cands) where place <= case grp when 'text' then 5 when 'tick' then 3 else 1 end")
def topn_per_group(spark, d):
    return forms.shortlist(candidates_of(spark, d))


@query(f"with {_CANDS}, r as (select *, row_number() over (partition by form_id, grp order by score desc, field_ix) as place from cands) select form_id, grp, min(case when place = 1 then field_ix end) as best, min(case when place = 2 and grp <> 'choice' then field_ix end) as second from r group by form_id, grp")
def alternatives(spark, d):
    rows = forms.with_alternatives(forms.shortlist(candidates_of(spark, d)))
    return rows.select("form_id", "grp", "best", F.get("alternatives", F.lit(0)).alias("second"))


# Boxes

_BOXES = """boxes as (select l_orderkey % 300 * 100 + l_partkey % 100 as page, ((l_orderkey * 10 + l_linenumber) * 10000 + l_partkey) * 10000 + l_suppkey as box_id, l_returnflag as kind, max(l_discount) as score,
  min((l_partkey % 500)::double) as l, min((l_suppkey % 90)::double) as t, min(l_partkey % 500 + l_quantity + 1) as r, min((l_suppkey % 90 + 10 + l_linenumber)::double) as b from lineitem group by all)"""


def boxes_of(spark, d):
    li = read(spark, d, "lineitem")
    key = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    left, top = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 90).cast("double")
    rows = li.select((F.col("l_orderkey") % 300 * 100 + F.col("l_partkey") % 100).alias("page"), key.alias("box_id"), F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("score"), left.alias("l"), top.alias("t"), (left + F.col("l_quantity") + 1).alias("r"), (top + 10 + F.col("l_linenumber")).alias("b"))
    return rows.groupBy("page", "box_id", "kind").agg(F.max("score").alias("score"), *[F.min(c).alias(c) for c in ("l", "t", "r", "b")])


_INTER = "greatest(0, least(x.r, y.r) - greatest(x.l, y.l)) * greatest(0, least(x.b, y.b) - greatest(x.t, y.t))"
_CROSS = "x.l < y.r and y.l < x.r and x.t < y.b and y.t < x.b"
_IOU = f"{_INTER} / ((x.r - x.l) * (x.b - x.t) + (y.r - y.l) * (y.b - y.t) - {_INTER} + 1e-9)"


@query(f"with {_BOXES} select x.page, x.box_id as a, y.box_id as b, round({_IOU}, 6) as iou from boxes x join boxes y on x.page = y.page and x.kind = y.kind and x.box_id < y.box_id and {_CROSS} where {_IOU} > 0.3")
def iou_pairs(spark, d):
    return geometry.overlapping(boxes_of(spark, d), 0.3).withColumn("iou", F.round("iou", 6))


@query(f"with {_BOXES} select * from boxes x where not exists (select 1 from boxes y where x.page = y.page and x.kind <> y.kind and y.score > x.score and {_CROSS} and {_INTER} > 0.5 * (x.r - x.l) * (x.b - x.t))")
def cross_kind_suppress(spark, d):
    return geometry.cross_kind(boxes_of(spark, d))


@query(f"with {_BOXES} select page, box_id from boxes qualify count_if(score >= 0.05) over (partition by page) >= 3")
def page_check(spark, d):
    """Boxes of the pages that the check leaves as they are; scores here end at 0.1 and are taken six times."""
    b = boxes_of(spark, d).withColumn("score", F.round(F.col("score") * 6, 6))
    return geometry.page_check(b).select("page", "box_id")


_TILES = f"{_BOXES}, tiles as (select page, box_id, kind, score, l, t, r, b, case box_id % 3 when 2 then 43 else 0 end as y0, case box_id % 3 when 1 then 55 else 99 end as y1 from boxes)"


@query(f"with {_TILES} select page, box_id, case when (y0 > 0 and t < 4) or (y1 < 99 and b > y1 - y0 - 4) then score * 0.5 else score end as score, t + y0 as t, b + y0 as b from tiles")
def region_union(spark, d):
    """Boxes as they were found in the three regions of pages of height 99, each box in one of them."""
    b = boxes_of(spark, d).withColumn("region", (F.col("box_id") % 3).cast("int"))
    cuts = geometry.regions(b.select("page").distinct().withColumn("height", F.lit(99)))
    return geometry.from_regions(b.join(cuts, ["page", "region"])).select("page", "box_id", "score", "t", "b")


@query(f"""with {_BOXES}, k as (select *, case kind when 'A' then 0 when 'N' then 1 else 2 end as ki from boxes),
o as (select *, row_number() over (partition by page order by ki, score desc, box_id) as n from k)
select page, string_agg(ki || ':' || l::int || ':' || case when box_id % 2 = 0 then 1 else -1 end, ',' order by n) as v from o group by page""")
def flat_fields(spark, d):
    """The flat numbers of each page's fields: kind, left edge and state, read back from them."""
    kind = F.when(F.col("kind") == "A", "text").when(F.col("kind") == "N", "choice").otherwise("signature")
    rows = boxes_of(spark, d).withColumn("kind", kind).withColumn("filled", F.when(F.col("box_id") % 2 == 0, F.lit(True)))
    at = lambda i, k: F.get("v", i * 7 + k).cast("int").cast("string")
    each = F.transform(F.sequence(F.lit(0), (F.size("v") / 7).cast("int") - 1), lambda i: F.concat_ws(":", at(i, 0), at(i, 2), at(i, 6)))
    return geometry.flattened(rows).select("page", F.array_join(each, ",").alias("v"))


@query()
def nms_greedy(spark, d):
    return geometry.suppressed(boxes_of(spark, d), 0.3)


@query()
def merged_fields(spark, d):
    return geometry.merged(boxes_of(spark, d).withColumn("score", F.col("score") * 10))


@query(f"""with {_BOXES} select box_id, arg_min(other, (gap, other)) as above from (select x.box_id, y.box_id as other, x.t - y.b as gap from boxes x join boxes y on x.page = y.page and x.box_id <> y.box_id
  and x.t - y.b between -3.0 and 20.0 and least(x.r, y.r) - greatest(x.l, y.l) >= 0.7 * least(x.r - x.l, y.r - y.l)) group by box_id""")
def nearest_above(spark, d):
    return geometry.nearest_above(boxes_of(spark, d), 10)


@query(f"""with {_BOXES}, f as (select * from boxes where kind <> 'R'), w as (select * from boxes where kind = 'R'),
p as (select x.page, x.box_id, y.box_id as word_id, y.r as l, greatest(x.t, y.t) as t, x.l as r, least(x.b, y.b) as b from f x join w y on x.page = y.page and y.r <= x.l and x.l - y.r <= 150
  and least(x.b, y.b) - greatest(x.t, y.t) >= 0.5 * greatest(least(x.b - x.t, y.b - y.t), 0.1))
select box_id, word_id from p x where not exists (select 1 from f y where y.page = x.page and y.box_id <> x.box_id and {_CROSS})""")
def blocker_anti_join(spark, d):
    b = boxes_of(spark, d)
    words = b.where("kind = 'R'").withColumnRenamed("box_id", "word_id")
    return geometry.left_words(b.where("kind != 'R'"), words, 10)


@query(f"with {_BOXES}, c as (select *, case when abs(t - lag(t) over (partition by page order by t, l, box_id)) > 5 then 1 else 0 end as new from boxes), n as (select *, sum(new) over (partition by page order by t, l, box_id) as line from c) select page, box_id as word_id, line::bigint as line, row_number() over (partition by page order by line, l, box_id) as place from n")
def reading_order(spark, d):
    return geometry.reading_order(boxes_of(spark, d).withColumnRenamed("box_id", "word_id"), 10).select("page", "word_id", "line", "place")


@query(f"with {_BOXES}, c as (select page, t as row, box_id as word_id, case when max(r) over w is null or l - max(r) over w > 15 then 1 else 0 end as new, l from boxes window w as (partition by page, t order by l, box_id rows between unbounded preceding and 1 preceding)) select page, row, word_id, (sum(new) over (partition by page, row order by l, word_id) - 1)::bigint as cell from c")
def cells_islands(spark, d):
    b = boxes_of(spark, d).withColumnRenamed("box_id", "word_id").withColumn("row", F.col("t"))
    return geometry.label_runs(b, 10).select("page", "row", "word_id", "cell")


@query("select l_returnflag as kind, list_sort(list(l_extendedprice))[count(*) // 2 + 1] as median from lineitem group by l_returnflag")
def upper_median(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("x"))
    return li.groupBy("kind").agg(geometry.upper_median("x").alias("median"))


@query()
def visual_rows(spark, d):
    return geometry.visual_rows(boxes_of(spark, d).select("page", F.col("box_id").alias("word_id"), "t", "b"))


@query("""with v as (select l_orderkey * 10 + l_linenumber as row_ix, l_partkey, l_suppkey, l_quantity as w, l_discount * 10 as o, l_tax * 10 as p1, 0.3::double as p2 from lineitem)
select row_ix, l_partkey, l_suppkey, case when p1 >= p2 then 'text' else 'choice' end as kind, round(o * greatest(p1, p2), 6) as score, 50 - w / 2 as l, 55.0 as t, 50 + w / 2 as r, 65.0 as b from v where o * greatest(p1, p2) >= 0.2""")
def detector_decode(spark, d):
    v = F.array(F.lit(50.0), F.lit(60.0), F.col("l_quantity"), F.lit(10.0), F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.3), F.lit(0.0))
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_ix"), "l_partkey", "l_suppkey", v.alias("v"))
    return geometry.decoded(rows, F.lit(1.0)).drop("v").withColumn("score", F.round("score", 6))


# OCR words

_OCR = f"""{_CHUNKS}, ocr as (select doc_id as page_id, chunk_ix as block, (wx - 1) // 8 as line, wx - 1 as word, 60 * ((wx - 1) % 8) as l, 20 * (chunk_ix + (wx - 1) // 8) as t, w as text,
  (chunk_ix * 100000 + wx - 1) as ix from (select doc_id, chunk_ix, unnest(ws) as w, generate_subscripts(ws, 1) as wx from (select doc_id, chunk_ix, string_split(text, ' ') as ws from chunks where doc_id % 7 < 7)) where trim(w) <> '')"""


def ocr_rows(spark, d):
    rows = chunks_of(spark, d).select("doc_id", "chunk_ix", F.posexplode(F.split("text", " ")).alias("wx", "w"))
    cells = (F.lit(5), F.lit(1), F.col("chunk_ix"), F.lit(0), F.expr("wx div 8"), F.col("wx"), F.expr("60 * (wx % 8)"), F.expr("20 * (chunk_ix + wx div 8)"), F.length("w") * 6, F.lit(12), F.lit(90), F.col("w"))
    return rows.select(F.col("doc_id").alias("page_id"), (F.col("chunk_ix") * 100000 + F.col("wx")).alias("ix"), F.concat_ws("\t", *cells).alias("row"))


@query(f"with {_OCR} select page_id, block::int as block, 0 as par, line::int as line, l::int as l, t::int as t, (l + 6 * length(text))::int as r, (t + 12)::int as b, 90.0::double as conf, text from ocr")
def ocr_words(spark, d):
    return tsv.parse(ocr_rows(spark, d)).drop("ix")


def numbered_words(spark, d):
    w = tsv.parse(ocr_rows(spark, d))
    return layout.lines(w.withColumn("ix", F.col("block") * 100000 + F.col("line") * 8 + F.expr("l div 60")))


@query(f"with {_OCR}, k as (select page_id, ix, block, line, case when lag(block) over w = block and lag(line) over w = line then 0 else 1 end as new from ocr window w as (partition by page_id order by ix)) select page_id, ix, (sum(new) over (partition by page_id order by ix) - 1)::bigint as line_no from k")
def line_numbering(spark, d):
    return numbered_words(spark, d).select("page_id", "ix", "line_no")


@query(f"with {_OCR} select page_id, min(l)::int as l, min(t)::int as t, max(l + 6 * length(text))::int as r, string_agg(text, ' ' order by ix) as text from ocr group by page_id, block, line")
def line_boxes(spark, d):
    return layout.line_boxes(numbered_words(spark, d)).select("page_id", "l", "t", "r", "text")


@query(f"""with {_OCR}, n as (select *, case when lag(block) over (partition by page_id order by ix) = block and lag(line) over (partition by page_id order by ix) = line then 0 else 1 end as new from ocr),
m as (select *, sum(new) over (partition by page_id order by ix) as line_no from n),
k as (select page_id, line_no, any_value(block) as block, string_agg(text, ' ' order by ix) as text, min(t) as t, max(t + 12) as b from m group by page_id, line_no),
g as (select *, case when lag(block) over w is null then '' when lag(block) over w <> block or t - lag(b) over w > 0.9 * 12 then chr(10) || chr(10) else ' ' end as sep from k window w as (partition by page_id order by line_no))
select page_id, string_agg(sep || text, '' order by line_no) as text from g group by page_id""")
def ocr_page_text(spark, d):
    """Pages of words in lines of one height: no row has two blocks, so they are read by paragraphs."""
    w = tsv.parse(ocr_rows(spark, d))
    words = w.withColumn("ix", F.col("block") * 100000 + F.col("line") * 8 + F.expr("l div 60"))
    # lines of different blocks stand apart, lest they stand side by side; words are so wide that no line has cells
    at = {"t": F.col("t") + F.col("block") * 1000, "b": F.col("b") + F.col("block") * 1000, "r": F.col("l") + 55}
    return layout.read_pages(words.withColumns(at))


@query("""select c_custkey as page_id, 'Name: ' || c_name || chr(10) || 'Segment: ' || c_mktsegment || chr(10) || 'Account: ' || round(c_acctbal)::bigint || chr(10) || 'Nation: ' || c_nationkey as text from customer""")
def ocr_forms(spark, d):
    """Forms as they come from recognition: labels in one block, their values in another, further along the row."""
    c = read(spark, d, "customer")
    rows = F.array(*[F.struct(F.lit(i).alias("row"), F.lit(name).alias("name"), v.cast("string").alias("v")) for i, (name, v) in enumerate((("Name", F.col("c_name")), ("Segment", F.col("c_mktsegment")), ("Account", F.round("c_acctbal").cast("bigint")), ("Nation", F.col("c_nationkey"))))])
    lines = c.select(F.col("c_custkey").alias("page_id"), F.inline(rows))
    word = lambda block, left, text: F.struct(F.lit(block).alias("block"), F.lit(1).alias("par"), F.col("row").alias("line"), F.lit(float(left)).alias("l"), (F.col("row") * 20.0).alias("t"), F.lit(left + 60.0).alias("r"), (F.col("row") * 20.0 + 12).alias("b"), text.alias("text"), (F.lit(block * 10) + F.col("row")).alias("ix"))
    words = lines.select("page_id", F.inline(F.array(word(1, 0, F.col("name")), word(2, 200, F.col("v")))))
    return layout.read_pages(words)


@query("""select c_custkey as page_id, 'NAME: ' || c_name || chr(10) || 'SEGMENT: ' || c_mktsegment as text from customer""")
def ocr_stacked_fields(spark, d):
    """Labels printed small over their values, in boxes side by side."""
    c = read(spark, d, "customer")
    word = lambda ix, line, left, height, text: F.struct(F.lit(ix).alias("ix"), F.lit(1).alias("block"), F.lit(1).alias("par"), F.lit(line).alias("line"), F.lit(float(left)).alias("l"), F.lit(line * 14.0).alias("t"), F.lit(left + 80.0).alias("r"), F.lit(line * 14.0 + height).alias("b"), text.alias("text"))
    words = c.select(F.col("c_custkey").alias("page_id"), F.inline(F.array(word(0, 0, 0, 9, F.lit("NAME")), word(1, 0, 200, 9, F.lit("SEGMENT")), word(2, 1, 0, 12, F.col("c_name")), word(3, 1, 200, 12, F.col("c_mktsegment")))))
    return layout.read_pages(words)


@query("select doc_id as page_id, round(quantile_disc(90.0 - (wx % 7), 0.0), 6) / 100 as confidence from (select doc_id, 0 as wx from documents where trim(coalesce(text, ''), ' ' || chr(10)) <> '') group by doc_id")
def ocr_confidence(spark, d):
    return layout.page_confidence(tsv.parse(ocr_rows(spark, d)))


# PDF pieces

_PIECES = (("Name", "c_name"), ("Segment", "c_mktsegment"), ("Phone", None), ("Nation", "c_nationkey"), ("Key", "c_custkey"))


@query("""select c_custkey as page_id, case c_custkey % 3 when 0 then '# Customer form' || chr(10) || chr(10) || 'Name: ' || c_name || chr(10) || 'Segment: ' || c_mktsegment || chr(10) || 'Phone' || chr(10) || 'Nation: ' || c_nationkey || chr(10) || 'Key: ' || c_custkey
  when 1 then 'Intro.' || chr(10) || chr(10) || 'Name: ' || c_name || chr(10) || 'Segment: ' || c_mktsegment || chr(10) || 'Nation: ' || c_nationkey
  else 'Plain ' || c_name end as text from customer""")
def pdf_pages(spark, d):
    """Three kinds of pages: forms in two columns, run-together rows, and plain markdown."""
    c = read(spark, d, "customer")
    kind, key = F.col("c_custkey") % 3, F.col("c_custkey").alias("page_id")
    said = F.concat(F.lit("Intro.\n\nName: "), "c_name", F.lit(" Segment: "), "c_mktsegment", F.lit(" Nation: "), F.col("c_nationkey").cast("string"))
    pages = c.select(key, F.when(kind == 1, said).otherwise(F.concat(F.lit("Plain "), "c_name")).alias("markdown"), (kind == 0).alias("columns"), F.lit(False).alias("tables"))
    piece = lambda ix, x, y, text, height=10.0, field="text", turned=0.0: F.struct(F.lit(ix).alias("piece_ix"), F.lit(field).alias("kind"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(60.0).alias("width"), F.lit(height).alias("height"), F.lit(turned).alias("rotation"), text.cast("string").alias("text"))
    form = [piece(0, 50, 800, F.lit("Customer form"), 16.0), piece(1, 5, 400, F.lit("sideways"), 300.0, "text", 90.0)]
    for i, (name, column) in enumerate(_PIECES):
        form.append(piece(2 * i + 2, 50, 760 - 16 * i, F.lit(name)))
        form.append(piece(2 * i + 3, 250, 756 - 16 * i, F.col(column) if column else F.lit("________"), 14.0, "field"))
    flat = [piece(0, 50, 780, F.lit("Heading")), *[piece(i + 1, 50, 760 - 16 * i, F.concat(F.lit(f"{name}: "), F.col(column).cast("string"))) for i, (name, column) in enumerate((_PIECES[0], _PIECES[1], _PIECES[3]))]]
    pieces = c.where(kind == 0).select(key, F.inline(F.array(*form))).unionByName(c.where(kind == 1).select(key, F.inline(F.array(*flat))))
    return pdf.page_text(pages, pieces)


@query("""with f as (select c_custkey as form_id, '[{"id":' || c_custkey || ',"page":1,"bounds":[0,1.5,2,3],"kind":"choice","options":["a","' || c_mktsegment || '"]},{"id":2,"page":2,"bounds":[1,1,1,1],"kind":"text","tooltip":"' || c_name || '","readOnly":true}]' as j, c_mktsegment, c_name from customer)
select form_id, 0 as field_ix, form_id as id, 1.5 as t, 'choice' as kind, c_mktsegment as said, false as read_only from f union all select form_id, 1, 2, 1.0, 'text', c_name, true from f""")
def form_json(spark, d):
    """Fields read from JSON."""
    c = read(spark, d, "customer")
    j = F.concat(F.lit('[{"id":'), F.col("c_custkey").cast("string"), F.lit(',"page":1,"bounds":[0,1.5,2,3],"kind":"choice","options":["a","'), "c_mktsegment", F.lit('"]},{"id":2,"page":2,"bounds":[1,1,1,1],"kind":"text","tooltip":"'), "c_name", F.lit('","readOnly":true}]'))
    f = form_input.read_fields(c.select(F.col("c_custkey").alias("form_id"), j.alias("fields")))
    return f.select("form_id", "field_ix", "id", "t", "kind", F.coalesce(F.get("options", F.lit(1)), "tooltip").alias("said"), "read_only")


# Languages


def _signs(name: str, text: str) -> str:
    words = "string_split_regex(lower(text), '[^\\p{L}]')"
    return f"""{name} as (select doc_id, len(list_filter({words}, lambda w: list_contains({_IN(C.ENGLISH)}, w))) as en, len(list_filter({words}, lambda w: list_contains({_IN(C.GERMAN)}, w))) + len(regexp_extract_all(lower(text), '[äöüß]')) as de,
  len(regexp_extract_all(text, '[پچژگ]')) as fa, len(regexp_extract_all(text, 'ة')) as ar from (select doc_id, {text} as text from documents) where regexp_matches(text, '\\p{{L}}'))"""


_TOP = "case when en >= greatest(de, fa, ar) then 'english' when de >= greatest(fa, ar) then 'german' when fa >= ar then 'persian' else 'arabic' end"


@query(f"with {_signs('signs', 'left(text, 3000)')} select doc_id, {_TOP} as document from signs")
def document_languages(spark, d):
    """The rule looks at the first 3,000 characters of a document."""
    return language.document_languages(read(spark, d, "documents"))


@query(f"""with {_signs("docs", "left(text, 3000)")}, {_signs("asked", "text")}, own as (select doc_id, {_TOP} as document from docs),
q as (select doc_id as q_id, doc_id - doc_id % 2 as doc_id, {_TOP} as question, en, de, fa, ar, en + de + fa + ar + 4 as n from asked)
select q_id, document, question from q join own using (doc_id) where question <> document and (case document when 'english' then en when 'german' then de when 'persian' then fa else ar end + 1) / n < 0.2""")
def refused_questions(spark, d):
    """Each document, asked of the even document before it."""
    docs = read(spark, d, "documents")
    asked = docs.select(F.col("doc_id").alias("q_id"), (F.col("doc_id") - F.col("doc_id") % 2).alias("doc_id"), F.col("text").alias("question"))
    return language.refused(asked, docs)


# Answers


@query("""with c as (select c_nationkey as doc_id, c_custkey as ix, c_name, c_mktsegment from customer),
a as (select doc_id, ix, 'Segment of ' || c_name || ': ' || c_mktsegment as row from c), s as (select doc_id, count(*) as n from c group by doc_id)
select ix as q_id, 'found' as kind, row as sentence from a""")
def form_row_answers(spark, d):
    """Each nation is a form of a page whose rows differ in a name; every row is asked for by its whole label, and all
    score alike, so only the rule of named rows tells them apart."""
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("q_id"), F.translate("c_name", "#0123456789", "xabcdefghij").alias("name"), "c_name", "c_mktsegment")
    rows = c.select("doc_id", F.col("q_id").alias("pos"), F.concat(F.lit("Segment of "), "c_name", F.lit(": "), "c_mktsegment").alias("text"))
    asked = c.select("doc_id", "q_id", F.concat(F.lit("What is the segment of "), "c_name", F.lit("?")).alias("question"))
    own = asked.join(rows, "doc_id").withColumns({"page": F.lit(1), "section": F.lit(None).cast("string")})
    scored = own.withColumn("score", F.when(F.col("pos") == F.col("q_id"), 0.45).otherwise(0.44))
    forms_ = c.select("doc_id").distinct().withColumns({"form_pages": F.array(F.lit(1)), "short": F.lit(True)})
    found = A.decide(scored, forms_)
    return found.select("q_id", "kind", F.get("passages", F.lit(0))["text"].alias("sentence"))


@query("""with s as (select conv_id as q_id, turn as pos, text, round(length(text) / 5200.0, 6) as score from conversations where text is not null),
r as (select *, row_number() over (partition by q_id order by score desc, pos) as rn from s)
select q_id, max(score) as best, case when count(*) = 1 then 1.0 else max(score) - max(case when rn = 2 then score end) end as gap from r group by q_id""")
def runner_up_gap(spark, d):
    c = read(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("q_id"), F.col("turn").alias("pos"), "text", F.round(F.length("text") / 5200.0, 6).alias("score"))
    return search.pick(c).where("rn = 1").select("q_id", "best", F.round("gap", 9).alias("gap"))



from . import form_queries  # noqa: E402, F401  registers its own
