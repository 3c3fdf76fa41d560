"""Queries over made-up forms: what stands around fields, a model's tools and calls, proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import forms, labels
from .catalog import _CANDS, _CLEAR, _COMMANDS, _SIGN, _TICK, _UNTICK, _VALUE_OF, boxes_of, candidates_of, commands_of, query, read

_OPTIONS = "case when grp = 'choice' then ['low \"' || field_ix % 3 || '\"', 'größer'] else [] end"
_LISTED = f"""{_CANDS}, ranked as (select *, case grp when 'text' then 1 when 'tick' then 2 else 3 end as g, 'Field ' || field_ix % 50 as label, {_OPTIONS} as options,
  row_number() over (partition by form_id, grp order by score desc, field_ix) as place from cands),
listed as (select *, row_number() over (partition by form_id, label order by g, place) as n from ranked where place <= case grp when 'text' then 5 when 'tick' then 3 else 1 end)"""


def listed_of(spark, d):
    rows = candidates_of(spark, d).withColumn("text", F.concat(F.lit("Field "), (F.col("field_ix") % 50).cast("string")))
    return rows.withColumn("options", F.when(F.col("grp") == "choice", F.array(F.concat(F.lit('low "'), (F.col("field_ix") % 3).cast("string"), F.lit('"')), F.lit("größer"))))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _enum_sql(grp: str) -> str:
    return f"""coalesce(string_agg(case when grp = '{grp}' and n = 1 then '"' || label || '"' end, ', ' order by place), '')"""


_WRAP = '{"type": "function", "function": '
_CHOICE = C.CHOICE_TOOL.split("{}")
_TOOLS = f"""with {_LISTED}, t as (select form_id, {_enum_sql("text")} as texts, {_enum_sql("tick")} as ticks,
  max(case when grp = 'choice' and n = 1 then {_sql(_WRAP + _CHOICE[0])} || '"Choose one option for ''' || label || '''."' || {_sql(_CHOICE[1])} || '"low \\"' || field_ix % 3 || '\\"", "gr\\u00f6\\u00dfer"' || {_sql("{}".join(_CHOICE[2:]) + "}, ")} end) as choices
  from listed group by form_id)
select form_id, '[' || {_sql(_WRAP)} || replace({_sql(C.FILL_TOOL)}, '{{}}', texts) || '}}, ' || case when ticks <> '' then {_sql(_WRAP)} || replace({_sql(C.TICK_TOOL)}, '{{}}', ticks) || '}}, ' else '' end
  || coalesce(choices, '') || {_sql(_WRAP + C.NO_TOOL + "}]")} as tools from t"""


@query(_TOOLS)
def tool_json(spark, d):
    rows = forms.candidates(listed_of(spark, d), "form_id")
    return rows.select("form_id", forms.tools(F.col("cands")).alias("tools"))


def scored_fields(spark, d):
    """Six fields for each command: four of text, a tick and a choice, with scores from their numbers."""
    rows = commands_of(spark, d).select("cmd_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("field_ix"))
    grp = F.when(F.col("field_ix") < 4, "text").when(F.col("field_ix") == 4, "tick").otherwise("choice")
    score = (F.col("cmd_id") * 31 + F.col("field_ix") * 17) % 101 / 100
    text = F.concat(F.lit("Field "), F.col("field_ix").cast("string"))
    return rows.select("cmd_id", "field_ix", grp.alias("grp"), score.alias("score"), text.alias("text"), F.when(grp == "choice", F.array(F.lit("box"), F.lit("LOW"))).alias("options"))


@query(f"""with {_COMMANDS}, f as (select cmd_id, command, i as field, case when i < 4 then 'text' when i = 4 then 'tick' else 'choice' end as grp, (cmd_id * 31 + i * 17) % 101 / 100 as score from commands, range(6) r(i)),
r as (select *, row_number() over (partition by cmd_id, grp order by score desc, field) as place, max(score) over (partition by cmd_id) as top from f),
c as (select cmd_id, command, {_VALUE_OF} as value, regexp_matches(command, '{_TICK}') as tick, regexp_matches(command, '{_UNTICK}') as untick, {_SIGN} as sign, regexp_matches(command, '{_CLEAR}') as clear,
  regexp_matches(command, '\\d|@|:\\s*\\S') as value_like, max(case when grp = 'choice' and score = top then 1 else 0 end) as choosable,
  list(field order by place) filter (grp = 'text') as texts, max(score) filter (grp = 'tick') >= max(score) filter (grp = 'text') as tick_leads from r group by cmd_id, command),
s as (select *, case when choosable = 1 and regexp_matches(lower(command), '\\bbox\\b') then 'box' when choosable = 1 and regexp_matches(lower(command), '\\blow\\b') then 'LOW' end as opt,
  case when tick then true when value_like then false else tick_leads end as ticks from c),
w as (select *, case when sign then 'none' when clear then case when tick_leads then 'untick' else 'clear' end when opt is not null then 'choose' when ticks then 'check' when value is not null then 'fill' else 'no_value' end as does from s)
select cmd_id, case does when 'none' then 'not_supported' when 'no_value' then 'no_value' else 'actions' end as kind,
  case does when 'none' then null when 'no_value' then null when 'untick' then 'check' else does end as change,
  case does when 'untick' then 4 when 'check' then 4 when 'choose' then 5 when 'clear' then texts[1] when 'fill' then texts[1] end::bigint as field,
  case does when 'fill' then value end as value, case does when 'untick' then false when 'check' then not untick end as checked, case does when 'choose' then opt end as option,
  case when does in ('clear', 'fill') then texts[2] || ',' || texts[3] when does in ('untick', 'check', 'choose') then '' end as alternatives from w""")
def proposals(spark, d):
    """What rules alone make of commands."""
    rows = forms.propose(commands_of(spark, d).withColumn("today", F.lit("2024-05-01")), scored_fields(spark, d))
    a = F.get("actions", F.lit(0))
    return rows.select("cmd_id", "kind", a["kind"].alias("change"), a["field"].alias("field"), a["value"].alias("value"), a["checked"].alias("checked"), a["option"].alias("option"), F.array_join(a["alternatives"].cast("array<string>"), ",").alias("alternatives"))


@query("""with a as (select o_orderkey as cmd_id, i as field, (o_orderkey * 7 % 5 + i * 2) % 5 as x, (o_orderkey * 3 % 5 + i * 3) % 5 as y from orders, range(5) r(i)),
b as (select cmd_id, list(field order by x desc, field) as xs, list(field order by y desc, field) as ys from a group by cmd_id),
s as (select cmd_id, xs, xs[1] as target, list_filter(ys, lambda f: f <> xs[1])[1] as source from b)
select cmd_id, target as field, source, array_to_string(list_filter(xs[2:], lambda f: f <> source)[1:2], ',') as alternatives from s""")
def copied_values(spark, d):
    """'X same as Y' for every order, with five text fields scored for X and for Y by their numbers."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("cmd_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("field_ix")).withColumns({"grp": F.lit("text"), "text": F.lit("x")})
    ranked = lambda a, b: rows.withColumn("score", (F.col("cmd_id") * a % 5 + F.col("field_ix") * b) % 5)
    a = F.get("actions", F.lit(0))
    found = forms.copy_from(ranked(7, 2), ranked(3, 3))
    return found.select("cmd_id", a["field"].alias("field"), a["source"].alias("source"), F.array_join(a["alternatives"].cast("array<string>"), ",").alias("alternatives"))


@query("""with a as (select event_id as form_id, event_type from events)
select form_id, i as pos, case i when 0 then 'fill_field' when 1 then 'set_checkbox' else 'choose_option' end as name, 7 + i as field_ix,
  case when i = 0 then event_type else '' end as value, i <> 1 as checked, case when i = 2 then 'größer' else '' end as option from a, range(3) r(i)""")
def model_calls(spark, d):
    """Four calls of each event: a fill, a tick, an option, and a field that was not offered, which falls away."""
    call = lambda name, *args: F.concat(F.lit(f'{{"name":"{name}","arguments":{{'), *args, F.lit("}}"))
    parts = [
        call("fill_field", F.lit('"field":"Name","value":"'), F.col("event_type"), F.lit('"')),
        call("set_checkbox", F.lit('"field":"Paid","checked":false')),
        call("choose_option", F.lit('"option":"größer"')),
        call("fill_field", F.lit('"field":"No such","value":1')),
    ]
    answers = read(spark, d, "events").select(F.col("event_id").alias("form_id"), F.concat(F.lit('{"function_calls":['), F.concat_ws(",", *parts), F.lit("]}")).alias("answer"))
    fields = (("text", "Name", 7, ()), ("tick", "Paid", 8, ()), ("choice", "Size", 9, ("low", "größer")))
    listed = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(label).alias("label"), F.lit(i).alias("field_ix"), F.lit(1).alias("place"), F.array(*map(F.lit, o)).cast("array<string>").alias("options")) for g, label, i, o in fields])
    return forms.calls(answers, answers.select("form_id", F.inline(listed)))


@query("""with k as (select doc_id, string_split(text, '') as cs from documents where text is not null)
select doc_id, '"' || array_to_string(list_transform(cs, lambda c: case when c = '"' then '\\"' when c = '\\' then '\\\\' when c = chr(10) then '\\n' when c = chr(13) then '\\r' when c = chr(9) then '\\t' when c = chr(8) then '\\b' when c = chr(12) then '\\f'
  when unicode(c) > 65535 then '\\u' || lower(to_hex(55296 + (unicode(c) - 65536) // 1024)) || '\\u' || lower(to_hex(56320 + (unicode(c) - 65536) % 1024))
  when unicode(c) > 127 or unicode(c) < 32 then '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') else c end), '') || '"' as json from k""")
def json_strings(spark, d):
    """Every document as a JSON string of ASCII characters, as labels are in a model's tools."""
    return read(spark, d, "documents").where("text is not null").select("doc_id", forms.json_string(F.col("text")).alias("json"))


# What stands around fields

_FORM_BOXES = """raw as (select l_orderkey // 8 as page, ((l_orderkey * 10 + l_linenumber) * 10000 + l_partkey) * 10000 + l_suppkey as box_id, l_partkey as p, l_suppkey as s, l_linenumber as n, min(l_linestatus) as st, min(l_returnflag) as rf, min(l_quantity) as q from lineitem group by all),
placed as (select page, box_id, p, st, rf, (p * 7 % 600)::double as l, ((s * 13 + n * 29) % 300)::double as t, p * 7 % 600 + case when st = 'O' then 25 + p % 20 else q + 4 end as r, ((s * 13 + n * 29) % 300 + 9 + n)::double as b from raw),
f as (select page, box_id, case when rf = 'A' then 'choice' else 'text' end as kind, l as fl, t as ft, r as fr, b as fb from placed where st <> 'O'),
aw as (select page, box_id as word_id, ['Name:', '....', '□', '(Town', 'code)', 'Date', 'of', 'birth', '1.', 'Street', 'No:'][1 + p % 11] as text, l, t, r, b from placed where st = 'O'),
w as (select * from aw where text <> '□'), g as (select * from aw where text = '□'),
hs as (select page, list_sort(list(b - t))[count(*) // 2 + 1] as h from w where b > t group by page),
k as (select page, box_id as by, fl as l, ft as t, fr as r, fb as b from f union all select page, null, l, t, r, b from g),
p as (select f.*, coalesce(h, 10.0) as h, word_id, text, l, t, r, b, (ft + fb) / 2 as mid, (t + b) / 2 as c, (l + r) / 2 as x,
  least(b, fb) - greatest(t, ft) >= 0.5 * greatest(least(b - t, fb - ft), 0.1) as level from f join w using (page) left join hs using (page))"""


def _blocked(x0: str, x1: str, y0: str, y1: str) -> str:
    return f"exists (select 1 from k where k.page = q.page and (k.by is null or k.by <> q.box_id) and k.l < {x1} and k.r > {x0} and k.t < {y1} and k.b > {y0})"


def _side_sql(name: str, left: bool) -> str:
    beside, order = ("r <= fl + 0.5 * h", "l desc, word_id desc") if left else ("l >= fr - 0.5 * h", "l, word_id")
    edge = "coalesce(lag(l) over o, fl)" if left else "coalesce(lag(r) over o, fr)"
    x0, x1 = ("q.r", "q.edge") if left else ("q.edge", "q.l")
    leader = "regexp_full_match(text, '[.…·_]+')" if left else "false"
    ends = "or (begun and regexp_matches(text, '[:：]$'))" if left else ""
    over = f"over (partition by page, box_id order by {order} rows between unbounded preceding and"
    return f"""{name}0 as (select *, first_value(c) over (partition by page, box_id order by abs(c - mid), word_id) as line from p where level and {beside}),
{name}1 as (select *, {edge} as edge, coalesce(max(case when not {leader} then 1 else 0 end) {over} 1 preceding), 0) = 1 as begun from {name}0 where abs(c - line) < 0.5 * h window o as (partition by page, box_id order by {order})),
{name}2 as (select *, {x1} - {x0} > case when begun then 1.5 * h else {15 if left else 3} * h end {ends} or {_blocked(x0, x1, "q.mid - 0.1", "q.mid + 0.1")} as stop from {name}1 q),
{name}3 as (select *, max(case when stop then 1 else 0 end) {over} current row) as stopped from {name}2),
{name} as (select page, box_id, kind, '{name}' as place, word_id, text, l, t, r, b, h from {name}3 where stopped = 0 and not {leader})"""


def _column_sql(name: str, above: bool) -> str:
    d, reach = ("ft - b", 8) if above else ("t - fb", 1.5)
    y0, y1 = ("q.b", "q.ft") if above else ("q.fb", "q.t")
    beyond = "exists (select 1 from w where w.page = s.page and least(w.b, s.first.b) - greatest(w.t, s.first.t) >= 0.5 * greatest(least(w.b - w.t, s.first.b - s.first.t), 0.1) and (w.l < s.fl - s.h or w.r > s.fr + s.h))"
    return f"""{name}0 as (select *, {d} as d from p where r > fl - h and l < fr and {d} between -0.3 * h and {reach} * h),
{name}1 as (select *, d - min(d) over (partition by page, box_id) as ahead from {name}0 q where not {_blocked("greatest(q.l, q.fl)", "least(q.r, q.fr)", f"{y0} + 0.1", f"{y1} - 0.1")}),
{name}2 as (select *, case when ahead < 0.5 * h then 0 when {str(above).lower()} and ahead <= 1.8 * h then 1 end as nth from {name}1),
{name}3 as (select page, box_id, nth, any_value(fl) as fl, any_value(fr) as fr, any_value(h) as h, count(*) as n, min(l) as edge, arg_min({{'t': t, 'b': b}}, word_id) as first from {name}2 where nth is not null group by page, box_id, nth),
{name}4 as (select *, {beyond} as wide from {name}3 s),
{name}5 as (select page, box_id, (max(case when nth = 0 then n end) <= 4 and not bool_or(wide)) or abs(max(case when nth = 0 then edge end) - max(case when nth = 1 then edge end)) <= any_value(h) as two from {name}4 group by page, box_id),
{name} as (select page, box_id, kind, '{name}' as place, word_id, text, l, t, r, b, h from {name}2 join {name}5 using (page, box_id) where nth = 0 or (nth = 1 and two))"""


_CLEAN = """ws as (select page, box_id, kind, place, list_filter(string_split(string_agg(text, ' ' order by line, l, t, word_id), ' '), lambda x: not regexp_full_match(x, '[_.…-]*')) as ws from lined group by page, box_id, kind, place),
ns as (select page, box_id, kind, place, case when (regexp_full_match(ws[1], '\\(*[0-9.]*[0-9][.)]*') and length(ws[1]) <= 5) or (length(ws[1]) = 2 and ends_with(ws[1], ')')) then ws[2:] else ws end as ws from ws),
ls as (select page, box_id, kind, place, ws, trim(regexp_replace(trim(regexp_replace(array_to_string(ws, ' '), '[:：* ]+$', '')), '^\\((.*)\\)$', '\\1')) as text from ns),
texts as (select page, box_id, kind, place, text from ls where len(regexp_extract_all(text, '\\p{L}')) >= 2 and not (len(ws) > 1 and len(list_filter(ws, lambda x: length(x) = 1)) = len(ws)))"""

_AROUND = f"""{_FORM_BOXES},
inside as (select page, box_id, kind, 'inside' as place, word_id, text, l, t, r, b, h from p where x > fl and x < fr and c > ft and c < ft + 0.5 * (fb - ft) qualify count(*) over (partition by page, box_id) <= 8),
{_side_sql("left_", True)}, {_side_sql("right_", False)}, {_column_sql("above", True)}, {_column_sql("below", False)},
caption as (select * replace ('caption' as place) from below qualify min((b - t <= 0.85 * h)::int) over (partition by page, box_id) = 1 or first_value(starts_with(text, '(')) over (partition by page, box_id order by l, word_id)),
every as (select * from inside union all select * replace ('left' as place) from left_ union all select * replace ('right' as place) from right_ union all select * from above union all select * from below union all select * from caption),
marked as (select *, case when t - lag(t) over (partition by page, box_id, place order by t, word_id) > 0.5 * h then 1 else 0 end as new from every),
lined as (select *, sum(new) over (partition by page, box_id, place order by t, word_id) as line from marked), {_CLEAN}"""


def form_boxes(spark, d):
    """(fields, words) of made-up forms: boxes of eight orders on a page of 600 by 300."""
    li = read(spark, d, "lineitem")
    key = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    raw = li.groupBy(F.floor(F.col("l_orderkey") / 8).alias("page"), key.alias("box_id"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n")).agg(F.min("l_linestatus").alias("st"), F.min("l_returnflag").alias("rf"), F.min("l_quantity").alias("q"))
    left, top = (F.col("p") * 7 % 600).cast("double"), ((F.col("s") * 13 + F.col("n") * 29) % 300).cast("double")
    rows = raw.select("page", "box_id", "p", "st", "rf", left.alias("l"), top.alias("t"), (left + F.when(F.col("st") == "O", 25 + F.col("p") % 20).otherwise(F.col("q") + 4)).alias("r"), (top + 9 + F.col("n")).alias("b"))
    said = F.get(F.array(*map(F.lit, ("Name:", "....", "□", "(Town", "code)", "Date", "of", "birth", "1.", "Street", "No:"))), (F.col("p") % 11).cast("int"))
    fields = rows.where("st <> 'O'").select("page", "box_id", F.when(F.col("rf") == "A", "choice").otherwise("text").alias("kind"), "l", "t", "r", "b")
    return fields, rows.where("st = 'O'").select("page", F.col("box_id").alias("word_id"), said.alias("text"), "l", "t", "r", "b")


@query(f"with {_AROUND} select page, box_id, place, text from texts where place <> 'caption'")
def field_context(spark, d):
    return labels.context(*form_boxes(spark, d))


@query(f"""with {_AROUND}, o as (select *, case when kind = 'text' then list_position(['inside', 'caption', 'left', 'above', 'below'], place) else list_position(['right', 'left', 'above'], place) end as n from texts),
c as (select page, box_id, arg_min(text, n) as label from o where n > 0 group by page, box_id)
select f.page, f.box_id, f.kind, c.label from f left join c on c.page = f.page and c.box_id = f.box_id""")
def own_labels(spark, d):
    return labels.own_labels(*form_boxes(spark, d)).select("page", "box_id", "kind", "label")


@query()
def field_labels(spark, d):
    return labels.field_labels(*form_boxes(spark, d))


@query()
def inherited_labels(spark, d):
    """Labels handed along combs and down columns, from the labels that some of the fields have."""
    label = F.when(F.col("box_id") % 3 == 0, F.col("box_id").cast("string"))
    return labels.shared_labels(boxes_of(spark, d).withColumns({"kind": F.when(F.col("kind") == "R", "choice").otherwise("text"), "label": label, "h": F.lit(10.0)}))


@query(f"""with {_AROUND}, d as (select page, box_id, kind, place, text, case when kind = 'choice' then case place when 'left' then 0.95 when 'above' then 0.9 when 'inside' then 0.9 when 'below' then 0.85 else 1.0 end else case place when 'below' then 0.9 when 'right' then 0.85 else 1.0 end end as weight from texts where place <> 'caption')
select page as form_id, box_id as field_ix, case kind when 'choice' then 'tick' else 'text' end as grp, weight, text from d
union all select page, box_id, case kind when 'choice' then 'tick' else 'text' end, 1.0, 'Tip of ' || kind from f where box_id % 3 = 0""")
def field_texts(spark, d):
    """The weighted texts of fields whose pages are forms of their own; every third has a tooltip."""
    f, w = form_boxes(spark, d)
    at = {"form_id": F.col("page"), "page": F.lit(1)}
    fields = f.withColumns(at).select("form_id", F.col("box_id").alias("field_ix"), "page", *labels.BOX, F.when(F.col("kind") == "choice", "checkbox").otherwise("text").alias("kind"), F.when(F.col("box_id") % 3 == 0, F.concat(F.lit("Tip_of_"), "kind")).alias("tooltip"), F.lit(False).alias("read_only"))
    return forms.field_texts(fields, w.withColumns(at | {"entry": F.lit(0)})).drop("ix")
