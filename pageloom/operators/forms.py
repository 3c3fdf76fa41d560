"""Form edits from commands: fields and what stands around them, their ranking, the tools of a model, and proposals.

A command's candidates are one array of nine at most (five text, three tick, one choice field), so that everything that
is decided about a command is an expression over its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from . import labels, search

CALLS = "struct<function_calls:array<struct<name:string,arguments:map<string,string>>>,suppressed_calls:array<struct<name:string,arguments:map<string,string>>>>"
ACTION = "struct<field:bigint,kind:string,value:string,checked:boolean,option:string,source:bigint,alternatives:array<bigint>>"
GROUPS = ("text", "tick", "choice")


# Fields and their texts


def group_of(kind: Column) -> Column:
    return F.when(kind == "checkbox", "tick").when(kind == "choice", "choice").otherwise("text")


def field_texts(fields: DataFrame, words: DataFrame) -> DataFrame:
    """form_id, field_ix, grp, weight, text, ix: what stands around each field that can be edited, and its tooltip.

    fields: form_id, field_ix, page, l, t, r, b, kind ('text', 'checkbox', 'choice'), tooltip, read_only. words: form_id,
    entry, page, word_id, text, l, t, r, b; of entries for one page the first counts. Fields that are read only block
    the way like all others, but have no texts.
    """
    at = F.struct("form_id", "page").alias("page")
    entry = F.min("entry").over(Window.partitionBy("form_id", "page"))
    first = words.withColumn("_first", entry).where("entry = _first").select(at, "word_id", "text", *labels.BOX)
    boxes = fields.select(at, F.col("field_ix").cast("long").alias("box_id"), F.when(F.col("kind") == "checkbox", "choice").otherwise("text").alias("kind"), *labels.BOX)
    found = labels.context(boxes, first).select("page.form_id", F.col("box_id").alias("field_ix"), "place", "text")
    kept = fields.where(~F.coalesce("read_only", F.lit(False))).select("form_id", F.col("field_ix").cast("long").alias("field_ix"), group_of(F.col("kind")).alias("grp"), "tooltip")
    near = found.join(kept.drop("tooltip"), ["form_id", "field_ix"]).withColumn("weight", T.place_weight(F.col("grp"), F.col("place")))
    tips = kept.withColumn("text", T.tooltip_label(F.col("tooltip"))).where("text is not null").select("form_id", "field_ix", F.lit("tooltip").alias("place"), "text", "grp", F.lit(1.0).alias("weight"))
    order = F.array_position(F.array(*map(F.lit, (*labels.PLACES, "tooltip"))), F.col("place")).cast("int")
    return near.unionByName(tips).select("form_id", "field_ix", "grp", F.col("weight").cast("double").alias("weight"), "text", order.alias("ix"))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """text: each text that a vector is needed for, once."""
    return texts.select("text").distinct()


def rank(texts: DataFrame, vectors: DataFrame, commands: DataFrame) -> DataFrame:
    """cmd_id, form_id, field_ix, grp, score, text: each field's best text for a command, the last of equals.

    texts: as field_texts; vectors: text, vec; commands: cmd_id, form_id, vec.
    """
    known = texts.join(vectors, "text").withColumnRenamed("vec", "_v")
    scored = commands.select("cmd_id", "form_id", F.col("vec").alias("_q")).join(known, "form_id").withColumn("score", search.dot("_q", "_v") * F.col("weight"))
    best = scored.groupBy("cmd_id", "form_id", "field_ix", "grp").agg(F.max(F.struct("score", "ix", "text")).alias("x"))
    return best.select("cmd_id", "form_id", "field_ix", "grp", F.col("x.score").alias("score"), F.col("x.text").alias("text"))


def shortlist(candidates: DataFrame, key: str = "form_id") -> DataFrame:
    """candidates (key, field_ix, grp, score) with place: five text, three tick and one choice field of a key."""
    most = F.element_at(F.create_map(*[F.lit(x) for kv in C.SHORTLIST.items() for x in kv]), F.col("grp"))
    w = Window.partitionBy(key, "grp").orderBy(F.desc("score"), "field_ix")
    return candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def with_alternatives(ranked: DataFrame) -> DataFrame:
    """form_id, grp, best and up to two alternatives, from ranked candidates with place."""
    few = ranked.where("place <= 3").groupBy("form_id", "grp").agg(F.sort_array(F.collect_list(F.struct("place", "field_ix"))).alias("c"))
    return few.select("form_id", "grp", F.get("c.field_ix", F.lit(0)).alias("best"), F.slice("c.field_ix", 2, 2).alias("alternatives"))


def candidates(ranked: DataFrame, key: str = "cmd_id") -> DataFrame:
    """key and cands, the shortlist of each key as an array: text, tick and choice fields, the best first.

    ranked: key, field_ix, grp, score, text and, for choice fields, options.
    """
    options = F.col("options") if "options" in ranked.columns else F.lit(None).cast("array<string>")
    group = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("grp")).alias("g")
    listed = shortlist(ranked.withColumn("options", F.coalesce(options, F.array().cast("array<string>"))), key)
    one = F.struct(group, "place", F.col("field_ix").cast("long").alias("field"), "grp", F.col("score").cast("double").alias("score"), "text", "options")
    return listed.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("cands"))


# A model's tools and calls


def json_string(c: Column) -> Column:
    """A text as a JSON string of ASCII characters alone."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def one(x: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", "\\\\u$1")
        out = F.when(F.lit(False), x)
        for plain, written in short.items():
            out = out.when(x == plain, F.lit(written))
        return out.when(x.rlike("[^\\x20-\\x7f]"), units).otherwise(x)

    return F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), one), ""), F.lit('"'))


def _labels(cands: Column) -> Column:
    return F.transform(cands, lambda c: T.tool_label(c["text"]))


def _first_of(cands: Column, test) -> Column:
    """Place from 1 of the first candidate that meets test; 0 if none does."""
    return F.coalesce(F.array_position(F.transform(cands, test), True), F.lit(0)).cast("int")


def _filled(template: str, *parts: Column) -> Column:
    cut = template.split("{}")
    cut = [*cut[: len(parts)], "{}".join(cut[len(parts) :])]
    return F.concat(*[x for i, s in enumerate(cut) for x in ((F.lit(s), parts[i]) if i < len(parts) else (F.lit(s),))])


def tools(cands: Column) -> Column:
    """The JSON of the tools that a model is offered for candidates; of equal labels the first stands."""
    names = _labels(cands)
    listed = F.transform(cands, lambda c, i: F.struct(c["grp"].alias("grp"), F.get(names, i).alias("label"), c["options"].alias("options"), (F.array_position(names, F.get(names, i)) == i + 1).alias("first")))
    of = lambda g: F.filter(listed, lambda c: c["first"] & (c["grp"] == g))
    enum = lambda g: F.array_join(F.transform(of(g), lambda c: json_string(c["label"])), ", ")
    choice = lambda c: _filled(C.CHOICE_TOOL, json_string(F.concat(F.lit("Choose one option for '"), c["label"], F.lit("'."))), F.array_join(F.transform(c["options"], json_string), ", "))
    none = F.array().cast("array<string>")
    every = F.concat(F.array(_filled(C.FILL_TOOL, enum("text"))), F.when(F.size(of("tick")) > 0, F.array(_filled(C.TICK_TOOL, enum("tick")))).otherwise(none), F.transform(of("choice"), choice), F.array(F.lit(C.NO_TOOL)))
    return F.concat(F.lit("["), F.array_join(F.transform(every, lambda t: F.concat(F.lit('{"type": "function", "function": '), t, F.lit("}"))), ", "), F.lit("]"))


def read_calls(answer: Column, cands: Column) -> Column:
    """array<struct<name, cand, value, checked, option>> of a model's answer; cand is a place from 1 in cands.

    Text that is no JSON gives nothing, and calls of fields or options that were not offered fall away.
    """
    raw = F.coalesce(F.from_json(answer, CALLS)["function_calls"], F.from_json(F.lit("[]"), "array<struct<name:string,arguments:map<string,string>>>"))

    def one(c: Column) -> Column:
        arg = lambda name: F.try_element_at(c["arguments"], F.lit(name))
        option = F.coalesce(arg("option"), F.lit(""))
        by_label = F.coalesce(F.array_position(_labels(cands), arg("field")), F.lit(0)).cast("int")
        by_option = _first_of(cands, lambda x: (x["grp"] == "choice") & F.array_contains(x["options"], option))
        at = F.when(c["name"].isin("fill_field", "set_checkbox"), by_label).when(c["name"] == "choose_option", by_option).otherwise(F.lit(0))
        return F.struct(c["name"].alias("name"), at.alias("cand"), F.coalesce(arg("value"), F.lit("")).alias("value"), F.coalesce(arg("checked").try_cast("boolean"), F.lit(True)).alias("checked"), option.alias("option"))

    return F.filter(F.transform(raw, one), lambda c: c["cand"] > 0)


def held_back(answer: Column) -> Column:
    """The first suppressed fill_field's value of a model's answer."""
    value = lambda c: F.try_element_at(c["arguments"], F.lit("value"))
    found = F.filter(F.from_json(answer, CALLS)["suppressed_calls"], lambda c: (c["name"] == "fill_field") & value(c).isNotNull())
    return F.try_element_at(F.get(found, F.lit(0))["arguments"], F.lit("value"))


def calls(answers: DataFrame, listed: DataFrame) -> DataFrame:
    """form_id, pos, name, field_ix, value, checked, option of a model's answers (form_id, answer).

    listed: form_id, place, field_ix, grp, label and, for choice fields, options, as they were offered.
    """
    ranked = listed.withColumns({"text": F.col("label"), "score": -F.col("place")})
    rows = answers.join(candidates(ranked, "form_id"), "form_id")
    found = rows.select("form_id", "cands", F.posexplode(read_calls(F.col("answer"), F.col("cands"))).alias("pos", "c"))
    return found.select("form_id", "pos", F.col("c.name").alias("name"), F.get("cands", F.col("c.cand") - 1)["field"].alias("field_ix"), F.col("c.value").alias("value"), F.col("c.checked").alias("checked"), F.col("c.option").alias("option"))


# Decisions


def plan(command: Column) -> Column:
    """What to do first: 'not_supported', 'same_as', 'clear', 'rules' or 'ask' (a model, for what rules can't tell)."""
    return F.when(T.is_signing(command), "not_supported").when(T.same_as(command).isNotNull(), "same_as").when(T.is_clearing(command), "clear").when(T.rules_decide(command), "rules").otherwise("ask")


def _action(field: Column, kind: str, alternatives: Column | None = None, **change: Column) -> Column:
    parts = {"value": "string", "checked": "boolean", "option": "string", "source": "bigint"}
    none = F.array().cast("array<bigint>")
    return F.struct(field.cast("bigint").alias("field"), F.lit(kind).alias("kind"), *[change.get(k, F.lit(None)).cast(t).alias(k) for k, t in parts.items()], (none if alternatives is None else alternatives).alias("alternatives"))


def _field(cands: Column, at: Column) -> Column:
    return F.get(cands, at - 1)["field"]


def _others(cands: Column, at: Column) -> Column:
    """Fields of the next two candidates of a candidate's group."""
    grp = F.get(cands, at - 1)["grp"]
    same = F.filter(cands, lambda c, i: (c["grp"] == grp) & (i + 1 != at))
    return F.slice(F.transform(same, lambda c: c["field"]), 1, 2)


def _strongest(cands: Column) -> Column:
    """The candidate of the greatest score but for choice fields, the last of equals: struct<score, i, grp, field>."""
    return F.array_max(F.filter(F.transform(cands, lambda c, i: F.struct(c["score"].alias("score"), i.alias("i"), c["grp"].alias("grp"), c["field"].alias("field"))), lambda c: c["grp"] != "choice"))


def clearing(rows: DataFrame) -> DataFrame:
    """rows (cands) with kind and actions of 'clear …': an unticked box or an emptied field."""
    rows = rows.withColumn("_best", _strongest(F.col("cands")))
    same = F.transform(F.filter("cands", lambda c: c["grp"] == F.col("_best.grp")), lambda c: c["field"])
    rest = F.slice(same, 2, 2)
    tick = _action(F.col("_best.field"), "check", rest, checked=F.lit(False))
    empty = _action(F.col("_best.field"), "clear", rest)
    found = F.when(F.col("_best.grp") == "tick", F.array(tick)).when(F.col("_best").isNotNull(), F.array(empty))
    return _proposed(rows, found, F.lit(None)).drop("_best")


def _proposed(rows: DataFrame, actions: Column, no_value: Column) -> DataFrame:
    """rows with kind, actions and fields (those of 'no_value')."""
    rows = rows.withColumn("actions", actions.cast(f"array<{ACTION}>")).withColumn("fields", no_value.cast("array<bigint>"))
    return rows.withColumn("kind", F.when(F.col("actions").isNotNull(), "actions").when(F.col("fields").isNotNull(), "no_value").otherwise("no_such_field"))


def decide(rows: DataFrame) -> DataFrame:
    """rows (command, today, cands, answer) with kind, actions and fields.

    In this order: a model's calls of two fields or more; the option that it chose; an option of the best choice field
    that the command names; a tick; the text field and its value, or no_value. answer is null where no model was asked.
    """
    command, cands = F.col("command"), F.col("cands")
    rows = rows.withColumn("cands", F.coalesce("cands", F.expr("cast(array() as array<struct<g:bigint,place:int,field:bigint,grp:string,score:double,text:string,options:array<string>>>)")))
    rows = rows.withColumns({"_calls": read_calls(F.col("answer"), cands), "_held": held_back(F.col("answer"))}).withColumn("_first", F.get("_calls", F.lit(0)))
    usable = F.filter("_calls", lambda c: ((c["name"] == "fill_field") & (T.bare(c["value"]) != "")) | (c["name"] == "set_checkbox"))
    rows = rows.withColumn("_use", usable)
    rows = rows.withColumn("_multi", F.filter("_use", lambda c, i: F.array_position(F.transform("_use", lambda x: x["cand"]), c["cand"]) == i + 1))

    def of_call(c: Column) -> Column:
        field, others = _field(cands, c["cand"]), _others(cands, c["cand"])
        return F.when(c["name"] == "fill_field", _action(field, "fill", others, value=T.bare(c["value"]))).otherwise(_action(field, "check", others, checked=c["checked"]))

    rows = rows.withColumns({"_choice": _first_of(cands, lambda c: c["grp"] == "choice"), "_top": _strongest(cands)})
    choice = F.get(cands, F.col("_choice") - 1)
    first_choice = F.forall(cands, lambda o: (o["grp"] == "choice") | (o["score"] <= choice["score"]))
    named = F.filter(choice["options"], lambda o: F.regexp_like(F.lower(command), F.concat(F.lit("\\b\\Q"), F.lower(o), F.lit("\\E\\b"))))
    rows = rows.withColumn("_option", F.when((F.col("_choice") > 0) & first_choice, F.get(named, F.lit(0))))
    ticks = F.when(T.is_ticking(command), F.lit(True)).when(F.col("_first").isNotNull(), F.col("_first.name") == "set_checkbox").when(T.is_value_like(command), F.lit(False)).otherwise(F.col("_top.grp") == "tick")
    rows = rows.withColumn("_ticks", ticks).withColumn("_at", _first_of(cands, lambda c: c["grp"] == F.when(F.col("_ticks"), "tick").otherwise("text")))
    known = F.col("_ticks").isNotNull() & (F.col("_at") > 0)
    field, others = _field(cands, F.col("_at")), _others(cands, F.col("_at"))
    checked = F.when(F.col("_first.name") == "set_checkbox", F.col("_first.checked")).otherwise(~T.is_unticking(command))
    model = F.when(F.col("_first.name") == "fill_field", F.col("_first.value"))
    value = F.coalesce(T.extracted_value(command, model, F.col("_held"), F.col("today")), T.after_label(command, F.get(cands, F.col("_at") - 1)["text"]))
    rows = rows.withColumn("_value", value)
    actions = (
        F.when(F.size("_multi") >= 2, F.transform("_multi", of_call))
        .when(F.col("_first.name") == "choose_option", F.array(_action(_field(cands, F.col("_first.cand")), "choose", option=F.col("_first.option"))))
        .when(F.col("_option").isNotNull(), F.array(_action(choice["field"], "choose", option=F.col("_option"))))
        .when(known & F.col("_ticks"), F.array(_action(field, "check", others, checked=checked)))
        .when(known & F.col("_value").isNotNull(), F.array(_action(field, "fill", others, value=F.col("_value"))))
    )
    no_value = F.when(known & ~F.col("_ticks") & F.col("_value").isNull(), F.concat(F.array(field), others))
    out = _proposed(rows, actions, no_value)
    return out.drop("_calls", "_held", "_first", "_use", "_multi", "_choice", "_top", "_option", "_ticks", "_at", "_value")


def propose(commands: DataFrame, ranked: DataFrame, model=None) -> DataFrame:
    """cmd_id, command, kind, actions, fields, reason of commands but those of 'same as', which copy_from answers.

    commands: cmd_id, command, today. ranked: cmd_id, field_ix, grp, score, text, options. model takes the columns of the
    tools' JSON and of the command and gives its answer; only commands that rules don't decide reach it. Without one
    those, too, are decided by what rules can tell.
    """
    rows = commands.join(candidates(ranked), "cmd_id", "left").withColumn("_step", plan(F.col("command"))).where("_step != 'same_as'")
    none = F.lit(None).cast("string")
    answer = none if model is None else model(F.col("_tools"), F.col("command"))
    ruled = rows.where("_step = 'rules'" if model is not None else "_step in ('rules', 'ask')").withColumn("answer", none)
    parts = [decide(ruled), clearing(rows.where("_step = 'clear'").withColumn("answer", none))]
    if model is not None:
        parts.append(decide(rows.where("_step = 'ask'").withColumn("_tools", tools(F.col("cands"))).withColumn("answer", answer).drop("_tools")))
    parts.append(_proposed(rows.where("_step = 'not_supported'"), F.lit(None), F.lit(None)).withColumn("kind", F.lit("not_supported")))
    reason = F.when(F.col("kind") == "not_supported", F.lit(C.UNSUPPORTED)).alias("reason")
    out = [p.select("cmd_id", "command", "kind", "actions", "fields", reason) for p in parts]
    whole = out[0]
    for p in out[1:]:
        whole = whole.unionByName(p)
    return whole


def copy_from(to: DataFrame, source: DataFrame) -> DataFrame:
    """cmd_id, kind, actions of 'X same as Y': the best text field for X takes the value of the best other one for Y.

    to, source: cmd_id, field_ix, grp, score, text, ranked against X and against Y.
    """
    fields = lambda df, name: candidates(df.where("grp = 'text'")).select("cmd_id", F.transform("cands", lambda c: c["field"]).alias(name))
    rows = fields(to, "_to").join(fields(source, "_from"), "cmd_id", "full")
    target = F.get("_to", F.lit(0))
    rows = rows.withColumn("_source", F.get(F.filter("_from", lambda f: f != target), F.lit(0)))
    rest = F.slice(F.filter(F.slice("_to", 2, C.SHORTLIST["text"]), lambda f: f != F.col("_source")), 1, 2)
    found = F.when(F.col("_source").isNotNull() & target.isNotNull(), F.array(_action(target, "copy_from", rest, source=F.col("_source"))))
    return _proposed(rows, found, F.lit(None)).select("cmd_id", "kind", "actions")


def parts_of(proposals: DataFrame) -> DataFrame:
    """cmd_id, part_ix, n_parts, part of commands that gave one fill and may be about several fields."""
    one = (F.col("kind") == "actions") & (F.size("actions") == 1) & (F.get("actions", F.lit(0))["kind"] == "fill")
    cut = proposals.where(one).select("cmd_id", F.explode(F.array(T.command_parts(F.col("command")))).alias("ps")).where("ps is not null")
    return cut.select("cmd_id", F.size("ps").alias("n_parts"), F.posexplode("ps").alias("part_ix", "part"))


def merge(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """cmd_id, actions of commands whose parts each gave one action, all of different fields that the parts name.

    parts: cmd_id, form_id, part_ix, n_parts, part, kind, actions. texts: as field_texts. A part names its field if one
    of its words, outside its value, is a word around the field.
    """
    a = F.get("actions", F.lit(0))
    one = parts.where((F.col("kind") == "actions") & (F.size("actions") == 1)).select("cmd_id", "form_id", "part_ix", "n_parts", "part", a.alias("a"))
    said = T.word_keys(F.coalesce("a.value", "a.option", F.lit("")))
    word = F.explode(F.array_except(F.array_except(T.word_keys(F.col("part")), said), F.array(*map(F.lit, C.PART_FILLERS))))
    asked = one.select("cmd_id", "part_ix", "form_id", F.col("a.field").alias("field_ix"), word.alias("w"))
    known = texts.select("form_id", "field_ix", F.explode(T.word_keys(F.col("text"))).alias("w"))
    named = asked.join(known, ["form_id", "field_ix", "w"], "left_semi").select("cmd_id", "part_ix").distinct()
    good = one.join(named, ["cmd_id", "part_ix"], "left_semi").groupBy("cmd_id").agg(F.max("n_parts").alias("n"), F.sort_array(F.collect_list(F.struct("part_ix", "a"))).alias("x"))
    fields = F.transform("x", lambda p: p["a"]["field"])
    return good.where((F.size("x") == F.col("n")) & (F.size(F.array_distinct(fields)) == F.col("n"))).select("cmd_id", F.transform("x", lambda p: p["a"]).alias("actions"))


def with_ids(proposals: DataFrame, fields: DataFrame) -> DataFrame:
    """proposals (form_id, actions, fields) with the application's ids in place of field numbers; fields: form_id,
    field_ix, id. A form's ids meet in one map."""
    ids = fields.groupBy("form_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("field_ix").cast("bigint"), F.col("id").cast("bigint")))).alias("_ids"))
    at = lambda f: F.try_element_at(F.col("_ids"), f)
    named = F.transform("actions", lambda a: F.struct(at(a["field"]).alias("field"), *[a[k].alias(k) for k in ("kind", "value", "checked", "option")], F.when(a["source"].isNotNull(), at(a["source"])).alias("source"), F.transform(a["alternatives"], at).alias("alternatives")))
    return proposals.join(ids, "form_id", "left").withColumns({"actions": named, "fields": F.transform("fields", at)}).drop("_ids")


def proposal_json(rows: DataFrame) -> DataFrame:
    """cmd_id, proposal: each proposal as a JSON object with the keys that its kind has. rows: cmd_id, kind, actions,
    fields, reason."""
    change = lambda a: F.struct(a["kind"].alias("kind"), a["value"].alias("value"), a["checked"].alias("checked"), a["option"].alias("option"), a["source"].alias("field"))
    actions = F.transform("actions", lambda a: F.struct(a["field"].alias("field"), change(a).alias("change"), a["alternatives"].alias("alternatives")))
    own = F.struct(F.col("kind"), actions.alias("actions"), F.col("fields").alias("candidates"), F.col("reason"))
    return rows.select("cmd_id", F.to_json(own).alias("proposal"))
