import duckdb
import pytest
from pyspark.sql import functions as F

from pageloom.functions import folds
from pageloom.functions import text as T
from pageloom.operators import answer, forms, geometry, labels, language, passages, search
from pageloom.operators.image import clean_halftone, grey, letterbox, median3, resize, state_crop, window_sum
from pageloom.plans import catalog
from pageloom.sources import index

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert _rows(map(tuple, got.select(*cols).collect())) == _rows(want)


def test_sentences():
    cut = folds.sentences_of
    assert cut("We met Dr. Wood. It rained.") == ["We met Dr. Wood.", "It rained."]
    assert cut("Tax due\nMonday") == ["Tax due: Monday"]
    assert cut("Bring:\na pen") == ["Bring: a pen"]
    assert cut("Built in 1892. Sold.") == ["Built in 1892. Sold."]
    assert cut("• one • two") == ["one", "two"]
    assert cut("The rent - paid monthly - is due.") == ["The rent - paid monthly - is due."]
    assert cut("Owner\n01.05.2027") == ["Owner: 01.05.2027"] and cut("Rent\n3. Deposit") == ["Rent 3. Deposit"]
    assert cut("Born\nBorn: 1970") == ["Born: 1970"]
    assert cut("The form says:\nName: Ada\nTown: Ulm") == ["The form says:", "Name: Ada", "Town: Ulm"]
    assert cut("Who pays?\nThe tenant does.") == ["Who pays? The tenant does."]
    assert cut("The landlord and the tenant agree that the garden behind the house\nis shared.") == ["The landlord and the tenant agree that the garden behind the house is shared."]
    assert cut("**Bold** and <u>line</u>.") == ["Bold and line."]
    assert cut("طول 16 Ø متر") == ["طول", "16 متر"]
    assert cut(None) == cut(" \n") == []


def test_clean_up():
    assert folds.clean_paragraph("Sign ____ here\nWait... then go\nA .... b") == "Sign here\nWait... then go\nA b"
    assert folds.clean_paragraph("| a | b | c |\n|---|:-:|---|\n| 1 | | 2 | 3 | 4 |") == "a: 1, b: 2, c: 3, 4"
    assert folds.clean_paragraph("| Name | Ada |\n| only |") == "Name: Ada\nonly"


def test_chunks_carry_sections_and_join_labels():
    pages = [(1, "# Terms\n\nOwner\n\nAda\n\nPlease note:\n\nno pets"), (2, "Rent is due.")]
    assert folds.chunk_pages(pages) == [(1, "Terms", None), (1, "Owner: Ada", "Terms"), (1, "Please note: no pets", "Terms"), (2, "Rent is due.", "Terms")]
    assert folds.chunk_pages([(1, "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |")]) == [(1, "a: 1, b: 2, c: 3", None)]
    assert folds.chunk_pages([(1, "# Terms\n\nRent is due.")], True) == [(1, "Terms. Rent is due.", None)]


def test_fold_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(d, p, f"# H{d}\n\nLabel\n\nvalue {p}") for d in range(9) for p in (1, 2)], "doc_id long, page int, text string")
    assert sorted(passages.chunks(rows.repartition(1)).collect()) == sorted(passages.chunks(rows.repartition(7)).collect())


def test_nms_and_rows():
    boxes = [(0.9, 0, 0, 10, 10), (0.9, 1, 0, 11, 10), (0.5, 50, 0, 60, 10)]
    assert folds.nms(boxes, 0.6) == [0, 2]
    assert folds.visual_rows([0, 4, 30], [10, 14, 40]) == [0, 0, 1]
    boxes = [("text", 0, 0, 50, 10, "Name"), ("text", 0, 12, 50, 22, None), ("text", 0, 24, 50, 34, None), ("text", 99, 24, 150, 34, None), ("choice", 0, 36, 50, 46, None)]
    assert labels.handed_down(boxes, 10) == ["Name", "Name", "Name", None, None]
    comb = [("text", 12 * i, 0, 12 * i + 10, 10, "IBAN" if i == 0 else "x") for i in range(4)] + [("text", 200, 0, 210, 10, "y")]
    assert labels.handed_down(comb, 10) == ["IBAN"] * 4 + ["y"] and labels.handed_down(comb[:2], 10) == ["IBAN", "x"]


def test_pick_and_gap(spark):
    rows = [(1, 0, "It is amended here", 0.4), (1, 1, "best", 0.9), (1, 2, "close", 0.8), (2, 0, "only", 0.3), (3, 0, "effective now", 0.9), (3, 1, "close", 0.8)]
    got = {(r.q_id, r.pos): (r.kind, round(r.gap, 6)) for r in search.pick(spark.createDataFrame(rows, "q_id int, pos int, text string, score double")).collect()}
    assert got == {(1, 0): ("amendment", 0.1), (1, 1): ("best", 0.1), (1, 2): (None, 0.1), (2, 0): ("best", 1.0), (3, 0): ("best", 1.0), (3, 1): (None, 1.0)}


def test_answer(spark):
    chunks = spark.createDataFrame([(1, 0, 1, "The rent is due on Monday."), (1, 1, 1, "Cats sleep."), (2, 0, 1, "Nothing.")], "doc_id long, chunk_ix int, page int, text string")
    asked = spark.createDataFrame([(10, 1, "rent due Monday"), (11, 2, "rent due Monday"), (12, 3, "who")], "q_id long, doc_id long, question string")
    got = {r.q_id: (r.kind, r.sentences) for r in answer.answer(chunks, asked).collect()}
    assert got == {10: ("found", ["The rent is due on Monday."]), 11: ("not_found", []), 12: ("not_found", [])}


def test_commands(spark):
    row = spark.createDataFrame([("copy Bill same as Ship",)], "c string").select(T.same_as(F.col("c")).alias("s")).first()
    assert tuple(row.s) == ("copy Bill", "Ship")
    said = '{"function_calls":[{"name":"fill_field","arguments":{"field":"A"}},{"name":"fill_field","arguments":{"field":"zzz"}},{"name":"f","arguments":{"field":"A"}}],"suppressed_calls":[{"name":"x"},{"name":"fill_field","arguments":{"value":"held"}}]}'
    bad = spark.createDataFrame([(1, "no json"), (2, said)], "form_id int, answer string")
    listed = spark.createDataFrame([(f, "text", "A", 5, 1) for f in (1, 2)], "form_id int, grp string, label string, field_ix int, place int")
    assert [tuple(r) for r in forms.calls(bad, listed).collect()] == [(2, 0, "fill_field", 5, "", True, "")]
    assert [r[0] for r in bad.orderBy("form_id").select(forms.held_back(F.col("answer"))).collect()] == [None, "held"]


def test_values_and_parts(spark):
    one = lambda c, *args: spark.range(1).select(c(*[F.lit(a) for a in args])).first()[0]
    value = lambda c, m=None, h=None: one(lambda *a: T.extracted_value(F.lit(c), F.lit(m).cast("string"), F.lit(h).cast("string"), F.lit("D")))
    assert value("Owner: Ada Byron") == "Ada Byron" and value("Owner:") is None and value("rent is 12") == "12"
    assert value("due today") == "D" and value("due: Today!") == "D" and value("x", " m ", "h") == "m" and value("x", None, "h") == "h"
    assert value("call 0170 12 now") == "0170 12 now"
    assert one(T.after_label, "my full name Ada Byron", "Full name") == "Ada Byron"
    assert one(T.after_label, "my Ada", "Full name") is None and one(T.after_label, "full name", "Full name") is None
    assert one(T.command_parts, "name Ada, mobile 1 and town Ulm") == ["name Ada", "mobile 1", "town Ulm"]
    assert one(T.command_parts, "a, b: c") is None and one(T.command_parts, "1,200") is None


def test_proposals_with_a_model_and_by_parts(spark):
    fields = spark.createDataFrame([(1, 0, "text", 0.9, "Name"), (1, 1, "text", 0.8, "Mobile phone"), (1, 2, "tick", 0.1, "Paid")], "cmd_id int, field_ix long, grp string, score double, text string")
    commands = spark.createDataFrame([(1, "name Ada, mobile 17", "D")], "cmd_id int, command string, today string")
    both = '{"function_calls":[{"name":"fill_field","arguments":{"field":"Name","value":"Ada"}},{"name":"set_checkbox","arguments":{"field":"Paid","checked":false}}]}'
    got = forms.propose(commands, fields, lambda tools, command: F.when(tools.contains("Mobile phone"), F.lit(both))).first()
    assert [(a.field, a.kind, a.value, a.checked, a.alternatives) for a in got.actions] == [(0, "fill", "Ada", None, [1]), (2, "check", None, False, [])]
    alone = forms.propose(commands, fields)
    assert alone.first().actions[0].value == "17"
    parts = forms.parts_of(alone)
    assert [(r.part_ix, r.n_parts, r.part) for r in parts.collect()] == [(0, 2, "name Ada"), (1, 2, "mobile 17")]
    action = lambda f, v: [{"field": f, "kind": "fill", "value": v, "checked": None, "option": None, "source": None, "alternatives": []}]
    kinds = f"cmd_id int, form_id int, part_ix int, n_parts int, part string, kind string, actions array<{forms.ACTION}>"
    texts = spark.createDataFrame([(7, 0, "Name"), (7, 1, "Mobile phone")], "form_id int, field_ix long, text string")
    rows = [(1, 7, 0, 2, "name Ada", "actions", action(0, "Ada")), (1, 7, 1, 2, "mobile 17", "actions", action(1, "17")), (2, 7, 0, 2, "name Oak", "actions", action(0, "Oak")), (2, 7, 1, 2, "Apt 4", "actions", action(1, "4"))]
    merged = forms.merge(spark.createDataFrame(rows, kinds), texts).collect()
    assert [(r.cmd_id, [a.field for a in r.actions]) for r in merged] == [(1, [0, 1])]
    ids = spark.createDataFrame([(7, 0, 100), (7, 1, 101)], "form_id int, field_ix long, id long")
    named = forms.with_ids(spark.createDataFrame(rows[:1], kinds).withColumn("fields", F.array(F.lit(1).cast("long"))), ids).first()
    assert named.actions[0].field == 100 and named.fields == [101]
    text = forms.proposal_json(got and forms.propose(commands, fields)).first().proposal
    assert '"change":{"kind":"fill","value":"17"}' in text and '"kind":"actions"' in text


def test_ranking_weighs_texts(spark):
    texts = spark.createDataFrame([(1, 0, "text", 1.0, "a", 1), (1, 0, "text", 0.9, "b", 4), (1, 1, "tick", 1.0, "b", 1)], "form_id int, field_ix long, grp string, weight double, text string, ix int")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "text string, vec array<double>")
    asked = spark.createDataFrame([(5, 1, [0.6, 0.8])], "cmd_id int, form_id int, vec array<double>")
    got = {r.field_ix: (r.text, round(r.score, 6)) for r in forms.rank(texts, vectors, asked).collect()}
    assert got == {0: ("b", 0.72), 1: ("b", 0.8)}
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>")
    assert search.unit(zero, "v").first().v == [None, None] and search.unit(zero, "v", 1e-12).first().v == [0.0, 0.0]


def test_form_rows_answer(spark):
    def ask(question, scores, form_pages, short, texts=("2.1 Wanted plot number: B-14", "2.2 Plot size: 250", "Notes: none")):
        rows = [(1, 1, question, i, 1, None, t, s) for i, (t, s) in enumerate(zip(texts, scores, strict=True))]
        scored = spark.createDataFrame(rows, "doc_id int, q_id int, question string, pos int, page int, section string, text string, score double")
        forms_ = spark.createDataFrame([(1, form_pages, short)], "doc_id int, form_pages array<int>, short boolean")
        r = answer.decide(scored, forms_).first()
        return r.kind, [p.text for p in r.passages], r.confidence

    close = (0.57, 0.58, 0.55)
    assert ask("Who signs?", close, [1], False)[0] == "not_found"
    assert ask("How big is the plot size?", close, [1], False)[1] == ["2.2 Plot size: 250"]
    assert ask("What is the plot size?", (0.3, 0.42, 0.35), [1], False)[2] == 0.42
    assert ask("What is the plot size?", (0.3, 0.38, 0.35), [1], False)[0] == "not_found"
    assert ask("How big is the plot size?", close, [2], False)[0] == "not_found"
    assert ask("What is the plot size?", (0.3, 0.42, 0.35), [], True)[2] == 0.42
    assert ask("Wanted plot?", (0.57, 0.45, 0.55), [], True)[0] == "not_found"
    assert ask("What is the plot size?", (0.42, 0.3), [], True, ("Plot size: " + "as the office says " * 5, "Notes: none"))[0] == "not_found"
    assert ask("Wanted plot size?", (0.57, 0.45, 0.55), [1], False)[2] == 0.57


def test_answers_in_another_language_are_refused(spark):
    chunks = spark.createDataFrame([(1, 0, 1, "The rent of the house is due on Monday.")], "doc_id long, chunk_ix int, page int, text string")
    asked = spark.createDataFrame([(1, 1, "When is the rent due?"), (2, 1, "Wann ist die Miete und für wen ist das?"), (3, 1, "12")], "q_id long, doc_id long, question string")
    refused = language.refused(asked, chunks.select("doc_id", "text"))
    assert [tuple(r) for r in refused.collect()] == [(2, "english", "german")]
    got = {r.q_id: r.kind for r in answer.answer(chunks, asked, refused=refused).collect()}
    assert got == {1: "found", 2: "wrong_language", 3: "not_found"}
    texts = {r.q_id: r.answer for r in answer.answer_json(answer.answer(chunks, asked, refused=refused), refused).collect()}
    assert '"sentences":[{"page":1,"text":"The rent of the house is due on Monday."}]' in texts[1] and texts[2] == '{"kind":"wrong_language","document":"english","question":"german"}' and texts[3] == '{"kind":"not_found","bestConfidence":0.0}'
    page = spark.createDataFrame([("Latin", 2.0, "der Hund und das Haus"), ("Latin", 1.0, "x"), ("Cyrillic", 9.0, "x"), ("Arabic", 3.0, "پ چ")], "s string, c double, t string")
    assert [r[0] for r in page.select(language.page_language(F.col("s"), F.col("c"), F.col("t"))).collect()] == ["de", None, None, "fa"]


def test_merged_leaves_no_overlap(spark):
    kept = catalog.queries()["nms_greedy"](spark, SF)
    assert geometry.overlapping(kept, 0.3).count() == 0


def test_images():
    import numpy as np

    page = np.full((120, 120), 255, np.uint8)
    page[20:100:2, 20:100:2] = 0
    assert clean_halftone(page)[40:80, 40:80].min() == 255
    text = np.full((120, 120), 255, np.uint8)
    text[50:54, 20:100] = 0
    assert (clean_halftone(text) == text).all()
    assert grey(np.array([[[255, 0, 0, 255]]], np.uint8))[0, 0] == 76
    assert window_sum(np.ones((3, 3), np.int64), 1).tolist() == [[4, 6, 4], [6, 9, 6], [4, 6, 4]]
    assert median3(np.eye(3, dtype=np.uint8))[1, 1] == 0
    assert resize(np.full((4, 6), 9, np.uint8), 3, 2).tolist() == [[9] * 3] * 2
    assert resize(np.array([[0, 100]], np.uint8), 4, 1).tolist() == [[0, 25, 75, 100]]
    box, scale = letterbox(np.zeros((320, 640, 4), np.uint8))
    assert box.shape == (3, 640, 640) and scale == 1 and box[0, 639, 0] == 114 and box[0, 0, 0] == 0
    box, _ = letterbox(np.full((1263, 893, 4), 200, np.uint8))
    assert (box[0, 0] == 200).sum() == 452 and (box[0, 0, 452:] == 114).all()
    assert state_crop(np.zeros((50, 50, 3), np.uint8), (1.5, 1.5, 20, 10)).shape == (40, 160)
    dot = state_crop(np.zeros((50, 50, 3), np.uint8), (60, 60, 60, 60))
    assert (dot == -1).sum() == 40 * 40 and (dot == 1).sum() == 40 * 120


def test_halftone_seeds_every_dense_pixel():
    import numpy as np

    page = np.full((200, 200), 255, np.uint8)
    page[60:140:3, 60:140:3] = 0  # dots apart: few pixels are dots, but most of the area is dense
    page[100, 60:140] = 0
    got = clean_halftone(page)
    assert got[62:98, 62:98].min() == 255 and (got[:20] == page[:20]).all()


def test_saved_index(spark, tmp_path):
    chunks = catalog.chunks_of(spark, SF)
    index.save(chunks, str(tmp_path), "words", "line")
    back = index.load(spark, str(tmp_path), "words", "line")
    assert index.chunk_fingerprint(back["chunks"]).first() == index.chunk_fingerprint(chunks).first()
    with pytest.raises(index.IndexMismatch):
        index.load(spark, str(tmp_path), "other", "line")
    assert len(index.fingerprint(b"123456789", b"")) == 16


def test_stream_equals_batch(spark, tmp_path):
    from pageloom.streaming.incremental import index_stream

    src = tmp_path / "in"
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    docs.repartition(3).write.parquet(str(src))
    q = index_stream(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(src)), passages.line_chunks, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/postings")).drop("batch")
    want = search.postings(passages.line_chunks(spark.read.parquet(str(src))))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
