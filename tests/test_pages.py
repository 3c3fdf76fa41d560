"""Grids of PDF pieces and of recognised words, JSON input, and the contracts of models."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom import models
from pageloom.functions import folds, grids
from pageloom.operators import detect, forms, geometry, labels, ocr
from pageloom.operators.pdf import cut_at_lines
from pageloom.sources import form_input


def _lines(*rows):
    """Lines of (block, left, top, height, text), each word 8 wide a letter."""
    out = []
    for block, left, top, height, text in rows:
        line = grids.Line(block)
        for word in text.split():
            line.add(word, left, top, left + 8 * len(word), top + height)
            left += 8 * len(word) + 4
        out.append(line)
    return out


def test_recognised_forms_are_read_by_row():
    form = _lines(*[(1, 0, 20 * i, 12, t) for i, t in enumerate(("Name", "Town", "Phone"))], *[(2, 200, 20 * i + 2, 12, t) for i, t in enumerate(("Ada Byron", "Ulm", "12 34"))])
    assert grids.page_text(form) == "Name: Ada Byron\nTown: Ulm\nPhone: 12 34"
    apart = _lines(*[(1, 0, 50 * i, 12, t) for i, t in enumerate(("Name:", "Town", "Phone"))], *[(2, 200, 50 * i, 12, t) for i, t in enumerate(("Ada", "Ulm", "12"))])
    assert grids.page_text(apart) == "Name: Ada\n\nTown: Ulm\n\nPhone: 12"
    prose = "this column of a text goes on for more than forty letters"
    columns = _lines(*[(1, 0, 20 * i, 12, prose) for i in range(4)], *[(2, 600, 20 * i, 12, prose) for i in range(4)])
    assert ": " not in grids.page_text(columns)


def test_labels_over_values():
    boxes = _lines((1, 0, 0, 9, "NAME"), (1, 300, 0, 9, "TOWN"), (2, 0, 12, 12, "Ada Byron"), (2, 300, 12, 12, "Ulm"), (3, 0, 60, 12, "That is all."))
    assert grids.page_text(boxes) == "NAME: Ada Byron\nTOWN: Ulm\n\nThat is all."
    title = _lines((1, 0, 0, 30, "FORM"), (1, 0, 32, 12, "Ada Byron"))
    assert grids.page_text(title) == "FORM Ada Byron"
    rtl = _lines((1, 100, 0, 9, "نامم"), (1, 400, 0, 9, "شهرر"), (2, 84, 12, 12, "مریممم"), (2, 392, 12, 12, "تهرانن"))
    assert "نامم: مریممم" in grids.page_text([*rtl])


def test_pdf_grids():
    pieces = [p for i, (a, b) in enumerate((("Name", "Ada"), ("Name", "Name Byron"), ("Date", "1 2"), ("Key", "____"), ("Town", "Ulm"))) for p in (grids.Piece(50, 700 - 16 * i, 40, 10, a, False), grids.Piece(200, 696 - 16 * i, 60, 14, b, True))]
    assert grids.piece_grid([grids.Piece(50, 740, 90, 16, "A title", False), *pieces]) == "# A title\n\nName: Ada\nName Byron\nDate: 1 2\nKey\nTown: Ulm"
    assert grids.piece_grid(pieces[:6]) is None
    prose = [grids.Piece(x, 700 - 12 * i, 240, 10, "a line of a column that is longer than forty letters", False) for i in range(8) for x in (50, 320)]
    assert grids.piece_grid(prose) is None
    assert folds.visual_rows([0.0, 0.4], [0.2, 0.6]) == [0, 0]  # heights below 1 count as 1


def test_printed_lines():
    lines = ["Title", "Name: Ada", "Town: Ulm", "Phone: 12"]
    assert cut_at_lines("Intro.\n\nName: Ada Town: Ulm Phone: 12", lines) == "Intro.\n\nName: Ada\nTown: Ulm\nPhone: 12"
    assert cut_at_lines("Name: Ada Town: Ulm Phone: 13", lines) == "Name: Ada Town: Ulm Phone: 13"
    assert folds.printed_rows("a: b c: d", ["a: b", "c: d"]) is None


def test_labels_left_right_above_inside(spark):
    fields = [(1, 1, "text", 100, 0, 200, 12), (1, 2, "choice", 100, 40, 110, 50), (1, 3, "text", 300, 30, 400, 42), (1, 4, "text", 300, 100, 400, 140), (1, 5, "text", 500, 200, 600, 212), (1, 6, "text", 100, 300, 200, 312)]
    words = [(1, 0, "Full", 20, 0, 44, 10), (1, 1, "name:", 48, 0, 78, 10), (1, 2, "Paid", 115, 40, 139, 50), (1, 3, "Town", 300, 12, 324, 22), (1, 4, "Inside", 310, 104, 346, 114), (1, 5, "(Street)", 100, 314, 148, 324)]
    f = spark.createDataFrame(fields, "page int, box_id long, kind string, l int, t int, r int, b int")
    w = spark.createDataFrame(words, "page int, word_id long, text string, l int, t int, r int, b int")
    got = {r.box_id: r.label for r in labels.field_labels(f, w).collect()}
    assert got == {1: "Full name", 2: "Paid", 3: "Town", 4: "Inside", 5: None, 6: "Street"}
    assert {r.label for r in labels.field_labels(f, w.limit(0)).collect()} == {None}
    assert labels.field_labels(f.limit(0), w).count() == 0
    glyph = w.unionByName(spark.createDataFrame([(1, 9, "□", 85, 0, 95, 10)], w.schema))
    assert {r.box_id: r.label for r in labels.own_labels(f, glyph).collect()}[1] is None


def test_json_input(spark):
    one = lambda j: spark.createDataFrame([(1, j)], "form_id int, fields string")
    good = form_input.read_fields(one('[{"id":5,"page":1,"bounds":[1,2,3,4],"kind":"checkbox"}]')).first()
    assert (good.id, good.l, good.b, good.kind, good.options, good.read_only) == (5, 1.0, 4.0, "checkbox", None, False)
    for bad, what in (('{"id":1}', "array"), ("x", "array"), ('[{"page":1,"bounds":[1,2,3,4],"kind":"text"}]', "id"), ('[{"id":1,"page":1,"bounds":[1,2,3],"kind":"text"}]', "bounds"), ('[{"id":1,"page":1,"bounds":[1,2,3,4],"kind":"line"}]', "kind")):
        with pytest.raises(Exception, match=what):
            form_input.read_fields(one(bad)).collect()
    pages = spark.createDataFrame([(1, '[{"page":3,"words":[{"text":"a","bounds":[0,0,1,1]}]}]')], "form_id int, pages string")
    assert tuple(form_input.read_words(pages).first())[:5] == (1, 0, 3, 0, "a")
    text = 'a"\\\n\t\x01ü€😀'
    assert spark.createDataFrame([(text,)], "t string").select(forms.json_string(F.col("t"))).first()[0] == json.dumps(text)


def test_models_keep_their_contracts(spark):
    assert models.batches([5, 1, 9, 2], 2, 100) == [[1, 3], [0, 2]] and models.batches([10, 3000, 3000], 16, 4096) == [[0], [1], [2]]
    assert models.batches([1] * 20, 16, None) == [list(range(16)), list(range(16, 20))]
    texts = spark.createDataFrame([("a",), ("bbb",), (None,)], "t string")
    got = [r[0] for r in texts.select(models.embedder(lambda: lambda xs: [[len(x), 0] for x in xs])("t")).collect()]
    assert got == [[1.0, 0.0], [1.0, 0.0], None]
    with pytest.raises(Exception, match="numbers for"):
        texts.where("t is not null").coalesce(1).select(models.embedder(lambda: lambda xs: [1.0] * (len(xs) + 1))("t")).collect()
    pairs = spark.createDataFrame([("q", "s")], "q string, s string")
    assert pairs.select(models.reranker(lambda: lambda xs: [0.0] * len(xs))("q", "s")).first()[0] == 0.5
    with pytest.raises(Exception, match="logit"):
        pairs.select(models.reranker(lambda: lambda xs: [0.0] * 2 * len(xs))("q", "s")).collect()
    assert pairs.select(models.tool_model(lambda: lambda system, tools, c: "{}")("q", "s", "q")).first()[0] == "{}"
    assert pairs.select(models.script_model(lambda: lambda g, w, h: ("Latin", 2.0))("q", "s", "q")).first()[0].script == "Latin"
    assert pairs.select(models.detector(lambda: lambda g, w, h: np.ones(16))("q", "s", "q")).first()[0] == [[1.0] * 8] * 2
    assert pairs.select(models.state_model(lambda: lambda g: (0.1, 0.3))("q")).first()[0] is True
    assert pairs.select(models.recogniser(lambda: lambda g, w, h, x: "5\t")("q", "s", "q", "s")).first()[0] == "5\t"


def test_regions_and_order(spark):
    pages = spark.createDataFrame([(1, 1000)], "page int, height int")
    assert [(r.region, r.y0, r.y1) for r in geometry.regions(pages).collect()] == [(0, 0, 1000), (1, 0, 560), (2, 440, 1000)]
    boxes = spark.createDataFrame([(1, 1, "choice", 0.9, True, 0.0, 0.0, 1.0, 1.0), (1, 2, "text", 0.3, None, 1.0, 2.0, 3.0, 4.0)], "page int, box_id long, kind string, score double, filled boolean, l double, t double, r double, b double")
    assert [round(v, 3) for v in geometry.flattened(boxes).first().v] == [0, 0.3, 1, 2, 3, 4, -1, 1, 0.9, 0, 0, 1, 1, 1]


def test_fields_on_page_images(spark):
    def detector():
        def run(image):
            assert image.shape == (3, 640, 640)
            wide = [[100.0, 50.0 + 60 * i, 80.0, 20.0, 0.9, 0.8, 0.1, 0.0] for i in range(3)]
            return [*wide, [100.0, 50.0, 80.0, 20.0, 0.9, 0.3, 0.6, 0.0], [300.0, 300.0, 9.0, 9.0, 0.1, 0.9, 0.0, 0.0]]

        return run

    white = bytes([255] * 4 * 640 * 640)
    pages = spark.createDataFrame([(1, white, 640, 640), (2, b"bad", 640, 640), (3, None, None, None)], "page long, rgba binary, width int, height int")
    assert {r.page: r.error is None for r in detect.checked(pages).collect()} == {1: True, 2: False, 3: False}
    one = detect.find_fields(pages, detector, tiles=False).collect()
    assert [(r.page, r.kind, r.l, r.t, round(r.score, 2), r.filled) for r in one] == [(1, "text", 60.0, 40.0 + 60 * i, 0.72, None) for i in range(3)]
    assert detect.find_fields(pages, lambda: lambda image: [[100.0, 50.0, 80.0, 20.0, 0.9, 0.8, 0.1, 0.0]], tiles=False).count() == 0
    tiled = detect.find_fields(pages, detector, lambda: lambda crop: (0.0, float(crop.mean())))
    assert tiled.where("kind = 'text' and filled").count() >= 6 and geometry.overlapping(tiled).count() == 0
    prepared = spark.createDataFrame([(7, bytes(3 * 640 * 640), 0.5)], "page long, rgb binary, scale double")
    assert [(r.l, r.t) for r in detect.find_prepared(prepared, detector).collect()] == [(120.0, 80.0 + 120 * i) for i in range(3)]


def test_scanned_pages(spark):
    row = lambda block, line, left, top, text, conf: "\t".join(map(str, (5, 1, block, 1, line, 1, left, top, 8 * len(text), 12, conf, text)))
    tsv_text = "\n".join(["level\tpage", *[row(1, i, 0, 20 * i, t, 90) for i, t in enumerate(("der", "und", "mit"))], row(2, 9, 0, 90, "das", 80)])
    model = lambda: lambda grey, w, h, codes: tsv_text if codes in ("eng", "eng+deu") else ""
    pages = spark.createDataFrame([(1, bytes(4 * 9), 3, 3, ["english", "german"]), (2, b"bad", 3, 3, ["english"])], "page_id long, rgba binary, width int, height int, languages array<string>")
    texts, words = ocr.read(pages, model)
    assert [tuple(r) for r in texts.collect()] == [(1, "der und mit\n\ndas", 0.9)]
    assert [(r.text, r.line_no, r.confidence) for r in words.orderBy("ix").collect()] == [("der", 0, 0.9), ("und", 1, 0.9), ("mit", 2, 0.9), ("das", 3, 0.8)]
    found = ocr.languages(pages.drop("languages"), lambda: lambda g, w, h: ("Latin", 2.0), model)
    assert [tuple(r) for r in found.collect()] == [(1, "Latin", "de")]
    assert [tuple(r) for r in ocr.languages(pages.drop("languages"), lambda: lambda g, w, h: ("Latin", 1.0), model).collect()] == [(1, None, None)]


def test_merged_fields(spark):
    rows = [
        (1, 1, "text", 0.9, 0.0, 0.0, 10.0, 10.0),
        (1, 2, "text", 0.8, 0.0, 0.0, 10.0, 9.0),  # the same place as 1
        (1, 3, "choice", 0.5, 1.0, 1.0, 9.0, 9.0),  # covered by 1, of another kind
        (1, 4, "text", 0.1, 50.0, 0.0, 60.0, 10.0),  # too weak
        (1, 5, "choice", 0.9, 8.0, 0.0, 30.0, 10.0),  # overlaps 1 by little
        (2, 6, "choice", 0.3, 1.0, 1.0, 9.0, 9.0),
    ]
    boxes = spark.createDataFrame(rows, "page int, box_id long, kind string, score double, l double, t double, r double, b double")
    assert sorted(r.box_id for r in geometry.merged(boxes).collect()) == [1, 5, 6]
    assert [r.box_id for r in geometry.ordered(geometry.merged(boxes)).where("page = 1").orderBy("place").collect()] == [1, 5]
