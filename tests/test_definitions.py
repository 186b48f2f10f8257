"""API definitions, UI screens, capture quality and delivered texts on hand-made cases."""

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import reports
from weftline.operators.rules import definitions


def test_definitions_that_cannot_be_read_give_no_row(spark):
    texts = [None, "", "{", "[]", '{"openapi": "3"}', '{"paths": {"/a": {"get": {}}}}', "<definitions> wsdl", '{"swagger": "2", "paths": {"/a": 1, "/b": {"get": 2, "post": {}, "x-note": {}}}, "security": [{}]}']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = definitions.api_endpoints(docs).collect()
    assert [(r.doc_id, r.name, r.line, r.secured, r.deprecated) for r in got] == [(7, "POST /b", 1, True, None)]
    assert definitions.api_hosts(docs).collect() == []


def test_screens(spark):
    texts = [None, "x", '{"m": "1"}', '{"m": "1", "title": "", "fields": [{"label": "A (2)"}, {"label": "A"}, {"label": "A"}], "actions": [{"label": "A", "kind": "menu"}, {"kind": "link"}]}']
    got = definitions.ui_elements(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "m").collect()
    assert [(r.screen, r.name, r.kind, r.input, r.action) for r in got] == [("screen", "A (2)", None, True, False), ("screen", "A", None, True, False), ("screen", "A (3)", None, True, False), ("screen", "A (action)", "menu", False, True)]


def test_capture_quality(spark):
    docs = spark.createDataFrame([(1, "a\nb [CUT OFF]\nc", True, False), (2, "a", None, None), (3, None, True, False), (4, "[CUT OFF]", True, True), (5, "a\nb", True, False)], "doc_id int, text string, verified boolean, exact boolean")
    flags = spark.createDataFrame([(1, 1, "edited", True), (1, 3, "wrapped", None), (3, None, "partial", None), (5, 1, "glyph", None), (5, 2, "glyph", None), (9, 1, "rows", None)], "doc_id int, line int, kind string, literal boolean")
    concerns = spark.createDataFrame([(1, 3), (1, 7), (1, None)], "doc_id int, line int")
    got = {r.doc_id: (r.status, [tuple(i) for i in r.issues], r.bad_lines) for r in reports.capture_quality(docs, flags, concerns).collect()}
    assert got == {
        1: ("rescan", [("cut", "2"), ("mismatch", "3"), ("model", "3,7"), ("prose", "1")], [2, 3]),
        2: ("unchecked", [], []),
        3: ("rescan", [("partial", "")], []),
        4: ("good", [], []),
        5: ("good", [("glyph", "1-2")], []),
    }


def test_delivered(spark):
    terms = ("Some Agency", "ACME")
    cases = {None: None, "": "", "some agency, Some_Agency_x.cbl": "$C, $C_x.cbl", "xACME ACMEx acme": "xACME $Cx acme", "a__b_.txt\x01\x0bz": "a_b.txt z"}
    docs = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in docs.select("t", tx.delivered(F.col("t"), terms, "$C").alias("d")).collect()} == cases
    assert docs.select(tx.delivered(F.col("t"), ()).alias("d")).where("d = ''").count() == 1


def test_a_definition_behind_a_long_comment(spark):
    text = "<?xml version='1.0'?>\n<!-- " + "long " * 4000 + "-->\n<!-- wsdl -->\n<wsdl:definitions name='S'><wsdl:portType name='P'><wsdl:operation name='Go'/></wsdl:portType></wsdl:definitions>"
    other = "<page><!-- <definitions> of wsdl --></page>"
    frame = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    assert [(r.doc_id, r.path) for r in definitions.api_endpoints(frame).collect()] == [(1, "S/Go")]


def test_labels_that_differ_late_are_two_names(spark):
    a, b = "x" * 90 + "a", "x" * 90 + "b"
    frame = spark.createDataFrame([(1, f'{{"ui": "1", "title": "{a}", "fields": [{{"label": "{a}"}}, {{"label": "{b}"}}]}}')], "doc_id long, text string")
    rows = definitions.ui_elements(frame, "ui").collect()
    assert [r.name for r in rows] == [a, b] and {r.screen for r in rows} == {a}
