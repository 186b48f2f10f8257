"""Language packs: one sample a language, comment stripping line by line, choice of a pack, and the linked graph."""

import pytest
from pyspark.sql import functions as F

from weftline.operators.rules import packs

#: pack: (text, units, relations)
SAMPLES = {
    "vb6": ("Private Sub Load()\n  Call Fill ' Call Not\n  frmMain.Show\nEnd Sub", {"Load"}, {("calls", "Load", "Fill"), ("navigates_to", "Load", "frmMain")}),
    "vba": ("Sub Run()\nDoCmd.OpenForm \"Orders\"\nEnd Sub", {"Run"}, {("navigates_to", "Run", "Orders")}),
    "vbnet": ("Imports System.Data\nPublic Class Box\nInherits Base", {"Box"}, {("includes", "a", "System.Data"), ("inherits", "Box", "Base")}),
    "vbscript": ("Sub Go()\nSet x = Server.CreateObject(\"ADODB.Connection\")", {"Go"}, {("uses", "Go", "ADODB.Connection")}),
    "rpg": ("begsr calc;\nexsr other;\nexfmt panel;\nendsr;", {"CALC"}, {("calls", "CALC", "OTHER"), ("displays", "CALC", "PANEL")}),
    "cl": ("START: PGM\n/* CALL PGM(NOT) */ CALL PGM(LIB/NEXT)", {"START"}, {("calls", "START", "NEXT")}),
    "natural": ("DEFINE SUBROUTINE WORK\nCALLNAT 'SUB1' /* CALLNAT 'NO'\nPERFORM TAIL", {"WORK"}, {("calls", "WORK", "SUB1"), ("calls", "WORK", "TAIL")}),
    "pli": ("MAIN: PROC OPTIONS(MAIN);\nCALL STEP;\nREAD FILE (INP) INTO (X);", {"MAIN"}, {("calls", "MAIN", "STEP"), ("reads", "MAIN", "INP")}),
    "asm": ("PROG1    CSECT\n* CALL NOT\n         CALL  SUBR", {"PROG1"}, {("calls", "PROG1", "SUBR")}),
    "rexx": ("start:\ncall helper\n/* call nobody */", {"start"}, {("calls", "start", "helper")}),
    "clist": ("LOOP: DO\n%OTHER", {"LOOP"}, {("calls", "LOOP", "OTHER")}),
    "easytrieve": ("JOB INPUT PAYFILE\nCALC. PROC\nPERFORM SHOW", {"CALC"}, {("reads", "A", "PAYFILE"), ("calls", "CALC", "SHOW")}),
    "sas": ("%macro load;\ndata out.x;\nset in.y;\n* set in.z;\n%mend;", {"load"}, {("writes", "load", "out.x"), ("reads", "load", "in.y")}),
    "plsql": ("PROCEDURE pay IS BEGIN\n-- select a from no_table\nSELECT a FROM emp;\nUPDATE dept SET a = 1;", {"pay"}, {("reads", "pay", "emp"), ("writes", "pay", "dept")}),
    "tsql": ("CREATE PROCEDURE dbo.fill AS\nEXEC dbo.next_step\nDELETE FROM logs", {"dbo.fill"}, {("calls", "dbo.fill", "dbo.next_step"), ("writes", "dbo.fill", "logs"), ("reads", "dbo.fill", "logs")}),
    "powerbuilder": ("global type w_main from window\npublic function integer of_go ();\nOpen(w_next)", {"w_main", "of_go"}, {("navigates_to", "of_go", "w_next")}),
    "coldfusion": ('<cffunction name="getAll">\n<cfinclude template="top.cfm"><!--- <cfinclude template="no.cfm"> --->', {"getAll"}, {("includes", "getAll", "top.cfm")}),
    "php": ("<?php\nfunction go() {\n include 'lib.php'; // include 'no.php'\n $x = new Box();", {"go"}, {("includes", "go", "lib.php"), ("uses", "go", "Box")}),
    "perl": ("use Data::Dumper;\nsub run {\n &step(1); # &no(1)", {"run"}, {("includes", "a", "Data::Dumper"), ("calls", "run", "step")}),
    "shell": ("load() {\n . ./env.sh # . ./no.sh\n sqlplus x", {"load"}, {("includes", "load", "./env.sh"), ("uses", "load", "sqlplus")}),
    "batch": (":top\nREM call :no\ncall :sub\ncall next.bat", {"top"}, {("calls", "top", "sub"), ("calls", "top", "next.bat")}),
    "powershell": ("function Get-It {\nImport-Module Tools # Import-Module No\n}", {"Get-It"}, {("includes", "Get-It", "Tools")}),
    "python": ("import os  # import sys\nclass Box(Base):\n    def go(self):\n        pass", {"Box", "go"}, {("includes", "a", "os"), ("inherits", "Box", "Base")}),
    "javascript": ("const x = require('lib'); // require('no')\nfunction go() {\n fetch('/api');", {"go"}, {("includes", "a", "lib"), ("uses", "go", "/api")}),
    "delphi": ("procedure TForm.Go;\nbegin { Other.ShowModal }\n Dialog.ShowModal;", {"TForm.Go"}, {("navigates_to", "TForm.Go", "Dialog")}),
    "foxpro": ("PROCEDURE load\nUSE customers\nDO next_one && DO nothing", {"load"}, {("uses", "load", "customers"), ("calls", "load", "next_one")}),
    "informix4gl": ("FUNCTION show()\nCALL next_one() # CALL no()\nSELECT a FROM t", {"show"}, {("calls", "show", "next_one"), ("reads", "show", "t")}),
    "progress": ("PROCEDURE go:\nRUN other.p.\nFOR EACH customer NO-LOCK:", {"go"}, {("calls", "go", "other.p."), ("reads", "go", "customer")}),
    "fortran": ("subroutine go\nuse shapes\ncall draw(x) ! call no", {"go"}, {("includes", "go", "shapes"), ("calls", "go", "draw")}),
    "basic": ("SUB Go\nCALL Fill ' CALL Not", {"Go"}, {("calls", "Go", "Fill")}),
}


def test_every_pack_has_a_sample():
    assert SAMPLES.keys() == packs.PACKS.keys()


def test_units_and_relations_of_each_language(spark):
    docs = spark.createDataFrame([(i, f"src/a.{packs.PACKS[p].extensions[0]}", p, text) for i, (p, (text, _, _)) in enumerate(SAMPLES.items())], "doc_id long, name string, pack string, text string")
    entities, relations = packs.extracted(docs)
    units, used = {}, {}
    for r in entities.where("kind <> 'program'").collect():
        units.setdefault(r.doc_id, set()).add(r.name)
    for r in relations.collect():
        used.setdefault(r.doc_id, set()).add((r.kind, r.source, r.target))
    for i, (pack, (_, want_units, want_used)) in enumerate(SAMPLES.items()):
        assert units.get(i, set()) == want_units, pack
        assert used.get(i, set()) == want_used, pack
    picked = packs.chosen(docs.withColumn("language", F.lit(None).cast("string"))).collect()
    assert all(r.pack == list(SAMPLES)[r.doc_id] and r.by == "extension" for r in picked)


def test_choice_by_language_and_by_signs(spark):
    rows = [(1, "x.unknown", "Visual Basic 6", ""), (2, None, None, "import os\ndef f(x):\n    pass\nclass A:\n    self.x = 1"), (3, "x", "", "just a few words"), (4, "q.html", None, ""), (5, None, None, None)]
    got = {r.doc_id: (r.pack, r.by) for r in packs.chosen(spark.createDataFrame(rows, "doc_id long, name string, language string, text string")).collect()}
    assert got == {1: ("vb6", "language"), 2: ("python", "signs"), 3: (None, None), 4: ("markup", "extension"), 5: (None, None)}


@pytest.mark.parametrize(
    ("style", "text", "want"),
    [
        ("c", 'a = "// no"; // yes\n/* x\ny */ b', 'a = "// no"; \n    \n     b'),
        ("c", "open /* never\nclosed", "open         \n      "),
        ("c", "s = 'it\\'s // in'; //c", "s = 'it\\'s // in'; "),
        ("sql", "select '--' -- c\nfrom t /* a */ x", "select '--' \nfrom t         x"),
        ("vb", "x = \"it's\" ' note\nREM all\ny", "x = \"it's\" \n\ny"),
        ("star", "000100* gone\n000200 STAYS *> tail", "\n000200 STAYS "),
        ("markup", "a <!-- b\nc --> d <!--[if IE]> e", "a       \n      d <!--[if IE]> e"),
        ("props", "# a\nb=1 # kept\n ! c", "\nb=1 # kept\n"),
        ("none", "# a", "# a"),
    ],
)
def test_comments_go_and_lines_stay(spark, style, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(packs.stripped(F.col("t"), style).alias("s")).first().s
    assert got == want and got.count("\n") == text.count("\n")


def test_long_texts_are_stripped_whole(spark):
    text = 'x = "' + "a\\\\" * 50_000 + '"; // c\n' + "/* " + "b\n" * 50_000 + "*/ y"
    got = spark.createDataFrame([(text,)], "t string").select(packs.stripped(F.col("t"), "c").alias("s")).first().s
    assert got.count("\n") == text.count("\n") and got.endswith(" y") and "//" not in got and "b" not in got


def test_linked_graph(spark):
    docs = [(1, "main.py", "python", "import util\nclass Box(Base):\n    pass"), (2, "util.py", "python", "def go():\n    pass"), (3, "jcl1.rexx", "rexx", "start:\ncall util\ncall start2\nstart2:\n")]
    entities, relations = packs.extracted(spark.createDataFrame(docs, "doc_id long, name string, pack string, text string"))
    nodes, edges = packs.linked(packs.structured(entities), relations, entities)
    found = {(r.from_node, r.to_node, r.kind) for r in edges.collect()}
    assert found == {("program:MAIN", "module:UTIL", "includes"), ("class:MAIN.BOX", "class:BASE", "inherits"), ("function:JCL1.START", "program:UTIL", "calls"), ("function:JCL1.START", "function:JCL1.START2", "calls")}
    assert {r.node for r in nodes.where("origin = 'placeholder'").collect()} == {"module:UTIL", "class:BASE"}


def test_lines_behind_a_units_end_belong_to_the_program(spark):
    texts = [
        ("a.frm", "vb6", "Sub One()\nCall Inner\nEnd Sub\nCall Outer\nSub Two()\nCall Last\nEnd Sub\n", {("One", "Inner"), ("a", "Outer"), ("Two", "Last")}),
        ("b.py", "python", "import m0\nclass C:\n    def one(self):\n        import m1\n\n    x = 1\n    import m2\nimport m3\ndef two():\n    import m4\n", {("b", "m0"), ("one", "m1"), ("C", "m2"), ("b", "m3"), ("two", "m4")}),
        ("c.php", "php", "<?php\nfunction one()\n{\n  if (a) {\n    include 'x1';\n  }\n  include 'x2';\n}\ninclude 'x3';\nfunction two() { include 'x4'; }\ninclude 'x5';\nclass K {\n  function three() {\n    include 'x6';\n  }\n  include 'x7';\n}\n", {("one", "x1"), ("one", "x2"), ("c", "x3"), ("two", "x4"), ("c", "x5"), ("three", "x6"), ("K", "x7")}),
        ("d.sas", "sas", "%macro m;\n%include 'i1';\n%mend;\n%include 'i2';\n", {("m", "i1"), ("d", "i2")}),
        ("e.bat", "batch", "call :x\n:one\ncall :y\n:two\ncall :z\n", {("e", "x"), ("one", "y"), ("two", "z")}),
    ]
    docs = spark.createDataFrame([(i, n, p, t) for i, (n, p, t, _) in enumerate(texts)], "doc_id long, name string, pack string, text string").repartition(3)
    _, relations = packs.extracted(docs)
    got = {}
    for r in relations.collect():
        got.setdefault(r.doc_id, set()).add((r.source, r.target))
    for i, (name, _, _, want) in enumerate(texts):
        assert got[i] == want, name
