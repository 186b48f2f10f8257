"""COBOL, copybooks, EXEC blocks, maps and jobs against lists written by hand."""

import pytest

from weftline.operators.rules import mainframe


def numbered(text, tail=""):
    """Rows as columns 7 to 72, with sequence numbers in front."""
    return "".join(f"{100 * (i + 1) % 1_000_000:06d}{row}{tail}\n" for i, row in enumerate(text.strip("\n").split("\n")))


BATCH = """
 IDENTIFICATION DIVISION.
 PROGRAM-ID. PAYRUN.
* COPY NOTHING.
 ENVIRONMENT DIVISION.
 INPUT-OUTPUT SECTION.
 FILE-CONTROL.
     SELECT STAFF-FILE ASSIGN TO STAFFIN
         ORGANIZATION IS SEQUENTIAL.
     SELECT OPTIONAL PAY-FILE
         ASSIGN TO 'PAYOUT'.
 DATA DIVISION.
 FILE SECTION.
 FD  STAFF-FILE.
     COPY STAFFREC.
 FD  PAY-FILE.
 01  PAY-REC.
     05  PAY-ID                PIC X(6).
     05  PAY-AMOUNT            PIC 9(9)V99.
 WORKING-STORAGE SECTION.
 01  WS-FLAGS.
     05  WS-EOF                PIC X VALUE 'N'.
         88  END-OF-FILE       VALUE 'Y'.
     05  FILLER                PIC X(3).
     05  WS-GROUP.
         10  WS-INNER          PIC S9(4) COMP.
     05  WS-LAST               PIC X.
 77  WS-COUNT                  PIC 9(4).
 01  WS-TEXT                   PIC X(20) VALUE 'A LONG
-    ' LITERAL'.
 PROCEDURE DIVISION.
 0000-MAIN SECTION.
 0000-START.
     OPEN INPUT STAFF-FILE
          OUTPUT PAY-FILE
     PERFORM 1000-READ THRU 2000-CALC
     PERFORM 3 TIMES
         DISPLAY 'X'
     END-PERFORM
     PERFORM UNTIL END-OF-FILE
         CONTINUE
     END-PERFORM
     CALL 'AUDIT' USING WS-COUNT
     MOVE 'SUBA' TO WS-PGM
     CALL WS-PGM
     CALL WS-OTHER
     PERFORM 9000-IN-COPYBOOK
     GOBACK.
 1000-READ.
     READ STAFF-FILE AT END SET END-OF-FILE TO TRUE.
 2000-CALC.
     WRITE PAY-REC
     DELETE STAFF-FILE
     REWRITE OTHER-REC.
 3000-SIDE SECTION.
 3100-DO.
     PERFORM 1000-READ.
     EXIT.
"""
BATCH_RELATIONS = {
    ("includes", "PAYRUN", "copybook:STAFFREC", 14),
    ("reads", "0000-START", "data_store:STAFF-FILE", 33),
    ("writes", "0000-START", "data_store:PAY-FILE", 34),
    ("calls", "0000-START", "1000-READ", 35),
    ("calls", "0000-START", "program:AUDIT", 42),
    ("calls", "0000-START", "program:SUBA", 44),
    ("calls", "0000-START", "paragraph:PAYRUN.9000-IN-COPYBOOK", 46),
    ("reads", "1000-READ", "data_store:STAFF-FILE", 49),
    ("writes", "2000-CALC", "data_store:PAY-FILE", 51),
    ("writes", "2000-CALC", "data_store:STAFF-FILE", 52),
    ("calls", "3100-DO", "1000-READ", 56),
}
ONLINE = """
 IDENTIFICATION DIVISION.
 PROGRAM-ID. ASKPAY.
 DATA DIVISION.
 WORKING-STORAGE SECTION.
     EXEC SQL INCLUDE SQLCA END-EXEC.
     EXEC SQL INCLUDE PAYTAB END-EXEC.
 01  WS-ID                     PIC X(6).
 PROCEDURE DIVISION.
 MAIN-PARA.
     EXEC CICS RECEIVE MAP('PAYM1') MAPSET('PAYMS')
         RESP(WS-RESP)
     END-EXEC
     IF WS-BAD EXEC CICS XCTL PROGRAM('PAYERR') END-EXEC
     END-IF
     PERFORM FETCH-PAY
*    EXEC CICS LINK PROGRAM('NOPE') END-EXEC
     EXEC CICS SEND MAP('PAYM1') MAPSET('PAYMS') ERASE END-EXEC
     EXEC CICS READ FILE('PAYVS') INTO(WS-REC)
         RIDFLD(WS-KEY) END-EXEC
     EXEC CICS WRITEQ TS QUEUE('PAYTQ') FROM(WS-REC) END-EXEC
     EXEC CICS RETURN TRANSID('PAYT')
         COMMAREA(WS-AREA)
     END-EXEC.
 FETCH-PAY.
     EXEC SQL
         UPDATE HR.PAY SET TOTAL = :WS-TOTAL
         WHERE ID IN (SELECT ID FROM HR.STAFF JOIN HR.UNIT)
     END-EXEC
     EXEC SQL DELETE FROM HR.TEMP WHERE 1 = 1 END-EXEC
     EXEC CICS LINK PROGRAM('OPENEND')
     CALL 'AFTER'.
 NEXT-PARA.
     CALL 'LAST'.
"""
ONLINE_RELATIONS = {
    ("includes", "ASKPAY", "copybook:PAYTAB"),
    ("reads", "MAIN-PARA", "screen:PAYM1"),
    ("calls", "MAIN-PARA", "program:PAYERR"),
    ("calls", "MAIN-PARA", "FETCH-PAY"),
    ("displays", "MAIN-PARA", "screen:PAYM1"),
    ("reads", "MAIN-PARA", "data_store:PAYVS"),
    ("writes", "MAIN-PARA", "data_store:PAYTQ"),
    ("invokes_transaction", "MAIN-PARA", "transaction:PAYT"),
    ("writes", "FETCH-PAY", "table:HR.PAY"),
    ("reads", "FETCH-PAY", "table:HR.STAFF"),
    ("reads", "FETCH-PAY", "table:HR.UNIT"),
    ("writes", "FETCH-PAY", "table:HR.TEMP"),
    ("calls", "FETCH-PAY", "program:OPENEND"),
    ("calls", "FETCH-PAY", "program:AFTER"),
    ("calls", "NEXT-PARA", "program:LAST"),
}


def docs(spark, *texts):
    return spark.createDataFrame([(i, n, t, "x", 1) for i, (n, t) in enumerate(texts)], "doc_id long, name string, text string, doc string, n int").repartition(2)


@pytest.fixture(scope="module")
def programs(spark):
    bare = "".join(f"       {row[1:]}\n" if row[:1] == " " else f"      {row}\n" for row in BATCH.strip("\n").split("\n"))
    shifted = "".join((row if row[:1] in "*-" else row[1:]) + "\n" for row in BATCH.strip("\n").split("\n"))
    shifted = shifted.replace("-    ' LITERAL'.\n", "").replace("'A LONG\n", "'A'.\n")
    texts = [("PAYRUN.cbl", numbered(BATCH)), ("lib/ASKPAY.cbl", numbered(ONLINE)), ("BARE.cbl", bare), ("SHIFTED.cbl", shifted), ("EMPTY.cbl", ""), ("NONE.cbl", None)]
    texts.append(("WIDE.cbl", "".join(f"{r:<72}CALL 'COL73'.\n" for r in numbered(BATCH).rstrip("\n").split("\n"))))
    entities, relations = mainframe.cobol(docs(spark, *texts))
    return entities.collect(), relations.collect(), entities, relations


def test_batch_program(programs):
    entities, relations, *_ = programs
    own = [e for e in entities if e.doc == "0"]
    assert {(r.kind, r.source, r.target, r.n) for r in relations if r.doc == "0"} == BATCH_RELATIONS
    assert {(e.name, e.parent, e.n, e.last_n) for e in own if e.kind in ("section", "paragraph")} == {("0000-MAIN", "PAYRUN", 31, 52 + 1), ("0000-START", "0000-MAIN", 32, 47), ("1000-READ", "0000-MAIN", 48, 49), ("2000-CALC", "0000-MAIN", 50, 53), ("3000-SIDE", "PAYRUN", 54, 57), ("3100-DO", "3000-SIDE", 55, 57)}
    assert {(e.name, e.parent, e.attrs.get("picture"), e.attrs["level"]) for e in own if e.kind == "field"} == {
        ("PAY-REC", "PAYRUN", None, "1"), ("PAY-ID", "PAY-REC", "X(6)", "5"), ("PAY-AMOUNT", "PAY-REC", "9(9)V99", "5"), ("WS-FLAGS", "PAYRUN", None, "1"), ("WS-EOF", "WS-FLAGS", "X", "5"), ("END-OF-FILE", "WS-EOF", None, "88"),
        ("WS-GROUP", "WS-FLAGS", None, "5"), ("WS-INNER", "WS-GROUP", "S9(4)", "10"), ("WS-LAST", "WS-FLAGS", "X", "5"), ("WS-COUNT", "PAYRUN", "9(4)", "77"), ("WS-TEXT", "PAYRUN", "X(20)", "1"),
    }
    assert {(e.name, e.attrs["assign"]) for e in own if e.kind == "data_store"} == {("STAFF-FILE", "STAFFIN"), ("PAY-FILE", "PAYOUT")}
    (program,) = [e for e in own if e.kind == "program"]
    assert (program.name, program.n, program.last_n, program.attrs) == ("PAYRUN", 1, 57, {"language": "COBOL", "dynamic_calls": "WS-OTHER"})
    told = {(r.target, r.n): r.attrs for r in relations if r.doc == "0"}
    assert told["copybook:STAFFREC", 14] == {"section": "FD STAFF-FILE"} and told["1000-READ", 35] == {"verb": "PERFORM", "thru": "2000-CALC"}
    assert told["program:SUBA", 44] == {"verb": "CALL", "dynamic": "WS-PGM"} and told["data_store:PAY-FILE", 51] == {"verb": "WRITE", "record": "PAY-REC"}


def test_other_layouts_give_the_same(programs):
    entities, relations, *_ = programs
    base = {(r.kind, r.source, r.target) for r in relations if r.doc == "0"}
    for doc in ("2", "3", "6"):
        assert {(r.kind, r.source, r.target) for r in relations if r.doc == doc} == base, doc
    assert not [e for e in entities if e.doc in ("4", "5")]


def test_online_program(programs):
    entities, relations, *_ = programs
    assert {(r.kind, r.source, r.target) for r in relations if r.doc == "1"} == ONLINE_RELATIONS
    told = {(r.kind, r.target): r.attrs for r in relations if r.doc == "1"}
    assert told["displays", "screen:PAYM1"] == {"verb": "CICS SEND MAP", "mapset": "PAYMS"} and told["reads", "data_store:PAYVS"] == {"verb": "CICS READ", "store_type": "VSAM"}
    (program,) = [e for e in entities if e.doc == "1" and e.kind == "program"]
    assert program.attrs["open_blocks"] == "30"


def test_performed_ranges(programs):
    *_, entities, relations = programs
    got = {(r.source, r.paragraph, r.n) for r in mainframe.performed(entities, relations).where("doc = '0'").collect()}
    assert got == {("0000-START", "1000-READ", 35), ("0000-START", "2000-CALC", 35), ("3100-DO", "1000-READ", 56)}


def test_copybooks_that_copy_others(spark, programs):
    *_, relations = programs
    books = docs(spark, ("STAFFREC.cpy", numbered(" 01  STAFF-REC.\n     05  STAFF-ID  PIC X(6).\n     COPY ADDRREC.")), ("ADDRREC.cpy", numbered(" 05  STREET  PIC X(30).\n     COPY STAFFREC.")), ("PAYTAB.cpy", numbered(" 01 PAY-TAB PIC X.")))
    entities, inner = mainframe.copybooks(books)
    assert {(r.source, r.target) for r in inner.collect()} == {("STAFFREC", "copybook:ADDRREC"), ("ADDRREC", "copybook:STAFFREC")}
    got = {(r.doc, r.copybook, r.field) for r in mainframe.included_fields(relations, entities, inner).collect()}
    assert {g for g in got if g[0] in "01"} == {("0", "STAFFREC", "STAFF-REC"), ("0", "STAFFREC", "STAFF-ID"), ("0", "ADDRREC", "STREET"), ("1", "PAYTAB", "PAY-TAB")}


def test_twenty_thousand_rows_in_one_pass(spark):
    rows = [" IDENTIFICATION DIVISION.", " PROGRAM-ID. LONGONE.", " PROCEDURE DIVISION."]
    rows += [line for k in range(10_000) for line in (f" P-{k}.", f"     PERFORM P-{(k * 7) % 10_000}.")]
    entities, relations = mainframe.cobol(docs(spark, ("L.cbl", numbered("\n".join(rows)))))
    assert relations.count() == 10_000 and entities.where("kind = 'paragraph' AND last_n = n + 1").count() == 10_000


def test_map(spark):
    mark = lambda row: f"{row:<71}X\n"
    text = "PAYMS    DFHMSD TYPE=&SYSPARM,MODE=INOUT\n* NOTE\nPAYM1    DFHMDI SIZE=(24,80)\n         DFHMDF POS=(1,20),LENGTH=9,INITIAL='PAY QUERY'\n" + mark("STAFF    DFHMDF POS=(3,2),LENGTH=6,") + "               ATTRB=(UNPROT,IC)\nTOTAL    DFHMDF POS=(5,2),LENGTH=12,ATTRB=ASKIP\n         DFHMDF POS=(9,9)\n         DFHMSD TYPE=FINAL\n         END\n"
    got = {(e.kind, e.name, e.parent): (e.n, e.last_n, e.attrs) for e in mainframe.bms(docs(spark, ("PAYMS.bms", text))).collect()}
    assert got == {
        ("screen", "PAYM1", None): (3, 3, {"map_name": "PAYM1", "mapset": "PAYMS", "size": "24x80"}),
        ("ui_element", "LABEL@1,20", "PAYM1"): (4, 4, {"pos": "1,20", "length": "9", "text": "PAY QUERY", "input": "false"}),
        ("ui_element", "STAFF", "PAYM1"): (5, 6, {"pos": "3,2", "length": "6", "attributes": "UNPROT,IC", "input": "true"}),
        ("ui_element", "TOTAL", "PAYM1"): (7, 7, {"pos": "5,2", "length": "12", "attributes": "ASKIP", "input": "false"}),
    }


def test_job(spark):
    text = "//PAYJOB   JOB (HR),'PAY RUN',CLASS=A\n//* NOTE\n//S1       EXEC PGM=PAYRUN\n//STAFFIN  DD DSN=HR.STAFF,DISP=SHR\n//PAYOUT   DD DSN=HR.PAY.DAILY,DISP=(NEW,CATLG),\n//            SPACE=(TRK,(10,5))\n//S2       EXEC PAYPROC,PARM='A B'\n//IN       DD DISP=(MOD,KEEP),DSN=HR.LOG\n//OUT      DD SYSOUT=*\nplain\n"
    entities, relations = mainframe.jcl(docs(spark, ("PAYJOB.jcl", text), ("lib/NOJOB.jcl", "//X  EXEC PGM=A\n"), ("E.jcl", "")))
    assert {(e.doc, e.kind, e.name, e.n, e.last_n) for e in entities.collect()} >= {("0", "job", "PAYJOB", 1, 9), ("1", "job", "NOJOB", 1, 1)}
    got = {(r.kind, r.source, r.target, r.n): r.attrs for r in relations.where("doc = '0'").collect()}
    assert got == {
        ("calls", "PAYJOB", "program:PAYRUN", 3): {"step": "S1"},
        ("reads", "PAYJOB", "data_store:HR.STAFF", 4): {"step": "S1", "program": "PAYRUN", "ddname": "STAFFIN", "disp": "SHR", "store_type": "dataset"},
        ("writes", "PAYJOB", "data_store:HR.PAY.DAILY", 5): {"step": "S1", "program": "PAYRUN", "ddname": "PAYOUT", "disp": "NEW", "store_type": "dataset"},
        ("calls", "PAYJOB", "job:PAYPROC", 7): {"step": "S2", "proc": "true"},
        ("writes", "PAYJOB", "data_store:HR.LOG", 8): {"step": "S2", "ddname": "IN", "disp": "MOD", "store_type": "dataset"},
    }
