"""SQL scripts against lists written by hand."""

import pytest

from weftline.operators.rules import ddl

SCHEMA = """-- staff tables; CREATE TABLE NOT_THIS (A INT);
CREATE TABLE HR.UNIT (
    UNIT_ID   CHAR(6)      NOT NULL,
    NAME      VARCHAR(80)  DEFAULT 'a, b) CREATE TABLE X (',  /* a
    comment, with a comma */
    "Period"  INT,
    PRIMARY KEY (UNIT_ID)
) IN SPACE1;

create table [dbo].[Staff Member] (
    id int identity(1,1) primary key, unit char(6) not null references HR.UNIT (UNIT_ID),
    pay decimal(13, 2) null,
    note character varying(10),
    check_no int,
    CONSTRAINT fk_boss FOREIGN KEY (pay, note) REFERENCES dbo.Boss (a, b),
    CHECK (pay > 0), UNIQUE (note)
);
CREATE UNIQUE INDEX ix_pay ON HR.UNIT (NAME DESC, UNIT_ID);
ALTER TABLE HR.PAY ADD CONSTRAINT pk_pay PRIMARY KEY (PAY_ID);
ALTER TABLE HR.PAY ADD CONSTRAINT fk_pay FOREIGN KEY (UNIT) REFERENCES HR.UNIT (UNIT_ID);
CREATE TABLE HR.PAY (PAY_ID INT, UNIT CHAR(6));
CREATE OR REPLACE VIEW HR.V_PAY (A, B) AS
    SELECT P.A, U.B FROM HR.PAY P
    JOIN HR.UNIT U ON 1 = 1;
SELECT * FROM AFTER_VIEW;
"""
ROUTINES = """CREATE PROCEDURE dbo.usp_Approve @id INT AS
BEGIN
    -- UPDATE dbo.Nothing
    UPDATE dbo.Batch SET ok = 1;
    INSERT INTO dbo.Log SELECT * FROM dbo.Batch JOIN dbo.Staff ON 1 = 1;
    EXEC dbo.usp_Next @id;
    EXECUTE IMMEDIATE 'x';
END
GO
CREATE TRIGGER dbo.trg_Audit ON dbo.Batch AFTER UPDATE AS
BEGIN
    INSERT INTO dbo.Audit SELECT 1 FROM inserted;
END
GO
CREATE OR REPLACE FUNCTION f_sum (p INT) RETURN INT IS BEGIN CALL helper(p); RETURN 1; END;
"""


def found(spark, *texts):
    frame = spark.createDataFrame([(i, n, t, "x", 2) for i, (n, t) in enumerate(texts)], "doc_id long, name string, text string, doc string, n int").repartition(2)
    entities, relations = ddl.sql_structure(frame)
    return entities.collect(), relations.collect()


@pytest.fixture(scope="module")
def both(spark):
    return found(spark, ("a.sql", SCHEMA), ("b.sql", ROUTINES), ("lib/c.sql", "UPDATE HR.UNIT SET A = 0;\nSELECT * FROM HR.PAY JOIN HR.UNIT;\n"), ("d.sql", ""), (None, None))


def test_tables_columns_and_keys(both):
    entities, relations = both
    own = [e for e in entities if e.doc == "0"]
    assert {(e.name, e.n, e.last_n) for e in own if e.kind == "table"} == {("HR.UNIT", 2, 8), ("DBO.STAFFMEMBER", 10, 17), ("HR.PAY", 21, 21), ("HR.V_PAY", 22, 24)}
    columns = {(e.parent, e.name): (e.n, e.attrs["type"], e.attrs["nullable"], e.attrs.get("primary_key")) for e in own if e.kind == "column"}
    assert columns == {
        ("HR.UNIT", "UNIT_ID"): (3, "CHAR(6)", "false", "true"), ("HR.UNIT", "NAME"): (4, "VARCHAR(80)", "true", None), ("HR.UNIT", "PERIOD"): (6, "INT", "true", None),
        ("DBO.STAFFMEMBER", "ID"): (11, "INT", "false", "true"), ("DBO.STAFFMEMBER", "UNIT"): (11, "CHAR(6)", "false", None), ("DBO.STAFFMEMBER", "PAY"): (12, "DECIMAL(13, 2)", "true", None),
        ("DBO.STAFFMEMBER", "NOTE"): (13, "CHARACTER VARYING(10)", "true", None), ("DBO.STAFFMEMBER", "CHECK_NO"): (14, "INT", "true", None),
        ("HR.PAY", "PAY_ID"): (21, "INT", "true", "true"), ("HR.PAY", "UNIT"): (21, "CHAR(6)", "true", None),
    }
    assert {(r.kind, r.source, r.target, r.n, r.attrs.get("foreign_key"), r.attrs.get("references"), r.attrs.get("verb")) for r in relations if r.doc == "0"} == {
        ("depends_on", "DBO.STAFFMEMBER", "table:HR.UNIT", 11, "UNIT", "UNIT_ID", None), ("depends_on", "DBO.STAFFMEMBER", "table:DBO.BOSS", 15, "PAY,NOTE", "A,B", None),
        ("depends_on", "HR.PAY", "table:HR.UNIT", 20, "UNIT", "UNIT_ID", None), ("reads", "HR.V_PAY", "table:HR.PAY", 22, None, None, "VIEW"), ("reads", "HR.V_PAY", "table:HR.UNIT", 22, None, None, "VIEW"),
    }
    told = {e.name: e.attrs for e in own if e.kind == "table"}
    assert told["HR.UNIT"] == {"schema_name": "HR", "short_name": "UNIT", "indexes": "IX_PAY(NAME,UNIT_ID) unique"} and told["HR.V_PAY"]["view"] == "true"


def test_routines(both):
    entities, relations = both
    assert {(e.name, e.n, e.last_n, e.attrs["sql_object"]) for e in entities if e.doc == "1"} == {("DBO.USP_APPROVE", 1, 9, "procedure"), ("DBO.TRG_AUDIT", 10, 14, "trigger"), ("F_SUM", 15, 15, "function")}
    assert {(r.kind, r.source, r.target, r.n) for r in relations if r.doc == "1"} == {
        ("writes", "DBO.USP_APPROVE", "table:DBO.BATCH", 1), ("writes", "DBO.USP_APPROVE", "table:DBO.LOG", 1), ("reads", "DBO.USP_APPROVE", "table:DBO.STAFF", 1), ("calls", "DBO.USP_APPROVE", "function:DBO.USP_NEXT", 6),
        ("depends_on", "DBO.TRG_AUDIT", "table:DBO.BATCH", 10), ("writes", "DBO.TRG_AUDIT", "table:DBO.AUDIT", 10), ("reads", "DBO.TRG_AUDIT", "table:INSERTED", 10), ("calls", "F_SUM", "function:HELPER", 15),
    }


def test_scripts_without_definitions(both):
    entities, relations = both
    assert {(e.doc, e.kind, e.name, e.last_n) for e in entities if e.doc in "234"} == {("2", "job", "c.sql", 3), ("3", "job", "d.sql", 1), ("4", "job", "script.sql", 1)}
    assert {(r.kind, r.source, r.target) for r in relations if r.doc == "2"} == {("writes", "c.sql", "table:HR.UNIT"), ("reads", "c.sql", "table:HR.PAY")}


def test_a_long_script(spark):
    text = "\n".join(f"CREATE TABLE S.T{k} (\n  A{k} INT NOT NULL,\n  B DECIMAL(9, 2) REFERENCES S.T{k // 2} (A)\n);" for k in range(3000))
    entities, relations = found(spark, ("long.sql", text))
    assert sum(e.kind == "table" for e in entities) == 3000 and len(relations) == 3000
    assert all(e.n == 4 * int(e.name[1:]) + 2 for e in entities if e.kind == "column" and e.name.startswith("A"))
