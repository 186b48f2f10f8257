"""Controls in each state they can have, and the register of risks."""

import pytest

from weftline.operators import controls


@pytest.fixture(scope="module")
def evidence(spark):
    programs = spark.createDataFrame([("bad", True, True), ("good", True, False), ("bare", True, False), ("other", False, False)], "program string, money boolean, tier1 boolean")
    routines = spark.createDataFrame([("bad", "method", "ApprovePayment", "extracted"), ("bad", "method", "Load", "extracted"), ("good", "method", "AUTHORISE", "placeholder"), ("good", "table", "RELEASE", "extracted"), ("other", "method", "Approve", "extracted")], "program string, kind string, name string, origin string")
    findings = spark.createDataFrame([("bad", "SEC-AUTHZ", "Pay.cs"), ("bad", "SEC-ERR", "Post.cs"), ("bad", "SEC-ERR", "Other.cs"), ("good", "SEC-XSS", "a")], "program string, rule string, file string")
    cells = [("bad", "Post.cs", "Payment", "Mainframe (files)", "PAYOUT", "RW"), ("bad", "Desk", "Ledger", "Windows desktop (local file)", "AUDITLOG", "W"), ("bad", "Read", "Payment", "DB2", "PAYTAB", "R"), ("good", "X", "Payment", "DB2", "ONE", "RW"), ("good", "Y", "Staff", "DB2", "TWO", "R"), ("good", "Z", "Staff", "DB2", "THREE", "R")]
    occurrences = spark.createDataFrame(cells, "program string, component string, business string, engine string, store string, access string")
    files = spark.createDataFrame(
        [("bad", "calc.cbl", "000100 01 AID-RATE PIC 9(4) VALUE 7138.\n000200* 01 OLD-RATE PIC 9 VALUE 5.\n000300 COMPUTE X = Y * 1250"), ("good", "tests/test_a.py", "x"), ("good", "b.cs", "INSERT INTO PAY_AUDIT VALUES (1)"), ("bare", "c", None)],
        "program string, file string, text string",
    )
    return programs, routines, findings, occurrences, files


def test_each_control_in_its_states(evidence):
    got = {(r.program, r.control): (r.state, r.rating, r.components) for r in controls.assessed(*evidence).collect()}
    names = controls.CONTROLS
    assert got == {
        ("bad", names[0]): ("not met", 5, ["Pay.cs"]), ("bad", names[1]): ("not met", 4, ["Desk"]), ("bad", names[2]): ("not met", 4, ["Post.cs"]), ("bad", names[3]): ("not met", 4, ["Post.cs", "Read"]),
        ("bad", names[4]): ("open", None, ["Post.cs"]), ("bad", names[5]): ("not met", 4, []), ("bad", names[6]): ("not met", 3, ["calc.cbl"]),
        ("good", names[0]): ("open", None, []), ("good", names[1]): ("met", None, ["b.cs"]), ("good", names[2]): ("open", None, []), ("good", names[3]): ("open", None, []), ("good", names[5]): ("met", 2, []),
        ("bare", names[0]): ("open", None, []), ("bare", names[1]): ("open", None, []), ("bare", names[2]): ("open", None, []), ("bare", names[3]): ("open", None, []), ("bare", names[5]): ("not met", 4, []),
    }
    assert {(r.file, r.rate) for r in controls.literal_rates(evidence[4]).collect()} == {("calc.cbl", "AID-RATE = 7138"), ("calc.cbl", "multiplier 1250")}


def test_register(spark, evidence):
    facts = spark.createDataFrame([("bad", "lifecycle", "jquery 1", True), ("bad", "lifecycle", "DB2 8", False), ("bad", "missing", "A", None), ("bad", "missing", "B", None), ("bad", "copies", "Payment", None), ("other", "injection", "q.php", None), ("other", "credentials", "c.ini", None)], "program string, kind string, subject string, unused boolean")
    rows = controls.register(evidence[0], controls.assessed(*evidence), facts).collect()
    bad = [(r.title, r.likelihood, r.impact, r.band) for r in sorted(rows, key=lambda r: r.place) if r.program == "bad"]
    assert bad == [
        ("Payments can be approved without an authorized second person", 4, 5, "High"), ("Payment data could drift apart between its copies", 4, 5, "High"), ("DB2 8 needs a support and upgrade decision", 4, 4, "High"),
        ("The audit trail can be altered or lost", 3, 5, "High"), ("Unchecked posting errors could leave incomplete or duplicate updates", 3, 5, "High"), ("Calculation changes need verified regression coverage", 3, 5, "High"),
        ("Unreviewed code (2 referenced components not provided) could change the assessment", 4, 3, "Medium"), ("jquery 1 needs a support and upgrade decision", 2, 4, "Medium"),
    ]
    assert {(r.program, r.title, r.impact, r.components[0]) for r in rows if r.program == "other"} == {("other", "Crafted input could change or expose data (injection)", 4, "q.php"), ("other", "Passwords or keys in the source could be misused", 4, "c.ini")}
    assert [(r.title, r.impact) for r in rows if r.program == "bare"] == [("Calculation changes need verified regression coverage", 4)] and not [r for r in rows if r.program == "good"]
