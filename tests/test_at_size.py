"""Operators on many equal rows: what they return, and what their work grows with."""

import random
import time

from weftline.operators import graph, joins, lines, matching, repair, reports, sideways
from weftline.operators.rules import definitions, mainframe, packs
from weftline.sources import files
from weftline.streaming import events


def written(spark, frame, kind="ShuffleExchangeExec", metric="shuffleRecordsWritten"):
    """Rows that all exchanges (or nodes of another kind) of a query wrote, and its rows."""
    rows = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == kind:
            total += node.metrics().apply(metric).value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total, rows


def test_flow_chart_without_an_edge_is_null(spark):
    """The nodes of highest degree have no edge to one another."""
    edges = spark.createDataFrame([(100 + i, i % 2) for i in range(20)], "s long, t long")
    assert files.flow_chart(edges, "s", "t", 2).collect()[0].chart is None
    assert files.flow_chart(edges, "s", "t", 22).collect()[0].chart.count("-->") == 20


def test_piece_holders_list_a_part_of_the_windows(spark):
    """Pieces of many lengths are found wherever they stand; far fewer rows are written than the lines have characters."""
    rng = random.Random(5)
    lines = [(i, "".join(rng.choice("abcdé\U0001f600 ") for _ in range(rng.randint(0, 300)))) for i in range(400)]
    pieces = [(t[at : at + n],) for i, t in lines[::7] for n in (8, 9, 13, 20, 37, 150) for at in (rng.randint(0, 40),) if len(t) >= at + n]
    found = matching.piece_holders(spark.createDataFrame(pieces, "piece string"), spark.createDataFrame(lines, "id long, line string"), "piece", "id", "line")
    assert sorted(map(tuple, found.collect())) == sorted({(p, i) for (p,) in pieces for i, t in lines if p in t})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        twenty = matching.piece_holders(spark.createDataFrame([(p,) for (p,) in pieces if len(p) == 20], "piece string"), spark.createDataFrame(lines, "id long, line string"), "piece", "id", "line")
        assert written(spark, twenty)[0] < sum(len(t) for _, t in lines) / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_labels_of_many_equal_pages(spark):
    """Pages of one template are one class: what is written grows with the pages, not with their pairs."""
    html = lambda k: "".join(f'<li><a href="x">{w}</a>' for w in ("a", "b", "c", f"t{k % 3}"))
    pages = spark.createDataFrame([(i, html(i)) for i in range(600)] + [(600, ">a<>b<>c<"), (601, ">a<>b<>zz<")], "page_id long, html string")
    labels = spark.createDataFrame([(i, ["a", "b", "c", f"t{i % 3}"]) for i in range(600)] + [(700, ["a", "b", "c", "q", "r"]), (701, ["a", "b"]), (600, ["a", "b", "c"])], "page_id long, labels array<string>")
    total, rows = written(spark, reports.labelled_elsewhere(labels, pages, "page_id", "html"))
    assert {r.page_id: r.holder for r in rows} == {i: 0 if i else 1 for i in [*range(600), 600]}
    assert total < 20_000


def test_drift_pairs_of_equal_owners(spark):
    rng = random.Random(3)
    cells = [(o, n, (n * (o % 12)) % 5 if (n + o % 12) % 9 else None) for o in range(240) for n in range(10) if (o % 12 + n) % 6]
    frame = spark.createDataFrame(rng.sample(cells, len(cells)), "o long, n long, v long")
    held = {}
    for o, n, v in cells:
        held.setdefault(o, {})[n] = v
    want = set()
    for a in held:
        for b in held:
            common = held[a].keys() & held[b].keys()
            differ = sum(held[a][n] is not None and held[b][n] is not None and held[a][n] != held[b][n] for n in common)
            if a < b and differ >= 3 and differ >= 0.5 * len(common):
                want.add((a, b, len(common), differ))
    total, rows = written(spark, joins.drift_pairs(frame, "o", "n", "v"))
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert total < 2_000


def _drifting(cells, least, share):
    held = {}
    for o, n, v in cells:
        held.setdefault(o, {})[n] = v
    for a in held:
        for b in held:
            common = held[a].keys() & held[b].keys()
            differ = sum(None not in (held[a][n], held[b][n]) and held[a][n] != held[b][n] for n in common)
            if a < b and len(held[a]) >= least <= len(held[b]) and differ >= least and differ >= share * len(common):
                yield a, b, len(common), differ


def test_drift_pairs_of_different_owners_meet_only_where_they_may_count(spark):
    """Owners that hardly differ from the usual values are not sent to meet one another."""
    cells = [(o, n, o if n == o % 20 or n == o // 20 else 7) for o in range(400) for n in range(20)]
    cells += [(o, n, o if (n * 7 + o) % 20 < 7 else 7) for o in range(400, 406) for n in range(20)]
    total, rows = written(spark, joins.drift_pairs(spark.createDataFrame(cells, "o long, n long, v long"), "o", "n", "v"))
    want = set(_drifting(cells, 3, 0.5))
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) == 6
    assert total < 1_000


def test_drift_pairs_of_owners_with_few_and_many_names(spark):
    rng = random.Random(12)
    for least, share, often in ((3, 0.5, 9), (2, 0.34, 7), (1, 1.0, 5)):
        cells = [(o, n, rng.choice([None, 1, 2, *[0] * often])) for o in range(90) for n in rng.sample(range(16), rng.choice([1, 3, 12, 16]))]
        got = joins.drift_pairs(spark.createDataFrame(cells, "o long, n long, v long"), "o", "n", "v", least, share).collect()
        assert sorted(map(tuple, got)) == sorted(_drifting(cells, least, share)) and len(got) > 9


def test_many_findings_of_one_line(spark):
    """Equal lines and equal spans meet once."""
    findings = spark.createDataFrame([(i, i % 2, 5, 2) for i in range(400)], "id long, file long, line long, level int")
    facts = spark.createDataFrame([(0, 1, 9, "O")] * 300 + [(0, 5, 5, "F")] * 300 + [(1, 2, 5, "O")] * 300 + [(1, 6, 90, "F")], "file long, lo long, hi long, verdict string")
    plan = reports.reviewed_levels(findings, facts, "id")
    total, rows = written(spark, plan, "GenerateExec", "numOutputRows")
    assert {tuple(r) for r in rows} == {(i, 2, 3 if i % 2 else 1) for i in range(400)}
    assert total < 20


def test_overlaps_of_equal_intervals(spark):
    left = spark.createDataFrame([(i, 0, i % 3, i % 3 + 70) for i in range(60)], "a long, file long, la long, ha long")
    right = spark.createDataFrame([(i, 0, 60 + i % 4, 65) for i in range(60)] + [(99, 0, 90, 91)], "b long, file long, lb long, hb long")
    frame = joins.overlapping(left, right, "file", "la", "ha", "lb", "hb")
    total, rows = written(spark, frame, "GenerateExec", "numOutputRows")
    assert total < 40
    assert sorted((r.a, r.b) for r in rows) == [(a, b) for a in range(60) for b in range(60)]


def _long_lines(spark, readings=4):
    rng = random.Random(9)
    texts = {k: ["".join(rng.choice("abcdef") for _ in range(600)) for _ in range(12)] for k in range(20)}
    finals = [(k, n, line) for k, t in texts.items() for n, line in enumerate([*t[:5], *t[3:]], 1)]  # the fourth and fifth line twice
    read = [(k, o, n, line, 5) for k, t in texts.items() for o in range(readings) for n, line in enumerate(t, 1)]
    return spark.createDataFrame(finals, "key long, n int, line string"), spark.createDataFrame(read, "key long, ord int, n int, line string, rank int"), sum(len(x[3]) for x in read)


def test_repairs_deal_digests_of_lines(spark):
    """What windows of lines send on grows with the lines, not with their lengths."""
    finals, readings, chars = _long_lines(spark)
    sent, rows = written(spark, repair.doubled_pairs(finals, readings), metric="dataSize")
    assert {(r.key, r.n, r.action) for r in rows} == {(k, n, "drop") for k in range(20) for n in (6, 7)}
    assert sent < chars / 2


def test_respacing_deals_gaps_of_readings(spark):
    """A merged text is sent once, its readings as gaps and digests."""
    finals, readings, chars = _long_lines(spark)
    sent, rows = written(spark, repair.respaced(finals.where("n <= 5"), readings.where("n <= 5")), metric="dataSize")
    assert {(r.key, r.n): r.state for r in rows} == {(k, n): "measured" for k in range(20) for n in range(1, 6)}
    assert sent < chars / 4


def test_islands_sort_without_a_table_of_values(spark):
    """Repeated values and nulls are passed over in the sorted rows; no exchange but one by the keys."""
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *range(30), 2**62, -(2**62)])) for k in range(9) for _ in range(k * 9)]
    found = lines.islands(spark.createDataFrame(rows, "k long, v long"), ["k"], "v")
    sent, got = written(spark, found)
    want = set()
    for k, v in set(rows):
        if v is None:
            want.add((k, None, None, 1))
        elif (k, v - 1) not in set(rows):
            high = v
            while (k, high + 1) in set(rows):
                high += 1
            want.add((k, v, high, high - v + 1))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sent == len(rows)


def test_many_items_of_one_micro_batch():
    """Cutting batches copies each item once; it copied all that were left for each batch."""
    began = time.perf_counter()
    closed, held = events.full_batches(list(range(3_000_001)), 50)
    assert (len(closed), held) == (3_000_000, [3_000_000]) and time.perf_counter() - began < 5


def test_flags_without_a_document_are_left_early(spark):
    docs = spark.range(1, 2).selectExpr("id AS doc_id", "concat('a', char(10), 'b') AS text", "true AS verified", "false AS exact")
    flags = spark.createDataFrame([(i % 3000, 1 + i // 3000, "dup", False) for i in range(6000)], "doc_id long, line int, kind string, literal boolean")
    sent, rows = written(spark, reports.capture_quality(docs, flags, spark.createDataFrame([(1, 2)], "doc_id long, line int")))
    assert [(r.status, [tuple(i) for i in r.issues], r.bad_lines) for r in rows] == [("rescan", [("dup", "1-2"), ("model", "2")], [1, 2])]
    assert sent < 1000


def test_ranks_go_not_through_the_driver(spark):
    edges = spark.createDataFrame([(i // 3, i) for i in range(1, 300)] + [(299, 0)], "from_id long, to_id long")
    sent, rows = written(spark, graph.ranks_without_cycles(edges), "BroadcastExchangeExec", "dataSize")
    assert len(rows) == 300 and sent == 0


def test_rows_of_jobs_need_no_exchange_of_their_own(spark):
    """Texts are dealt by document, whole; cards, what is carried down to them and relations stay in the same task."""
    text = "//J JOB (X)\n" + "\n".join(f"//S{i} EXEC PGM=P{i}\n//D{i} DD DSN=A.B{i},\n//   DISP=SHR" for i in range(50))
    docs = spark.createDataFrame([(i, f"J{i}.jcl", text) for i in range(40)], "doc_id long, name string, text string")
    sent, rows = written(spark, mainframe.jcl(docs)[1])
    assert {(r.kind, r.n % 3): r.attrs.get("program") for r in rows if r.n < 4} == {("calls", 2): None, ("reads", 0): "P0"}
    assert len(rows) == 4000 and sent == 40


def test_rows_of_maps_need_no_exchange_of_their_own(spark):
    text = "S DFHMSD TYPE=MAP\nM  DFHMDI SIZE=(24,80)\n" + "\n".join(f"F{i}  DFHMDF POS=(1,{i})" for i in range(100))
    docs = spark.createDataFrame([(i, f"S{i}.bms", text) for i in range(40)], "doc_id long, name string, text string")
    sent, rows = written(spark, mainframe.bms(docs).where("kind = 'ui_element'"))
    assert len(rows) == 4000 and {r.parent for r in rows} == {"M"} and sent == 40


def test_texts_with_a_common_line_do_not_meet_for_it(spark):
    """A long line of all texts makes no candidates; runs of one, two, three and more lines are found."""
    common = "x" * 60
    texts = [f"a{i}\n{common}\nb{i}\nc{i}" for i in range(200)]
    texts += [f"a{i}\n{common}\nb{i}" for i in range(3)] + [f"{common}\nb9", common, f"zz\n{common}", f"b5\nc5\nq", "b7\nc7"]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = {(i, j) for i, a in rows for j, b in rows if i != j and f"\n{a}\n" in f"\n{b}\n"}
    total, got = written(spark, joins.contained_runs(spark.createDataFrame([*rows, (900, texts[0])], "doc_id long, text string")), "SortMergeJoinExec", "numOutputRows")
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        total, _ = written(spark, joins.contained_runs(spark.createDataFrame(rows, "doc_id long, text string")), "SortMergeJoinExec", "numOutputRows")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert total < 8_000


def test_passages_cut_documents_only_in_their_own_numbers_of_words(spark):
    quotes = spark.createDataFrame([(i, f"a{i} b c d{i} e f") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x a{i} b c d{i} e fg " * 20) for i in range(40)], "doc_id long, text string")
    total, rows = written(spark, joins.contained_passages(quotes, docs, "item_id", "doc_id", "text", "text"), "GenerateExec", "numOutputRows")
    assert {tuple(r) for r in rows} == {(i, i) for i in range(20)} and len(rows) == 20
    assert total <= 40 * 8


def test_definitions_of_one_file_are_read_in_all_tasks(spark):
    text = '{"openapi": "3", "paths": {"/a": {"get": {}}}}'
    docs = spark.createDataFrame([(i, text) for i in range(80)], "doc_id long, text string").coalesce(1)
    found = definitions.api_endpoints(docs)
    sent, rows = written(spark, found)
    assert {(r.doc_id, r.name) for r in rows} == {(i, "GET /a") for i in range(80)} and sent >= 80


def test_rows_of_programs_need_no_exchange_of_their_own(spark):
    """Texts are dealt by document, whole; the form of a text and its continued rows are told in the same task."""
    body = "".join(f"       P-{i}.\n           PERFORM P-0\n           CALL 'PGM'.\n" for i in range(20))
    text = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. C.\n       PROCEDURE DIVISION.\n" + body
    docs = spark.createDataFrame([(i, f"X{i}.cbl", text) for i in range(30)], "doc_id long, name string, text string")
    sent, rows = written(spark, mainframe.logical_lines(docs))
    assert len(rows) == 30 * 63 and sent == 30


def test_linked_relations_look_for_a_name_once(spark):
    """Relations stay with their document; what is sent for a name grows with the names, not with the relations that state them."""
    text = "import one\n" + "\n".join(f"def f{i}():\n    import m{i % 3}" for i in range(40))
    docs = spark.createDataFrame([(i, f"p{i}.py", "python", text) for i in range(30)], "doc_id long, name string, pack string, text string")
    entities, relations = packs.extracted(docs)
    edges = packs.linked(packs.structured(entities), relations, entities)[1]
    assert edges.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent, rows = written(spark, edges)
    assert len(rows) == 30 * 41 and {r.to_node for r in rows} == {"module:ONE", "module:M0", "module:M1", "module:M2"}
    assert sent < 5 * len(rows)


def test_programs_are_written_twice_and_no_row_holds_its_code_twice(spark, monkeypatch):
    """Lines and blocks are staged; paragraphs are read from the rows of the blocks."""
    seen, stage = [], mainframe.stage
    monkeypatch.setattr(mainframe, "stage", lambda df, label, by=None: seen.append((label, df.columns)) or stage(df, label, by))
    text = "       IDENTIFICATION DIVISION.\n       program-id. C.\n       PROCEDURE division.\n       P-1.\n           perform P-2\n           Exec SQL SELECT A\n             FROM T end-exec\n           call 'PGM'.\n       P-2.\n           STOP RUN.\n"
    entities, relations = mainframe.cobol(spark.createDataFrame([(1, "X.cbl", text)], "doc_id long, name string, text string"))
    assert {(r.kind, r.name, r.parent, r.n, r.last_n) for r in entities.collect()} == {("program", "C", None, 1, 10), ("paragraph", "P-1", "C", 4, 8), ("paragraph", "P-2", "C", 9, 10)}
    assert {(r.kind, r.source, r.target, r.n) for r in relations.collect()} == {("calls", "P-1", "P-2", 5), ("reads", "P-1", "table:T", 6), ("calls", "P-1", "program:PGM", 8)}
    assert sorted(label for label, _ in seen) == ["blocks", "blocks", "cobol", "files"]
    assert not any("tail" in columns for _, columns in seen)


def test_pieces_beside_a_text_are_sent_as_rows_not_as_stems(spark, monkeypatch):
    """Lines and pieces are sent once, by text; the grown lines are read by text without being sent again."""
    rng = random.Random(7)
    texts = {k: ["".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(10)] for k in range(20)}
    rows = [(k, n, line) for k, t in texts.items() for n, line in enumerate(t, 1)]
    finals = spark.createDataFrame([(k, n, line[:80]) for k, n, line in rows], "key long, n int, line string")
    pieces = spark.createDataFrame([(k, o, n, line[at:to]) for k, n, line in rows for o, at, to in ((1, 120, 200), (2, 50, 150))], "key long, ord int, n int, line string")
    sent, stage = [], repair.stage
    monkeypatch.setattr(repair, "stage", lambda df, *a, **b: sent.append(written(spark, df)[0]) or stage(df, *a, **b))
    grown, places = repair.joined_sideways(finals, pieces)
    again, got = written(spark, repair.text_of(grown))
    assert {r.key: r.text.split("\n") for r in got} == texts
    assert {tuple(r) for r in places.collect()} == {(k, o, 0, at, 0) for k in texts for o, at in ((1, 120), (2, 50))}
    assert sum(sent) == 3 * len(rows) and again == 0


def test_pieces_of_a_long_text_are_placed_slice_by_slice(monkeypatch):
    """What a text larger than a batch gives does not depend on how its stems and shifts are cut."""
    rng = random.Random(8)
    rows = [" " * rng.choice([0, 4]) + "ab" * 10 + "".join(rng.choice("abcé\u65e5") for _ in range(100)) for _ in range(60)]

    def grown():
        text = sideways.Text(1)
        text.lines = [(n, line[:40]) for n, line in enumerate(rows)]
        text.pieces = [(o, [(n, line[at : at + wide]) for n, line in enumerate(rows)]) for o, at, wide in ((1, 70, 90), (2, 0, 30), (3, 25, 60))]
        sideways.placed([text])
        return sorted(text.lines), text.places

    whole = grown()
    assert [line for _, line in whole[0]] == rows and len(whole[1]) == 3
    monkeypatch.setattr(sideways, "SLICE", 500)
    monkeypatch.setattr(sideways, "PAIRS", 40)
    assert grown() == whole
