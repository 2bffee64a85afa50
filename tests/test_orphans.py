from mapweave.operators.orphans import Reference, Table, orphan_references, orphan_report


def graph(spark, a, b, c=None, refs=None):
    ta = spark.createDataFrame(a, "ord long, id string, gone timestamp_ntz, at timestamp_ntz, parent string, _ref string")
    tb = spark.createDataFrame(b, "ord long, id string, a_id string, at timestamp_ntz")
    tables = {"a": Table(ta, "ord", "id", "gone", "at"), "b": Table(tb, "ord", "id", None, "at")}
    if c is not None:
        tables["c"] = Table(spark.createDataFrame(c, "ord long, b_id string"), "ord")
    return tables, refs or [Reference("b", "a_id", "a")] + ([Reference("c", "b_id", "b")] if c is not None else [])


def found(tables, refs):
    return {(r.table_name, int(r.row_id), r.kind) for r in orphan_references(tables, refs).collect()}


def test_direct_and_inherited(spark):
    from datetime import datetime

    t = datetime(2024, 2, 3)
    a = [(1, "x", None, t, None, "q"), (2, "y", t, t, None, "q"), (3, "z", t, t, None, "q"), (4, "z", None, t, None, "q"), (5, None, None, t, None, "q")]
    b = [(1, "b1", "x", t), (2, "b2", "y", t), (3, "b3", "z", None), (4, "b4", "none", t), (5, "b5", None, t), (6, "b6", "", t), (7, "b1", "none", t), (8, "b8", "X", t)]
    c = [(1, "b1"), (2, "b2"), (3, "b4"), (4, "b9"), (5, None)]
    tables, refs = graph(spark, a, b, c)
    assert found(tables, refs) == {("b", 2, "direct"), ("b", 4, "direct"), ("b", 7, "direct"), ("b", 8, "direct"), ("c", 2, "inherited"), ("c", 3, "inherited"), ("c", 4, "direct")}
    rep = {(r.table_name, r.period): r for r in orphan_report(tables, refs, orphan_references(tables, refs)).collect()}
    assert (rep["b", "2024-02"].row_count, rep["b", "2024-02"].ref_count, rep["b", "2024-02"].direct_count) == (7, 5, 4)
    assert rep["b", None].direct_count == 0 and (rep["c", None].direct_count, rep["c", None].inherited_count) == (1, 2)


def test_cycles_are_sound_unless_something_outside_is_missing(spark):
    rows = [(1, "p", None, None, "q", ""), (2, "q", None, None, "p", ""), (3, "r", None, None, "s", ""), (4, "s", None, None, "t", ""), (5, "u", None, None, "r", ""), (6, "w", None, None, "w", "")]
    tables, _ = graph(spark, rows, [])
    assert found(tables, [Reference("a", "parent", "a")]) == {("a", 4, "direct"), ("a", 3, "inherited"), ("a", 5, "inherited")}


def test_empty_tables_and_hot_reference(spark):
    tables, refs = graph(spark, [], [])
    assert found(tables, refs) == set()
    tables, refs = graph(spark, [(1, "x", None, None, None, "")], [(k, f"b{k}", "hot" if k % 3 else "x", None) for k in range(5000)])
    assert len(found(tables, refs)) == sum(1 for k in range(5000) if k % 3)
