"""Entity consistency on odd rows, and how it is dealt."""

from veilframe.operators import metrics


def test_consistency_is_dealt_once_into_as_many_parts_as_its_rows_need(spark):
    gold = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "b"), (2, 1, "c"), (2, 2, "d"), (2, 3, None), (3, None, "e"), (4, 1, "f"), (4, 1, "g")], "doc int, at int, entity_id string"
    )
    pred = spark.createDataFrame(
        [(1, 1, "x"), (1, 1, "y"), (1, 2, "x"), (1, 3, "p"), (1, 4, "q"), (2, 1, "z"), (2, 2, "z"), (2, 3, "w"), (3, None, "v"), (4, 1, "u"), (4, 9, "t")], "doc int, at int, id string"
    )
    out = metrics.consistency(gold, pred, "doc", ["at"], 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.doc, r.entity_id): r.verdict for r in out.collect()} == {
        (1, "a"): "consistent", (1, "b"): "split", (2, "c"): "merged", (2, "d"): "merged", (2, None): "consistent", (3, "e"): "incomplete",
        (4, "f"): "merged", (4, "g"): "merged",
    }
    assert [metrics.parts_for(n) for n in (0, metrics.TASK_ROWS, 10 * metrics.TASK_ROWS)] == [1, 2, 11]
