"""Predictions and paraphrases brought to offsets."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import contracts, metrics, relocate

MENTIONS = "array<struct<start: long, end: long, text: string, type: string, entity_id: string>>"


def test_both_contracts_are_strict():
    good = '{"mentions":[{"text":"a","n":1,"type":"DATE","id":"E1"}]}'
    span = '{"mentions":[{"span":[0,4],"type":"DATE","id":"E1"}]}'
    assert contracts.read(good, "anchors")[1] is None and contracts.read(span, "spans", 4)[0][0]["end"] == 4
    cases = {
        "not_json": [good + "x", "", "{"], "wrong_shape": ["[]", "{}", '{"mentions":{}}', '{"mentions":[],"x":1}'],
        "wrong_keys": ['{"mentions":[1]}', span, good.replace('"n":1,', "")], "repeated_key": ['{"mentions":[],"mentions":[]}'],
        "bad_count": [good.replace(":1,", f":{x},") for x in ("0", "true", "1.0", '"1"', "null", str(2**63))],
        "empty_string": [good.replace('"E1"', x) for x in ('""', "3")], "unknown_type": [good.replace("DATE", "date")], "no_output": [None],
    }
    for reason, raws in cases.items():
        assert [contracts.read(raw, "anchors")[1] for raw in raws] == [reason] * len(raws)
    for bad in ("[4,0]", "[0,0]", "[-1,2]", "[0,5]", "[0]", "[0,true]", "[0.0,2]", '"0"'):
        assert contracts.read(span.replace("[0,4]", bad), "spans", 4) == (None, "bad_span")


def test_anchors_are_located_as_by_scanning(spark):
    rng = random.Random(3)
    docs, wanted = [], {}
    for i in range(40):
        text = "".join(rng.choice("aabé \n𝄞") for _ in range(rng.randint(0, 60)))
        marks = [(("".join(rng.choice("aabé𝄞") for _ in range(rng.randint(1, 3)))), rng.randint(1, 6), "DATE", f"E{k}") for k in range(8)]
        docs.append((i, text, marks))
        for part, n, _, who in marks:
            at = -1
            for _ in range(n):
                at = text.find(part, at + 1)
                if at < 0:
                    break
            wanted[i, who] = at
    rows = spark.createDataFrame(docs, "doc_id long, text string, mentions array<struct<text: string, n: long, type: string, id: string>>")
    found = relocate.located(rows.select("doc_id", "text"), rows.select("doc_id", "mentions").union(spark.createDataFrame([(99, docs[0][2])], "doc_id long, mentions array<struct<text: string, n: long, type: string, id: string>>")))
    got = {}
    for r in found.collect():
        got |= {(r.doc_id, m.entity_id): m.start for m in r.located} | {(r.doc_id, m.id): -1 for m in r.unlocatable}
    assert {k: v for k, v in got.items() if k[0] != 99} == wanted and all(v == -1 for k, v in got.items() if k[0] == 99)


def test_unlocatable_mentions_count_as_false_positives(spark):
    docs = spark.createDataFrame([(1, "Ann met Ann."), (2, "Bo.")], "doc_id long, text string")
    form = "doc_id long, mentions array<struct<text: string, n: long, type: string, id: string>>"
    pred = spark.createDataFrame([(1, [("Ann", 1, "PATIENT", "E1"), ("Ann", 3, "PATIENT", "E1"), ("Ann", 3, "PATIENT", "E2")]), (2, [("Bo", 1, "SITE", "E1")])], form)
    gold = spark.createDataFrame([(1, 0, 3, "PATIENT"), (1, 8, 11, "PATIENT"), (2, 0, 2, "PATIENT")], "doc_id long, start long, end long, type string")
    row = metrics.scores(relocate.anchored_outcomes(gold, relocate.located(docs, pred))).first()
    assert (row.tp, row.fp, row.fn) == (1, 2, 2)


@pytest.mark.parametrize("contract", ["anchors", "spans"])
def test_predictions_that_cannot_be_used_are_problems(spark, contract):
    docs = spark.createDataFrame([(i, "Ann met Bo.") for i in range(6)], "doc_id long, text string")
    one = (lambda text, n: f'{{"mentions":[{{"text":"{text}","n":{n},"type":"PATIENT","id":"E1"}}]}}') if contract == "anchors" else (
        lambda text, n: f'{{"mentions":[{{"span":[{8 if text == "Bo" else 0},{10 if n == 1 else 99}],"type":"PATIENT","id":"E1"}}]}}'
    )
    raws = [(0, one("Bo", 1)), (1, one("Bo", 2)), (2, "nothing"), (3, None), (4, '{"mentions":[]}'), (77, one("Bo", 1))]
    mentions, problems = relocate.from_predictions(docs, spark.createDataFrame(raws, "doc_id long, raw_output string"), contract)
    assert [tuple(r) for r in mentions.collect()] == [(0, 8, 10, "PATIENT", "E1")]
    lost = "unlocatable" if contract == "anchors" else "bad_span"
    assert dict(map(tuple, problems.collect())) == {1: lost, 2: "not_json", 3: "no_output", 5: "no_prediction", 77: "unknown_document"}


def spans(text, *parts):
    out, at = [], 0
    for part in parts:
        at = text.index(part, at)
        out.append((at, at + len(part), part, "PATIENT", part))
        at += len(part)
    return out


def test_ordered_relocation(spark):
    text = "Ann met Ann Bo and Bo."
    rows = [
        (1, text, "Today Ann met Ann Bo, then Bo.", spans(text, "Ann", "Ann Bo", "Bo")), (2, text, "Ann met Ann Bo.", spans(text, "Ann", "Bo")),
        (3, text, "Bo and Bo met Ann, Ann.", spans(text, "Ann", "Bo")), (4, text, None, spans(text, "Ann")), (5, None, text, spans(text, "Ann")),
        (6, text, text, []), (7, text, text, [(0, 0, "", "AGE", "x")]), (8, "aaa é𝄞b", "éé aaa é𝄞b", spans("aaa é𝄞b", "aa", "é𝄞")),
        (9, text, text, list(reversed(spans(text, "Ann", "Bo")))),
    ]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, new_text string, mentions {MENTIONS}")
    got = {r.doc_id: (r.reason, [m.start for m in r.new_mentions] if r.new_mentions is not None else None) for r in relocate.ordered(frame).collect()}
    assert got == {
        1: (None, [6, 14, 27]), 2: ("count_changed", None), 3: ("not_found", None), 4: ("no_text", None), 5: ("no_text", None), 6: (None, []),
        7: ("empty_mention", None), 8: (None, [3, 7]), 9: (None, [0, 12]),
    }


def test_a_refused_paraphrase_keeps_the_record(spark):
    text = "Ann met Bo."
    frame = spark.createDataFrame([(i, text, spans(text, "Ann", "Bo")) for i in range(3)], f"doc_id long, text string, mentions {MENTIONS}")

    def rewrite(t, protected):
        assert protected == ["Ann", "Bo"]
        return "So " + t

    def losing(t, protected):
        return t.replace("Bo", "he")

    def failing(t, protected):
        raise OSError("no network")

    rows = relocate.paraphrased(frame, rewrite).collect()
    assert all(r.reason is None and r.new_text == "So Ann met Bo." and [m.start for m in r.new_mentions] == [3, 11] for r in rows)
    for bad, reason in ((losing, "count_changed"), (failing, "error")):
        rows = relocate.paraphrased(frame, bad).collect()
        assert all(r.reason == reason and r.new_text == text and [m.start for m in r.new_mentions] == [0, 8] for r in rows)
    assert relocate.paraphrased(frame.select("doc_id", F.lit(None).cast("string").alias("text"), "mentions"), rewrite).first().reason == "no_text"
