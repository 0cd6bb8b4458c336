"""Profiles and renderings of persons, places, sites, numbers and dates; refusals."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilframe.functions import vocabulary as V
from veilframe.operators import profiles, relative, surrogates
from veilframe.operators.assign import assign
from veilframe.operators.similar import near

SECRET = b"a secret of the tests"


def tables(spark, docs):
    """docs: {doc_id: (scope, [text or (text, type, entity)])} -> documents and mentions."""
    rows, marks = [], []
    for doc_id, (scope, parts) in docs.items():
        text = ""
        for part in parts:
            own, kind, who = part if isinstance(part, tuple) else (part, None, None)
            if kind:
                marks.append((doc_id, len(text), len(text) + len(own), kind, who))
            text += own
        rows.append((doc_id, scope, text))
    return (
        spark.createDataFrame(rows, "doc_id long, scope_id string, text string"),
        spark.createDataFrame(marks, "doc_id long, start long, end long, type string, entity_id string"),
    )


def spread(*mentions):
    """Mentions with words between them."""
    return [x for m in mentions for x in (m, " and then ")]


@pytest.fixture(scope="module")
def done(spark):
    p, loc, site = lambda t: (t, "PATIENT", "E1"), lambda t: (t, "LOCATION", "E3"), lambda t: (t, "SITE", "E4")
    docs = {
        1: ("s", spread(p("Julian Gray"), p("Mr. Gray"), p("J. Gray"), p("J.G."), p("JULIAN GRAY"), p("Julian"), p("Grey"), p("Mr. Graye"), p("the patient"))),
        2: ("s", spread(("Dr. Ada Stone", "INVESTIGATOR", "E2"), ("Dr. Stone", "INVESTIGATOR", "E2"), p("Jules"), p("Dr. Julian Gray-Smith"))),
        3: ("s", spread(loc("Grand Forks, North Dakota, United States"), loc("Grand Forks"), site("Grand Forks Clinical Research Unit"), site("the Grand Forks site"), site("Site 104"), site("104"))),
        4: ("s", spread(("104-2231", "ID", "E1"), ("SUBJ-104-0077", "ID", "E1"), ("julian.gray@site104.example", "CONTACT", "E1"), ("555-0142", "CONTACT", "E1"), ("jg@mail.org", "CONTACT", "E1"))),
        5: ("s", spread(("Halvorsen Memorial Hospital", "SITE", "E5"), ("HALVORSEN clinic", "SITE", "E5"), ("Tulsa General", "SITE", "E6"), ("Li Wu", "PATIENT", None), ("Wu", "PATIENT", None))),
        6: ("other", spread(p("Julian Gray"), ("104-2231", "ID", "E1"))),
        7: ("s", ["no mention at all"]),
    }
    rows, marks = tables(spark, docs)
    out = {r.doc_id: r for r in surrogates.deidentify(rows, marks, SECRET).collect()}
    old = {i: [m[0] for m in parts if isinstance(m, tuple)] for i, (_, parts) in docs.items()}
    return docs, {i: dict(zip(old[i], (m.text for m in r.mentions), strict=True)) for i, r in out.items()}, out


def test_all_forms_of_a_person_tell_one_name(done):
    _, new, _ = done
    a, b = new[1]["Julian Gray"].split()
    nick = a[:3] if len(a) >= 5 else a
    want = {
        "Mr. Gray": f"Mr. {b}", "J. Gray": f"{a[0]}. {b}", "J.G.": f"{a[0]}.{b[0]}.", "JULIAN GRAY": f"{a} {b}".upper(), "Julian": a, "Grey": b,
        "Mr. Graye": f"Mr. {b}", "the patient": "the patient",
    }
    assert {k: new[1][k] for k in want} == want
    assert new[2]["Jules"] == nick and new[2]["Dr. Julian Gray-Smith"] == f"Dr. {a} {b}"
    first, last = new[2]["Dr. Ada Stone"].split()[1:]
    assert new[2]["Dr. Stone"] == f"Dr. {last}" and len({a[0] + b[0], first[0] + last[0], "JG", "AS"}) == 4
    assert a[0] != "J" and b[0] != "G" and a in V.MALE_NAMES  # Mr.


def test_sites_follow_their_city_and_numbers_agree(done):
    _, new, _ = done
    town, state, country = new[3]["Grand Forks, North Dakota, United States"].split(", ")
    assert (town, state) in V.PLACES["United States"] and country == "United States"
    assert new[3]["Grand Forks"] == town and new[3]["the Grand Forks site"] == f"the {town} site"
    assert new[3]["Grand Forks Clinical Research Unit"] == f"{town} Clinical Research Unit"
    number = new[3]["104"]
    assert re.fullmatch(r"[1-9]\d\d", number) and number != "104" and new[3]["Site 104"] == f"Site {number}"
    assert re.fullmatch(rf"{number}-\d{{4}}", new[4]["104-2231"]) and re.fullmatch(rf"SUBJ-{number}-\d{{4}}", new[4]["SUBJ-104-0077"])
    assert new[4]["104-2231"][4:] != "2231" and re.fullmatch(r"555-\d{4}", new[4]["555-0142"])
    a, b = new[1]["Julian Gray"].lower().split()
    assert new[4]["julian.gray@site104.example"] == f"{a}.{b}@site{number}.example" and new[4]["jg@mail.org"].endswith("@example.org")
    name = new[5]["Halvorsen Memorial Hospital"].split()[0]
    assert new[5]["HALVORSEN clinic"] == f"{name.upper()} clinic" and name not in ("Halvorsen", b.title())
    own = new[5]["Tulsa General"].split()
    assert own[-1] == "General" and own[:-1] != ["Tulsa"]


def test_nothing_of_an_original_is_left_and_offsets_hold(spark, done):
    docs, new, out = done
    for i, row in out.items():
        assert all(row.text[m.start : m.end] == m.text for m in row.mentions)
        assert re.sub("|".join(map(re.escape, sorted(new[i].values(), key=len, reverse=True))) or "$^", "#", row.text) == "".join(
            "#" if isinstance(p, tuple) else p for p in docs[i][1]
        )
    assert "Li" not in out[5].text and "Wu" not in out[5].text  # mentions without an entity
    assert new[6]["Julian Gray"] != new[1]["Julian Gray"] and out[7].text == "no mention at all"


def test_words_near_each_other_equal_brute_force(spark):
    words = ["gray", "grey", "graye", "groy", "gry", "ray", "y", "", "stone", "stoned", "tsone", "ö", "a" * 30, "a" * 29]
    frame = spark.createDataFrame([(s, w) for s in (1, 2) for w in words], "scope_id int, word string").union(spark.createDataFrame([(1, None)], "a int, b string"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            out = [i]
            for j, y in enumerate(b, 1):
                out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
            row = out
        return row[-1]

    got = {(r.word, r.near) for r in near(frame, frame.where("scope_id = 1"), ["scope_id"]).collect()}
    short = [w for w in words if len(w) <= 24]
    assert got == {(a, b) for a in short for b in short if distance(a, b) <= 2} | {("a" * 30, "a" * 30), ("a" * 29, "a" * 29)}


def test_a_large_scope_is_assigned_without_clashes(spark):
    """3,000 persons of one scope in rounds; every word is used once and none is an original."""
    name = F.concat(V.syllables(F.sha2(F.col("id").cast("string"), 256), 8), F.lit(" "), V.syllables(F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256), 7))
    forms = spark.range(3000).select(
        F.lit("big").alias("scope_id"), F.lit("k").alias("key"), F.lit("PATIENT").alias("type"), F.concat(F.lit("E"), F.col("id").cast("string")).alias("who"),
        name.alias("old"), F.lit(1).alias("n"),
    )
    rows = profiles.surrogates(forms).collect()
    words = [w for r in rows for w in r.new.lower().split()]
    assert len(rows) == 3000 and len(set(words)) == 6000
    assert not set(words) & {w for r in rows for w in r.old.lower().split()}
    assert all(r.new[0] != r.old[0] and r.new.split()[1][0] != r.old.split()[1][0] for r in rows)


def test_assignment_gives_up_only_where_draws_run_out(spark):
    items = spark.createDataFrame([("s", i) for i in range(6)], "scope_id string, who int").withColumn("rank", F.col("who"))
    draw = lambda df: df.withColumn("words", F.array(((F.col("who") + F.col("attempt")) % 8).cast("string")))
    taken = spark.createDataFrame([("s", "0"), ("s", "3"), ("t", "1")], "scope_id string, word string")
    got = {r.who: r.words[0] for r in assign(items, draw, taken, ["who"], "rank").collect()}
    assert sorted(got.values()) == ["1", "2", "4", "5", "6", "7"] and got[1] == "1"
    assert assign(items.limit(0), draw, taken, ["who"], "rank").collect() == []


def test_relative_dates(spark):
    data = [
        ("s", "D1", "13 July 2024", 3), ("s", "D1", "2024-07-20", 1), ("s", "D1", "Day 1", 1), ("s", "D2", "Day 15", 1), ("s", "D3", "the following Tuesday", 1),
        ("s", "D2", "two weeks after the July visit", 1), ("s", "D4", "Three days before the July assessment", 1), ("s", "D5", "nine days after the March visit", 1),
        ("s", "D6", "one week after the first dose visit", 1), ("s", "D7", "3rd March 2020", 1), ("s", "D8", "31/12/1960", 1), ("s", "D9", "March", 1), ("s", "D9", "Day 0", 1),
    ]
    forms = spark.createDataFrame(data, "scope_id string, who string, old string, n int").withColumn("shift", F.lit(-35))
    got = {r.old: (r.new, r.note) for r in relative.rendered(forms).collect()}
    assert got == {
        "13 July 2024": ("8 June 2024", None), "2024-07-20": ("2024-06-15", None), "Day 1": ("Day 1", None), "Day 15": ("Day 15", None), "Day 0": ("Day 0", None),
        "the following Tuesday": ("the following Tuesday", None), "two weeks after the July visit": ("two weeks after the June visit", "month"),
        "Three days before the July assessment": ("Three days before the June assessment", "month"),
        "nine days after the March visit": ("nine days after the visit", "dropped"), "one week after the first dose visit": ("one week after the first dose visit", None),
        "3rd March 2020": ("3rd March 2020", "unparsed"), "31/12/1960": ("31/12/1960", "unparsed"), "March": ("March", "unparsed"),
    }


def test_study_days_infer_a_date_only_where_one_first_dose_fits(spark):
    dates = spark.createDataFrame([("a", "D1", "2024-01-10"), ("a", "D2", "2024-01-19"), ("b", "D1", "2024-01-10"), ("b", "D2", "2024-02-01")], "scope_id string, who string, d string")
    dates = dates.select("scope_id", "who", F.to_date("d").alias("day"))
    phrases = spark.createDataFrame([("a", "D2", 10), ("a", "D3", -2), ("b", "D3", 5)], "scope_id string, who string, days int")
    assert {(r.scope_id, r.who, str(r.day)) for r in relative.study_dates(phrases, dates).collect()} == {("a", "D3", "2024-01-08")}


def test_refused_scopes_give_nothing_out(spark, tmp_path):
    ok = spread(("Julian Gray", "PATIENT", "E1"), ("13 July 2024", "DATE", "D1"))
    docs = {
        1: ("clean", ok), 2: ("clean", ["text"]), 3: ("kind", [("Julian Gray", "PERSON", "E1")]), 4: ("kind", ok),
        5: ("date", spread(("3rd March 2020", "DATE", "D1"))), 6: ("left", ["Julian came back, ", ("Julian Gray", "PATIENT", "E1")]),
        7: ("range", ok), 8: ("cross", ok),
    }
    rows, marks = tables(spark, docs)
    more = [(7, 5, 900, "PATIENT", "E1"), (8, 3, 7, "PATIENT", "E9"), (7, 8, 8, "AGE", "E1")]
    marks = marks.union(spark.createDataFrame(more, marks.schema))
    result = surrogates.run(rows, marks, SECRET)
    assert {r.doc_id for r in result.docs.collect()} == {1, 2}
    reasons = defaultdict(set)
    for r in result.refused.collect():
        reasons[r.scope_id].add((r.doc_id, r.reason))
    assert dict(reasons) == {
        "kind": {(3, "unknown_type")}, "date": {(None, "unparsed_date")}, "left": {(6, "residual")}, "range": {(7, "out_of_range"), (7, "overlap")}, "cross": {(8, "overlap")},
    }
    surrogates.publish(result, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/docs")).count() == 2 and spark.read.parquet(str(tmp_path / "out/refused")).count() == 6
    with pytest.raises(ValueError):
        surrogates.publish(result, str(tmp_path / "out"))
