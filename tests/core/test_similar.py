"""Words of every length meet the words near them."""

import random

from veilframe.operators import profiles
from veilframe.operators.similar import LONGEST, near


def edited(word, edits, rng):
    for _ in range(edits):
        at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
        word = word[:at] + (rng.choice("ab") if kind else "") + word[at + (kind != 1) :]
    return word


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


def test_long_words_meet_the_words_near_them(spark):
    rng, words = random.Random(1), {"ö" * 40, "ö" * 39}
    for size in (*range(LONGEST - 3, LONGEST + 5), 47, 90):
        word = "".join(rng.choice("ab") for _ in range(size))
        words |= {word, *(edited(word, edits, rng) for edits in (1, 2, 2, 3) for _ in range(5))}
    words = sorted(words)
    for most in (1, 2):
        frame = spark.createDataFrame([(1, w) for w in words] + [(1, None)], "scope_id int, word string")
        got = [(r.word, r.near) for r in near(frame, frame, ["scope_id"], most).collect()]
        want = {(a, b) for a in words for b in words if abs(len(a) - len(b)) <= 2 and distance(a, b) <= most}
        assert len(got) == len(set(got)) and set(got) == want
    assert any(len(a) > LONGEST and len(b) <= LONGEST for a, b in want)


def test_a_long_lone_name_belongs_where_the_name_near_it_does(spark):
    """The word's beginning differs, so that only its distance tells that it is the first name."""
    first = "wolfeschlegelsteinhausenbergerdorff"
    lone = "v" + first[1:-1]
    forms = spark.createDataFrame(
        [("s", "E1", f"{first.title()} Marlow", 2), ("s", "E1", lone.title(), 1)], "scope_id string, who string, old string, n int"
    ).selectExpr("*", "'PATIENT' as type")
    got = {(r.word, r.place) for r in profiles.name_words(forms).collect()}
    assert got == {(first, "first"), ("marlow", "last"), (lone, "first")}
