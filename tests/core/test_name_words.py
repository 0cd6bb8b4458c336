"""Which words of names are compared with others."""

from veilframe.operators import profiles


def test_only_words_that_nothing_places_are_compared(spark, monkeypatch):
    forms = spark.createDataFrame(
        [("s", "E1", "Anna Marlow", 2), ("s", "E1", "Anna", 1), ("s", "E1", "Mrs. Marlow", 1), ("s", "E1", "Marlowe", 1), ("s", "E1", "Ann", 1), ("s", "E2", "Mr. Bishop", 1), ("s", "E3", "Ivo", 1)],
        "scope_id string, who string, old string, n int",
    ).selectExpr("*", "'PATIENT' as type")
    sides, near = [], profiles.near

    def seen(left, right, by):
        sides.append((sorted(r.word for r in left.collect()), {r.who for r in right.collect()}))
        return near(left, right, by)

    monkeypatch.setattr(profiles, "near", seen)
    got = {(r.who, r.word): r.place for r in profiles.name_words(forms).collect()}
    assert got == {("E1", "anna"): "first", ("E1", "marlow"): "last", ("E1", "marlowe"): "last", ("E1", "ann"): "first", ("E2", "bishop"): "last", ("E3", "ivo"): "first"}
    assert sides == [(["ann", "ivo", "marlowe"], {"E1"})] * 2
