"""Initials of surrogates: none twice before all are in use, whatever the size of the scope."""

from pyspark.sql import functions as F

from veilframe.functions import vocabulary as V
from veilframe.operators import profiles


def test_no_pair_is_used_twice_before_all_are(spark):
    name = lambda c, n: V.syllables(F.sha2(F.concat(F.lit(c), "scope_id", F.col("id").cast("string")), 256), n)
    each = spark.range(900).select("id", F.explode(F.array(*map(F.lit, ("s3", "s64", "s65", "s900")))).alias("scope_id"))
    forms = each.where("id < int(substring(scope_id, 2))").select(
        "scope_id", F.lit("k").alias("key"), F.lit("PATIENT").alias("type"), F.concat(F.lit("E"), "id").alias("who"),
        F.concat_ws(" ", name("a", 6), name("b", 7)).alias("old"), F.lit(1).alias("n"),
    )
    own, new, rows = {}, {}, profiles.surrogates(forms).collect()
    for r in rows:
        (a, b), (x, y) = r.old.split(), r.new.split()
        own.setdefault(r.scope_id, set()).add(a[0] + b[0])
        new.setdefault(r.scope_id, []).append(x[0] + y[0])
        assert a[0] != x[0] and b[0] != y[0]
    for scope, pairs in new.items():
        n = int(scope[1:])
        assert len(pairs) == n and not set(pairs) & own[scope]
        assert len(set(pairs)) == min(n, len(profiles.PAIRS) - len(own[scope]))


def test_others_make_way_for_a_person_that_few_pairs_suit():
    all_but = lambda *kept: [c for c in "abcdefghijklmnopqrstuvwxyz" if c not in kept]
    person = lambda first, last, k: {"start": 5 * k, "step": k, "first_initials": first, "last_initials": last}
    # the second and the third are suited by one pair each, of which the first may have both and one more
    persons = [person(all_but("q"), all_but("x", "y", "z"), 0), person(all_but("q"), all_but("x"), 1), person(all_but("q"), all_but("y"), 2), person(all_but("q"), all_but("x"), 3)]
    for order in ((0, 1, 2, 3), (0, 2, 1, 3), (1, 0, 3, 2)):
        got = profiles.dealt([persons[k] for k in order], set())
        assert {k: None if x is None else profiles.PAIRS[x] for k, x in zip(order, got)} == {0: "qz", 1: "qx", 2: "qy", 3: None}
    full = [person([], [], k % 300) for k in range(800)]
    got = profiles.dealt(full, {"aa", "zz"})
    assert None not in got[:674] and set(got[674:]) == {None} and len(set(got[:674])) == 674


def test_pairs_that_later_persons_get_suit_them_if_any_does(spark):
    """All pairs but one are originals': the person that it suits has it, another keeps to no pair."""
    people = spark.createDataFrame([("s", "E1", ["q"], ["a"]), ("s", "E2", ["a"], ["a"]), ("s", "E3", ["b"], ["a"])], "scope_id string, who string, first_initials array<string>, last_initials array<string>")
    originals = spark.createDataFrame([("s", p) for p in profiles.PAIRS if p != "qx"], "scope_id string, pair string")
    keys = spark.createDataFrame([("s", "k")], "scope_id string, key string")
    got = {r.who: r.pair for r in profiles.with_pairs(people, originals, keys).collect()}
    assert got == {"E1": None, "E2": "qx", "E3": "qx"}
