"""Words at an edit distance of two at most, by an equi-join on what two near words have in common.

Short words meet on what is left when letters are deleted, long ones on the thirds of one of them: two edits leave one
third as it is, and move it by two places at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a word up to which it meets by deletions, whose number grows with the square of the length; longer pairs meet by thirds.
LONGEST = 24
#: Edits that the keys allow for.
MOST = 2


def _without_one(word: Column) -> Column:
    cut = lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word)))
    return F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(1), F.length(word)), cut)).otherwise(_none())


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def deletions(word: Column) -> Column:
    """The word, and what is left of it without one or two letters."""
    once = _without_one(word)
    twice = F.flatten(F.transform(once, _without_one))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def _third(size: Column, i: Column) -> tuple[Column, Column]:
    """Place and length of the third i (from 0) of a word of so many letters; the last one may be longer."""
    own = F.floor(size / 3)
    return i * own + 1, F.when(i == 2, size - 2 * own).otherwise(own)


def _named(word: Column, size: Column, i: Column, at: Column, n: Column) -> Column:
    return F.concat_ws("|", size.cast("string"), i.cast("string"), word.substr(at.cast("int"), n.cast("int")))


def thirds(word: Column) -> Column:
    """The thirds of a word, each with the word's length and its number."""
    size = F.length(word)
    return F.transform(F.array(*map(F.lit, range(3))), lambda i: _named(word, size, i, *_third(size, i)))


def at_thirds(word: Column) -> Column:
    """What stands in a word where thirds of a word within MOST edits may stand, named as those are."""
    own, moves = F.length(word), F.array(*map(F.lit, range(-MOST, MOST + 1)))

    def places(size, i):
        at, n = _third(size, i)
        fits = F.filter(F.transform(moves, lambda m: at + m), lambda a: (a >= 1) & (a + n - 1 <= own))
        return F.transform(fits, lambda a: _named(word, size, i, a, n))

    sizes = F.transform(moves, lambda m: own + m)
    return F.flatten(F.transform(sizes, lambda size: F.flatten(F.transform(F.array(*map(F.lit, range(3))), lambda i: places(size, i)))))


def _keys(word: Column, long: Column) -> Column:
    """A pair meets by deletions if both words are short; else both have LONGEST + 1 - MOST letters or more."""
    size = F.length(word)
    return F.concat(F.when(size <= LONGEST, deletions(word)).otherwise(_none()), F.when(size > LONGEST - MOST, long).otherwise(_none()))


def near(left: DataFrame, right: DataFrame, by: list[str], most: int = MOST) -> DataFrame:
    """(by..., word, near): words of left(by..., word) and right(by..., word) with an edit distance of `most` (0 to 2) or less.

    Two words at distance d <= 2 leave a common string after at most d deletions on either side, and one of them has a
    third that stands in the other, so pairs meet on such strings only, whatever their length; the distance itself is
    tested on the pairs that meet. Nulls meet nothing.
    """
    word = F.col("word")
    a = left.select(*by, "word", F.explode(_keys(word, at_thirds(word))).alias("rest"))
    b = right.select(*by, word.alias("near"), F.explode(_keys(word, thirds(word))).alias("rest"))
    met = a.join(b, [*by, "rest"]).select(*by, "word", "near").distinct()
    return met.where(F.levenshtein("word", "near", most) >= 0)
