"""Surrogates of persons, places, sites, numbers and addresses: one profile an entity, one rendering a form.

Work is on forms, the distinct texts of an entity in a scope, not on mentions. Profiles are aggregates of forms;
surrogates are keyed draws that `assign` holds apart within a scope; every form is then written anew from its pieces.
"""

from __future__ import annotations

from math import gcd

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import vocabulary as V
from veilframe.functions.keyed import first_bits
from veilframe.functions.text import address_surrogate, is_generic
from veilframe.operators.assign import assign
from veilframe.operators.shared import kept, small_batches
from veilframe.operators.similar import near

#: Draws that one attempt makes for an item; the first that suits it stands.
TRIES = 6
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Pairs of initials that surrogates of persons may have.
PAIRS = [a + b for a in _LETTERS for b in _LETTERS]
#: Steps that go through all pairs.
_STEPS = [k for k in range(1, len(PAIRS)) if gcd(k, len(PAIRS)) == 1]
#: Scopes in one batch while pairs are dealt.
_SCOPES = 256
#: Words of a city's name that are looked for in the names of sites.
CITY_WORDS = 6
#: Attempts after which a run of digits may become one digit longer, as a scope can use up all short ones.
LONGER = 8

_NAMES = ("PATIENT", "INVESTIGATOR")
_INITIALS = r"^(\p{Lu})\.(\p{Lu})\.$"
_SITE_EMAIL = r"^[a-z]+\.[a-z]+@site(\d+)\.example$"
_SITE_NUMBER = r"^(?:Site )?(\d+)$"


def _is_word(piece: Column) -> Column:
    return piece.rlike(r"^\p{L}")


def _name_words(text: Column) -> Column:
    """Words of a name but titles."""
    return F.filter(V.pieces(text), lambda w: _is_word(w) & ~V.contains(V.TITLES, V.bare(w)))


def _spelt(words: Column) -> Column:
    """Words that are no dotted initials."""
    return F.filter(words, lambda w: ~((F.length(w) == 2) & w.endswith(".")))


def person_forms(forms: DataFrame) -> DataFrame:
    return forms.where(F.col("type").isin(*_NAMES) & ~is_generic(F.col("old")))


def initials_pairs(forms: DataFrame) -> DataFrame:
    """(scope_id, pair): initials, in lower case, of all names of two words and of forms such as 'J.G.'."""
    words = _name_words(F.col("old"))
    ends = F.concat(F.substring(F.try_element_at(words, F.lit(1)), 1, 1), F.substring(F.try_element_at(words, F.lit(-1)), 1, 1))
    pair = F.when(F.size(words) >= 2, F.lower(ends))
    return person_forms(forms).select("scope_id", pair.alias("pair")).where("pair is not null").distinct()


def name_words(forms: DataFrame) -> DataFrame:
    """(scope_id, who, word, place, n): the words of each person and whether they are first or last names.

    Names of two words or more vote for both places. A word that occurs alone belongs where it has been seen;
    else it is a last name after a title or near a last name, a first name if near a first name, with the same
    first three letters as one, or known as one; else a last name if only last names are known, or a first name.
    """
    spelt = _spelt(_name_words(F.col("old")))
    pieces = F.filter(V.pieces(F.col("old")), _is_word)
    named = person_forms(forms).select("scope_id", "who", spelt.alias("w"), pieces.alias("all"), "n")
    ends = F.array(*(F.struct(V.bare(F.try_element_at("w", F.lit(i))).alias("word"), F.lit(place).alias("place")) for i, place in ((1, "first"), (-1, "last"))))
    full = named.where(F.size("w") >= 2).select("scope_id", "who", "n", F.explode(ends).alias("e")).select("scope_id", "who", "e.word", "e.place", "n")
    full = kept(full.groupBy("scope_id", "who", "word", "place").agg(F.sum("n").alias("n")), "name-words")
    before = F.try_element_at("all", F.size("all") - 1)
    titled = (F.size("all") >= 2) & V.contains(V.TITLES, V.bare(before)) & (F.try_element_at("all", F.lit(-1)) == F.try_element_at("w", F.lit(1)))
    alone = named.where(F.size("w") == 1).select("scope_id", "who", V.bare(F.try_element_at("w", F.lit(1))).alias("word"), titled.alias("titled"), "n")
    alone = kept(alone.groupBy("scope_id", "who", "word").agg(F.bool_or("titled").alias("titled"), F.sum("n").alias("n")), "lone-words")

    by = ["scope_id", "who"]
    is_at = lambda place: F.bool_or(F.col("place") == place)
    seen = full.groupBy(*by, "word").agg(is_at("first").alias("in_first"), is_at("last").alias("in_last"))
    has = full.groupBy(*by).agg(is_at("first").alias("has_first"))
    # only words that neither full names nor titles place are compared with others, and only with those of their person
    unplaced = kept(alone.where(~F.coalesce("titled", F.lit(False))).join(seen, [*by, "word"], "left_anti").select(*by, "word"), "unplaced")
    others = full.join(unplaced.select(*by).distinct(), by, "left_semi")
    firsts, lasts = (others.where(F.col("place") == p).select(*by, "word") for p in ("first", "last"))
    like_last = near(unplaced, lasts, by).select(*by, "word").distinct().withColumn("like_last", F.lit(True))
    begins = lambda df, name: df.where(F.length("word") >= 3).select(*by, F.col("word").alias(name), F.substring("word", 1, 3).alias("begin"))
    same_begin = begins(unplaced, "word").join(begins(firsts, "f"), [*by, "begin"]).select(*by, "word")
    like_first = near(unplaced, firsts, by).select(*by, "word").union(same_begin).distinct().withColumn("like_first", F.lit(True))
    placed = alone
    for more, on in ((seen, [*by, "word"]), (has, by), (like_last, [*by, "word"]), (like_first, [*by, "word"])):
        placed = placed.join(more, on, "left")
    known = V.contains([w.lower() for w in V.FEMALE_NAMES + V.MALE_NAMES] + V.KNOWN_FEMALE + V.KNOWN_MALE, F.col("word"))
    place = (
        F.when(F.col("in_last"), "last").when(F.col("in_first"), "first").when(F.col("titled") | F.col("like_last"), "last")
        .when(F.col("like_first") | known, "first").when(F.col("has_first"), "last").otherwise("first")
    )
    return full.unionByName(placed.select(*by, "word", place.alias("place"), "n")).groupBy(*by, "word", "place").agg(F.sum("n").alias("n"))


def persons(forms: DataFrame, words: DataFrame) -> DataFrame:
    """(scope_id, who, sex, main_first, first_initials, last_initials): sex is F, M or null."""
    title = lambda names: F.bool_or(F.exists(V.pieces(F.col("old")), lambda w: V.contains(names, V.bare(w))))
    base = person_forms(forms).groupBy("scope_id", "who").agg(title(V.MALE_TITLES).alias("he"), title(V.FEMALE_TITLES).alias("she"))
    first, last = F.col("place") == "first", F.col("place") == "last"
    initial = F.substring("word", 1, 1)
    tokens = words.groupBy("scope_id", "who").agg(
        F.min_by(F.when(first, F.col("word")), F.struct((~first).alias("f"), (-F.col("n")).alias("n"), "word")).alias("main_first"),
        F.collect_set(F.when(first, initial)).alias("first_initials"), F.collect_set(F.when(last, initial)).alias("last_initials"),
    )
    known = lambda own, pool: V.contains(own + [w.lower() for w in pool], F.col("main_first"))
    sex = F.when(F.col("he"), "M").when(F.col("she"), "F").when(known(V.KNOWN_FEMALE, V.FEMALE_NAMES), "F").when(known(V.KNOWN_MALE, V.MALE_NAMES), "M")
    none = F.expr("cast(array() as array<string>)")
    return base.join(tokens, ["scope_id", "who"], "left").select(
        "scope_id", "who", sex.alias("sex"), "main_first", *(F.coalesce(c, none).alias(c) for c in ("first_initials", "last_initials"))
    )


def places(forms: DataFrame) -> DataFrame:
    """(scope_id, who, city, region, country) of places; the form with most parts tells which part is which."""
    parts = F.transform(F.split("old", ","), lambda p: F.trim(p))
    each = forms.where("type = 'LOCATION'").select("scope_id", "who", "old", parts.alias("p"))
    full = each.groupBy("scope_id", "who").agg(F.min_by("p", F.struct((-F.size("p")).alias("n"), "old")).alias("p"))
    last = F.try_element_at("p", F.lit(-1))
    ends = V.contains(V.COUNTRIES, last)
    body = F.when(ends, F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p"))
    full = full.select("scope_id", "who", F.when(ends, last).alias("country"), body.alias("b"))
    one = F.try_element_at("b", F.lit(1))
    is_region = lambda w: V.contains(V.REGIONS, w) & ~V.contains(V.CITIES, w)
    full = full.select(
        "scope_id", "who", "country",
        F.when((F.size("b") >= 2) | (F.size("b") == 1) & ~is_region(one), one).alias("city"),
        F.when(F.size("b") >= 2, F.try_element_at("b", F.lit(2))).when((F.size("b") == 1) & is_region(one), one).alias("region"),
    )
    # a mention of one part may name what the longest one lacks
    word = F.try_element_at("p", F.lit(1))
    lone = each.where(F.size("p") == 1).join(full, ["scope_id", "who"]).where(
        ~word.eqNullSafe(F.col("city")) & ~word.eqNullSafe(F.col("region")) & ~V.contains(V.COUNTRIES, word)
    )
    more = lone.groupBy("scope_id", "who").agg(F.min(F.when(V.contains(V.REGIONS, word), word)).alias("r"), F.min(F.when(~is_region(word), word)).alias("c"))
    out = full.join(more, ["scope_id", "who"], "left").select(
        "scope_id", "who", F.coalesce("city", "c").alias("city"), F.coalesce("region", "r").alias("region"), "country"
    )
    ours = [w for pair in V.PLACES["Canada"] for w in pair]
    north = V.contains(ours, F.col("region")) | V.contains(ours, F.col("city"))
    return out.withColumn("country", F.coalesce("country", F.when(F.coalesce(north, F.lit(False)), "Canada").otherwise("United States")))


def _head(text: Column) -> Column:
    """Words of a site's name before the first institution word."""
    body = F.split(F.regexp_replace(F.regexp_replace(text, "^the ", ""), " site$", ""), " ")
    at = F.array_position(F.transform(body, lambda w: V.contains(V.INSTITUTION_WORDS, F.lower(w))), True)
    return F.when(at == 0, body).otherwise(F.slice(body, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))


def sites(forms: DataFrame, located: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Site numbers (scope_id, old), cities of located entities in site names (scope_id, who, city, place), own cities
    (scope_id, who, city) and proper names (scope_id, old).

    A city meets the names of its scope's sites by an equi-join on runs of words; the longest city of an entity counts.
    A site without one may begin with a known city; else the capitalised words of its beginning are proper names.
    """
    each = forms.where("type = 'SITE'").select("scope_id", "who", "old", F.regexp_extract("old", _SITE_NUMBER, 1).alias("number"))
    numbers = each.where("number <> ''").select("scope_id", F.col("number").alias("old")).distinct()
    names = each.where("number = ''")
    words = names.select("scope_id", "who", F.filter(F.split("old", r"[^\p{L}\p{N}'\-]+"), lambda w: w != "").alias("w"))
    runs = words.select("scope_id", "who", "w", F.posexplode("w").alias("i", "_")).select(
        "scope_id", "who",
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(CITY_WORDS)), lambda n: F.when(F.col("i") + n <= F.size("w"), F.array_join(F.slice("w", F.col("i") + 1, n), " ")))).alias("run"),
    ).where("run is not null").distinct()
    known = located.where("city is not null").select("scope_id", F.col("who").alias("place"), "city", F.array_join(F.filter(F.split("city", r"[^\p{L}\p{N}'\-]+"), lambda w: w != ""), " ").alias("run"))
    met = runs.join(known, ["scope_id", "run"])
    longest = F.struct((-F.length("city")).alias("n"), "city", "place")
    of_place = met.groupBy("scope_id", "who").agg(F.min_by(F.struct("city", "place"), longest).alias("x")).select("scope_id", "who", "x.city", "x.place")
    rest = names.join(of_place, ["scope_id", "who"], "left_anti").select("scope_id", "who", _head(F.col("old")).alias("head"))
    phrase = F.array_join("head", " ")
    is_city = V.contains([c.lower() for c in V.CITIES], F.lower(phrase))
    own = rest.where(is_city).groupBy("scope_id", "who").agg(F.min(phrase).alias("city"))
    named = rest.where(~is_city).select("scope_id", F.explode(F.filter("head", lambda w: w.rlike(r"^\p{Lu}\p{L}*$"))).alias("w"))
    return numbers, of_place, own, named.select("scope_id", F.lower("w").alias("old")).distinct()


def forbidden(forms: DataFrame) -> DataFrame:
    """(scope_id, word): words of two letters or more and runs of three digits or more of a scope's originals."""
    own = forms.where(F.col("type").isin("PATIENT", "INVESTIGATOR", "SITE", "LOCATION", "ID", "CONTACT") & ~is_generic(F.col("old")))
    words = F.filter(
        F.transform(V.pieces(F.col("old")), lambda w: F.when(_is_word(w), V.bare(w)).otherwise(w)),
        lambda w: F.when(_is_word(w), (F.length(w) > 1) & ~V.contains(V.TITLES + V.INSTITUTION_WORDS, w)).otherwise(w.rlike("^[0-9]{3,}$")),
    )
    return own.select("scope_id", F.explode(words).alias("word")).distinct()


def dealt(persons: list[dict], gone: set[str]) -> list[int | None]:
    """The pair of each person of a scope, none twice: as many persons as can be have one, those that come first before others.

    A person tries the pairs in an order of its own; where no free one suits, others make way for it (augmenting paths).
    """
    free = [p not in gone for p in PAIRS]
    holder: dict[int, int] = {}
    own: list[int | None] = [None] * len(persons)
    for k in range(len(persons)):
        asked, seen = [k], {}
        for q in asked:  # grows by the persons whose pairs are wanted
            x = persons[q]
            at, step, first, last = x["start"], _STEPS[x["step"]], x["first_initials"], x["last_initials"]
            for _ in PAIRS:
                at = (at + step) % len(PAIRS)
                if at in seen or not free[at] or PAIRS[at][0] in first or PAIRS[at][1] in last:
                    continue
                seen[at] = q
                if at not in holder:
                    while at is not None:
                        holder[at], own[seen[at]], at = seen[at], at, own[seen[at]]
                    break
                asked.append(holder[at])
            if own[k] is not None:
                break
    return own


def _deal(batches):
    """Rows (scope_id, gone, persons) -> (scope_id, who, pair) of persons that have one."""
    for batch in batches:
        rows = []
        for scope, gone, persons in zip(*[batch.column(c).to_pylist() for c in ("scope_id", "gone", "persons")], strict=True):
            persons.sort(key=lambda x: x["place"])
            rows += [(scope, x["who"], PAIRS[k]) for x, k in zip(persons, dealt(persons, set(gone or ())), strict=True) if k is not None]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field("scope_id").type if i == 0 else pa.string()) for i, c in enumerate(columns)], ["scope_id", "who", "pair"])


def with_pairs(people: DataFrame, originals: DataFrame, keys: DataFrame) -> DataFrame:
    """people(scope_id, who, first_initials, last_initials, ...) with `pair`, the initials that a person's surrogate gets.

    A pair is no original's (originals(scope_id, pair)), and both letters are others than the person's own. No two persons
    of a scope share one before every pair that suits them is in use: the first persons, as many as there are pairs, are
    dealt different ones in one row of their scope, and again others as long as pairs are left that suit one. Later
    persons draw among all. pair is null where every pair that suits a person is an original's.
    """
    spark = people.sparkSession
    every = F.array(*map(F.lit, PAIRS))
    suits = lambda p: ~F.array_contains("first_initials", F.substring(p, 1, 1)) & ~F.array_contains("last_initials", F.substring(p, 2, 1))
    bits = lambda name: first_bits(F.sha2(F.concat_ws("|", "key", F.lit(name), "who"), 256))
    number = F.coalesce(F.substring(F.regexp_replace("who", "[^0-9]", ""), 1, 18).try_cast("long"), F.lit(0))
    waiting = people.select("scope_id", "who", "first_initials", "last_initials", number.alias("number")).join(keys, "scope_id")
    waiting = waiting.withColumns({"start": bits("start") % len(PAIRS), "step": bits("step") % len(_STEPS)})
    taken = originals.where(F.col("pair").isin(PAIRS)).groupBy("scope_id").agg(F.collect_set("pair").alias("gone"))
    of_originals, found, again = kept(taken, "original-pairs"), None, False
    taken = of_originals
    while True:
        able = waiting.join(taken, "scope_id", "left").withColumn("gone", F.coalesce("gone", F.expr("cast(array() as array<string>)")))
        if again:
            able = able.where(F.exists(F.array_except(every, "gone"), suits))
        place = F.row_number().over(Window.partitionBy("scope_id").orderBy("number", "who"))
        first = able.withColumn("place", place).where((F.col("place") <= len(PAIRS)) & (F.col("place") <= len(PAIRS) - F.size("gone")))
        person = F.struct("place", "who", "start", "step", "first_initials", "last_initials")
        scopes = first.groupBy("scope_id").agg(F.first("gone").alias("gone"), F.collect_list(person).alias("persons"))
        schema = f"scope_id {people.schema['scope_id'].dataType.simpleString()}, who string, pair string"
        with small_batches(spark, _SCOPES):
            pairs = kept(scopes.mapInArrow(_deal, schema), "pairs")
        if pairs.isEmpty():
            break
        found = pairs if found is None else found.union(pairs)
        waiting = kept(waiting.join(pairs.select("scope_id", "who"), ["scope_id", "who"], "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        used = found.select("scope_id", "pair").union(of_originals.select("scope_id", F.explode("gone").alias("pair")))
        taken, again = used.groupBy("scope_id").agg(F.collect_set("pair").alias("gone")), True
        waiting_scopes = waiting.select("scope_id").distinct()
        if taken.join(waiting_scopes, "scope_id").where(F.size("gone") < len(PAIRS)).isEmpty():
            break
    # the pairs that several may have: no original's
    open_pairs = waiting.select("scope_id").distinct().join(of_originals, "scope_id", "left").select(
        "scope_id", F.array_except(every, F.coalesce("gone", F.expr("cast(array() as array<string>)"))).alias("left")
    )
    draws = F.transform(F.sequence(F.lit(1), F.lit(TRIES)), lambda i: F.get("left", ((F.col("start") + i * F.col("step") * 7) % F.size("left")).cast("int")))
    shared = F.when(F.size("left") > 0, F.coalesce(F.try_element_at(F.filter(draws, suits), F.lit(1)), F.try_element_at(F.filter("left", suits), F.lit(1))))
    more = waiting.join(open_pairs, "scope_id").select("scope_id", "who", shared.alias("pair"))
    return people.join(more if found is None else found.union(more), ["scope_id", "who"], "left")


def _of_letter(pool: list[str], letter: Column, h: Column, at: int) -> Column:
    """A name of the pool that begins with the letter, or null."""
    own = F.get(F.array(*(F.array(*(F.lit(n) for n in pool if n.lower().startswith(c)), F.lit("")) for c in _LETTERS)), F.ascii(letter) - ord("a"))
    n = F.size(own) - 1
    return F.when(n > 0, F.get(own, (first_bits(F.substring(h, at, 15)) % n).cast("int")))


def _begun(word: Column, letter: Column) -> Column:
    """A word of syllables that begins with the letter, if there is one."""
    rest = F.when(letter.isin(*"aeiou"), F.lower(word)).otherwise(F.substring(word, 2, 1 << 20))
    return F.when(letter.isNull(), word).otherwise(F.concat(F.upper(letter), rest))


def _pick(pool: list[str], h: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (first_bits(F.substring(h, at, 15)) % len(pool) + 1).cast("int"))


def draw(items: DataFrame) -> DataFrame:
    """The first of TRIES keyed draws that suits its item: a and b, nick, and the words that it takes."""
    at = F.sequence(F.lit(0), F.lit(TRIES - 1))
    hashes = F.transform(at, lambda i: F.sha2(F.concat_ws("|", "key", "kind", "who", "old", (F.col("attempt") * TRIES + i).cast("string")), 256))
    kind, pooled, tail = F.col("kind"), F.col("attempt") == 0, lambda h, k: F.substring(h, k, 32)
    size = (F.lit(5) + 2 * F.least(F.floor(F.col("attempt") / 2), F.lit(4))).cast("int")
    woman = lambda h: F.when(F.col("sex").isNull(), first_bits(F.substring(h, 40, 15)) % 2 == 0).otherwise(F.col("sex") == "F")
    lost = F.col("country") == "Canada"
    wide = (F.length("old") + F.when(F.col("attempt") >= LONGER, 1).otherwise(0)).cast("int")

    def number(h):
        run = V.digits(h, wide)
        return F.when((F.substring("old", 1, 1) != "0") & run.startswith("0"), F.concat(F.lit("8"), F.substring(run, F.lit(2), wide))).otherwise(run)

    def one(h):
        town, state = [
            F.when(lost, _pick([p[k] for p in V.PLACES["Canada"]], h, 1)).otherwise(_pick([p[k] for p in V.PLACES["United States"]], h, 1)) for k in (0, 1)
        ]
        made = V.syllables(h, size)
        x, y = F.substring("pair", 1, 1), F.substring("pair", 2, 1)

        def named(pool, at, letter, otherwise):
            """A name of the pool in the first attempt, if it has one with the letter."""
            of_pool = F.when(letter.isNull(), _pick(pool, h, at)).otherwise(_of_letter(pool, letter, h, at))
            return F.coalesce(F.when(pooled, of_pool), otherwise)

        first = F.when(woman(h), named(V.FEMALE_NAMES, 1, x, F.concat(_begun(made, x), F.lit("a")))).otherwise(named(V.MALE_NAMES, 1, x, _begun(made, x)))
        last = named(V.LAST_NAMES, 20, y, F.concat(_begun(V.syllables(tail(h, 20), size), y), F.lit("en")))
        a = (
            F.when(kind == "person", first).when(kind.isin("place", "own_city"), F.when(pooled, town).otherwise(F.concat(made, F.lit("ton"))))
            .when(kind == "name", last).otherwise(number(h))
        )
        b = F.when(kind == "person", last).when(kind.isin("place", "own_city"), F.when(pooled, state).otherwise(F.concat(V.syllables(tail(h, 20), size), F.lit("shire"))))
        return F.struct(a.alias("a"), b.alias("b"))

    def finished(c):
        nick = F.when(F.length(c["a"]) >= 5, F.substring(c["a"], 1, 3)).otherwise(c["a"])
        low = lambda x, y: F.lower(F.concat_ws(" ", x, y))
        words = F.when(kind == "person", F.array(F.lower(c["a"]), F.lower(c["b"]))).otherwise(
            F.split(F.when(kind == "own_city", F.lower(c["a"])).otherwise(low(c["a"], c["b"])), " ")
        )
        avoid = F.when(kind == "person", F.array(F.lower(nick)))
        return F.struct(
            c["a"].alias("a"), c["b"].alias("b"), F.when(kind == "person", nick).alias("nick"), F.array_distinct(words).alias("words"), avoid.alias("avoid")
        )

    def suits(c):
        person = (
            ~F.array_contains("first_initials", F.lower(F.substring(c["a"], 1, 1))) & ~F.array_contains("last_initials", F.lower(F.substring(c["b"], 1, 1)))
            & (F.lower(c["a"]) != F.lower(c["b"]))
        )
        place = ~c["a"].eqNullSafe(F.col("city")) & ~c["b"].eqNullSafe(F.col("region"))
        return F.when(kind == "person", person).when(kind.isin("place", "own_city"), place).otherwise(c["a"] != F.col("old"))

    found = F.try_element_at(F.filter(F.transform(F.transform(hashes, one), finished), suits), F.lit(1))
    return items.withColumn("c", found).select("*", "c.a", "c.b", "c.nick", "c.words", "c.avoid").drop("c")


def _items(forms: DataFrame, keys: DataFrame, words: DataFrame, originals: DataFrame) -> tuple[DataFrame, dict]:
    """Everything that needs a surrogate, and the profiles. originals: the scopes' own pairs of initials."""
    people, located = with_pairs(kept(persons(forms, words), "persons"), originals, keys), kept(places(forms), "places")
    numbers, of_place, own_city, names = sites(forms, located)
    numbers, own_city, of_place = kept(numbers, "site-numbers"), kept(own_city, "own-cities"), kept(of_place, "site-places")
    runs = forms.where(F.col("type").isin("ID", "CONTACT")).select("scope_id", "who", "type", F.explode(F.regexp_extract_all("old", F.lit("[0-9]+"), F.lit(0))).alias("old"))
    runs = runs.where((F.length("old") >= 2) & ~((F.col("type") == "CONTACT") & (F.col("old") == "555"))).select("scope_id", "who", "old").distinct()
    runs = runs.join(numbers, ["scope_id", "old"], "left_anti")
    north = located.groupBy("scope_id").agg(F.max(F.when(F.col("country") == "Canada", "Canada")).alias("north"))
    home = own_city.join(north, "scope_id", "left").withColumn("country", F.coalesce("north", F.lit("United States")))
    form = {"who": "", "old": "", "sex": None, "city": None, "region": None, "country": None, "first_initials": None, "last_initials": None, "pair": None}
    types = {"first_initials": "array<string>", "last_initials": "array<string>"}

    def shaped(df, order, kind):
        cells = [F.col(c).alias(c) if c in df.columns else F.lit(v).cast(types.get(c, "string")).alias(c) for c, v in form.items()]
        return df.select("scope_id", F.lit(order).alias("order"), F.lit(kind).alias("kind"), *cells)

    every = (
        shaped(located, 1, "place").unionByName(shaped(home, 2, "own_city")).unionByName(shaped(numbers, 3, "number"))
        .unionByName(shaped(names, 4, "name")).unionByName(shaped(people, 5, "person")).unionByName(shaped(runs, 6, "digits"))
    )
    number = F.coalesce(F.substring(F.regexp_replace("who", "[^0-9]", ""), 1, 18).try_cast("long"), F.lit(0))
    every = every.join(keys, "scope_id").withColumn("rank", F.struct("order", number.alias("number"), "who", "old")).drop("order")
    return every, {"located": located, "of_place": of_place, "own_city": own_city}


def surrogates(forms: DataFrame) -> DataFrame:
    """forms(scope_id, key, type, who, old, n) of names, places, sites, numbers and addresses -> (scope_id, type, who, old, new, note).

    who names an entity, key is the scope's secret key in hex. The note `unclassified` marks names with a word that
    no rule could place; it is replaced all the same. Generic references are not among the results.
    """
    words = kept(name_words(forms), "words")
    items, profiles = _items(forms, forms.select("scope_id", "key").distinct(), words, initials_pairs(forms))
    taken = kept(forbidden(forms), "forbidden")
    drawn = assign(kept(items, "items"), draw, taken, ["kind", "who", "old"], "rank").drop("words", "avoid", "rank", "key")
    drawn = kept(drawn, "surrogates")
    of = lambda kind: drawn.where(F.col("kind") == kind)
    return (
        _names(forms, words, of("person")).unionByName(_places(forms, of("place")))
        .unionByName(_sites(forms, profiles, of("place"), of("own_city"), of("number"), of("name")))
        .unionByName(_numbers(forms, of("person"), of("number"), of("digits")))
    )


_FORM = ["scope_id", "type", "who", "old"]


def _names(forms: DataFrame, words: DataFrame, people: DataFrame) -> DataFrame:
    roles = words.groupBy("scope_id", "who", "word").agg(
        F.bool_or(F.col("place") == "first").alias("is_first"), F.bool_or(F.col("place") == "last").alias("is_last")
    )
    main = words.where("place = 'first'").groupBy("scope_id", "who").agg(F.min_by("word", F.struct((-F.col("n")).alias("n"), "word")).alias("main"))
    each = person_forms(forms).select(*_FORM, F.posexplode(V.pieces(F.col("old"))).alias("i", "piece"))
    spelt = F.when(_is_word(F.col("piece")), V.bare(F.col("piece")))
    each = each.withColumn("word", spelt).join(roles, ["scope_id", "who", "word"], "left")
    title = F.coalesce(V.contains(V.TITLES, F.col("word")), F.lit(False))
    initial = F.coalesce((F.length("word") == 1) & F.col("piece").endswith("."), F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(False))
    piece = F.struct("i", "piece", "word", title.alias("title"), initial.alias("initial"), no("is_first").alias("is_first"), no("is_last").alias("is_last"))
    whole = each.groupBy(*_FORM).agg(F.array_sort(F.collect_list(piece)).alias("ts"))
    whole = whole.join(people.select("scope_id", "who", "a", "b", "nick"), ["scope_id", "who"]).join(main, ["scope_id", "who"], "left")
    ts = F.col("ts")
    has_last = F.exists(ts, lambda t: t["is_last"])
    last_word = F.array_max(F.transform(F.filter(ts, lambda t: t["word"].isNotNull()), lambda t: t["i"]))
    several = F.size(F.filter(ts, lambda t: t["word"].isNotNull())) > 1

    def new(t):
        earlier = F.exists(ts, lambda u: u["initial"] & (u["i"] < t["i"]))
        dotted = F.concat(F.substring(F.when(has_last | ~earlier, F.col("a")).otherwise(F.col("b")), 1, 1), F.lit("."))
        plain = (
            F.when(t["is_first"], F.when(t["word"].eqNullSafe(F.col("main")), F.col("a")).otherwise(F.col("nick"))).when(t["is_last"], F.col("b"))
            .when(several & (t["i"] == last_word), F.col("b")).otherwise(F.col("a"))
        )
        shouted = (F.length(t["word"]) > 1) & (F.upper(t["piece"]) == t["piece"])
        return (
            F.when(t["word"].isNull() | t["title"], t["piece"]).when(t["initial"], dotted)
            .otherwise(F.concat(F.when(shouted, F.upper(plain)).otherwise(plain), F.when(t["piece"].endswith("."), ".").otherwise("")))
        )

    unknown = F.exists(ts, lambda t: t["word"].isNotNull() & ~t["title"] & ~t["initial"] & ~t["is_first"] & ~t["is_last"])
    return whole.select(*_FORM, F.array_join(F.transform(ts, new), "").alias("new"), F.when(unknown, "unclassified").alias("note"))


def _places(forms: DataFrame, drawn: DataFrame) -> DataFrame:
    each = forms.where("type = 'LOCATION'").select(*_FORM).join(drawn.select("scope_id", "who", "city", "region", "a", "b"), ["scope_id", "who"])
    new = F.coalesce(F.regexp_replace("old", V.quoted(F.col("city")), F.col("a")), "old")
    new = F.coalesce(F.regexp_replace(new, V.quoted(F.col("region")), F.col("b")), new)
    kept_country = V.contains(V.COUNTRIES, F.col("old"))
    # a form that holds neither part is another place of the entity: no part of it may stay
    return each.select(*_FORM, F.when((new == F.col("old")) & ~kept_country, F.col("a")).otherwise(new).alias("new"), F.lit(None).cast("string").alias("note"))


def _pieced(each: DataFrame, text: str, found: Column) -> DataFrame:
    """Forms put together from their pieces, found for a piece where it is not null."""
    parts = F.array_sort(F.collect_list(F.struct("i", F.coalesce(found, "piece").alias("new"))))
    whole = each.groupBy(*_FORM).agg(parts.alias("ps"))
    return whole.select(*_FORM, F.array_join(F.transform("ps", lambda p: p["new"]), "").alias(text))


def _sites(forms: DataFrame, profiles: dict, place: DataFrame, own_city: DataFrame, numbers: DataFrame, names: DataFrame) -> DataFrame:
    of_place = profiles["of_place"].join(place.select("scope_id", F.col("who").alias("place"), F.col("a").alias("town")), ["scope_id", "place"])
    towns = of_place.select("scope_id", "who", "city", "town").unionByName(
        profiles["own_city"].join(own_city.select("scope_id", "who", F.col("a").alias("town")), ["scope_id", "who"])
    )
    each = forms.where("type = 'SITE'").select(*_FORM).join(towns, ["scope_id", "who"], "left")
    moved = F.coalesce(F.regexp_replace("old", V.quoted(F.col("city")), F.col("town")), "old")
    each = each.select(*_FORM, F.posexplode(V.pieces(moved)).alias("i", "piece")).withColumn("word", F.when(F.col("piece").rlike("^[0-9]"), F.col("piece")).otherwise(V.bare(F.col("piece"))))
    swap = numbers.unionByName(names).select("scope_id", F.col("old").alias("word"), "a")
    each = each.join(swap, ["scope_id", "word"], "left")
    shouted = (F.length("piece") > 1) & (F.upper("piece") == F.col("piece"))
    out = _pieced(each, "new", F.when(shouted, F.upper("a")).otherwise(F.col("a")))
    return out.withColumn("note", F.lit(None).cast("string"))


def _numbers(forms: DataFrame, people: DataFrame, numbers: DataFrame, runs: DataFrame) -> DataFrame:
    own = forms.where(F.col("type").isin("ID", "CONTACT")).select(*_FORM, "key")
    each = own.select(*_FORM, F.posexplode(V.pieces(F.col("old"))).alias("i", "piece"))
    each = each.join(numbers.select("scope_id", F.col("old").alias("piece"), F.col("a").alias("of_site")), ["scope_id", "piece"], "left")
    each = each.join(runs.select("scope_id", "who", F.col("old").alias("piece"), "a"), ["scope_id", "who", "piece"], "left")
    keep = (F.length("piece") < 2) | (F.col("type") == "CONTACT") & (F.col("piece") == "555")
    out = _pieced(each, "swapped", F.coalesce("of_site", F.when(keep, F.col("piece")), "a"))
    out = out.join(own, _FORM).join(people.select("scope_id", "who", "a", "b"), ["scope_id", "who"], "left")
    digest = F.sha2(F.concat_ws("|", "key", "type", "who", "old"), 256)
    site = F.regexp_extract("swapped", r"@site(\d+)\.example$", 1)
    own_address = F.concat(F.lower("a"), F.lit("."), F.lower("b"), F.lit("@site"), site, F.lit(".example"))
    mail = (F.col("type") == "CONTACT") & F.col("old").contains("@")
    new = F.when(mail & F.col("old").rlike(_SITE_EMAIL) & F.col("a").isNotNull(), own_address).when(mail, address_surrogate(F.col("old"), digest)).otherwise(F.col("swapped"))
    return out.select(*_FORM, new.alias("new"), F.lit(None).cast("string").alias("note"))
