"""Word lists: what marks titles, institutions and countries, and what surrogates are drawn from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles, words of institutions and countries that are kept.
TITLES = "dr mr mrs ms prof miss".split()
MALE_TITLES, FEMALE_TITLES = ["mr"], ["mrs", "ms", "miss"]
INSTITUTION_WORDS = (
    "memorial hospital clinical research institute center centre investigational medicine medical unit north south east west "
    "central site the general university regional health sciences clinic"
).split()
COUNTRIES = ["Canada", "United States"]

# Pools of the first draws; later draws are made of syllables and never run out.
FEMALE_NAMES = "Alba Celia Dagmar Elin Fenna Greta Hedda Ines Jorun Karla Lovisa Mira Nele Olga Petra Runa Sunniva Tilda Vera Ylva".split()
MALE_NAMES = "Arvid Bruno Casper Dario Emil Felix Gustav Hugo Ivar Jonas Kasimir Lars Matteo Nils Oskar Pavel Rurik Sven Tiber Viktor".split()
LAST_NAMES = (
    "Abend Birke Corvin Dahl Ekholm Falk Grunwald Holm Ivers Jansen Kestrel Lindgren Moravec Norden Olsson Pirelli Quist Rosander "
    "Stensund Torvik Ulfsen Vintner Wendel Zander"
).split()
PLACES = {
    "United States": [
        ("Duluth", "Minnesota"), ("Spokane", "Washington"), ("Macon", "Georgia"), ("Topeka", "Kansas"), ("Bangor", "Maine"), ("Reno", "Nevada"),
        ("Provo", "Utah"), ("Tulsa", "Oklahoma"), ("Eugene", "Oregon"), ("Toledo", "Ohio"), ("Lafayette", "Louisiana"), ("Wichita Falls", "Texas"),
    ],
    "Canada": [
        ("Moncton", "New Brunswick"), ("Kelowna", "British Columbia"), ("Guelph", "Ontario"), ("Brandon", "Manitoba"), ("Lethbridge", "Alberta"),
        ("Gander", "Newfoundland"), ("Rimouski", "Quebec"), ("Truro", "Nova Scotia"),
    ],
}
CITIES = [city for pool in PLACES.values() for city, _ in pool]
REGIONS = [region for pool in PLACES.values() for _, region in pool]

# First names by which originals are known to be a woman's or a man's, beside the pools.
KNOWN_FEMALE = "mary linda susan karen lisa nancy sandra ashley emily donna carol laura julia anna ruth maria elena nora lena eva".split()
KNOWN_MALE = "james robert john david william richard thomas charles daniel matthew mark paul george kevin brian edward otto ivo tom peter".split()

#: Words of names, with the dot of an abbreviation; and all pieces of a text, which put together give it again.
NAME_WORD = r"\p{L}[\p{L}'\-]*\.?"
PIECES = r"\p{L}[\p{L}'\-]*\.?|[0-9]+|[^\p{L}0-9]+"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def bare(word: Column) -> Column:
    """A word in lower case without the dot at its end."""
    return F.lower(F.rtrim(word, F.lit(".")))


def quoted(text: Column) -> Column:
    """A pattern that matches the text itself where no letter or digit adjoins."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.regexp_replace(text, r"([^\p{L}\p{N} ])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}])"))


def syllables(hexdigits: Column, size: int | Column) -> Column:
    """A capitalised word of consonants and vowels in turn, one letter for each hex digit."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.lit(size) if isinstance(size, int) else size),
        lambda i: F.when(i % 2 == 1, F.translate(hexdigits.substr(i, F.lit(1)), "0123456789abcdef", "bcdfghjklmnprstv")).otherwise(
            F.translate(hexdigits.substr(i, F.lit(1)), "0123456789abcdef", "aeiouaeiouaeioua")
        ),
    )
    return F.initcap(F.array_join(pairs, ""))


def digits(hexdigits: Column, size: Column) -> Column:
    """So many digits, from as many hex digits; longer runs repeat them."""
    run = F.translate(hexdigits, "abcdef", "274953")
    return F.substring(F.repeat(run, F.ceil(size / 64).cast("int")), F.lit(1), size)


def contains(pool: list[str], word: Column) -> Column:
    return word.isin(*pool)
