"""Text functions: word tests, digit and address surrogates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed set of entity types.
ENTITY_TYPES = ("PATIENT", "INVESTIGATOR", "SITE", "LOCATION", "DATE", "AGE", "ID", "CONTACT")
GENERIC_ROLES = ("patient", "subject", "investigator", "principal investigator", "sub-investigator")
GENERIC_ORDINALS = ("first", "second", "third", "fourth", "fifth")


def is_entity_type(kind: Column) -> Column:
    return kind.isin(*ENTITY_TYPES)


def is_generic(text: Column) -> Column:
    """References such as 'the second patient' that name nobody."""
    named = [f"the {role}" for role in GENERIC_ROLES] + [f"the {nth} {role}" for nth in GENERIC_ORDINALS for role in GENERIC_ROLES]
    return F.lower(text).isin(*named)


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'\-]*"), F.lit(0)), F.lower)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def paragraph_index(text: Column, start: Column, mark: str = "\n\n") -> Column:
    """Paragraph breaks before a place (from 0)."""
    return F.size(F.split(F.substring(text, F.lit(1), start), mark)) - 1


def rotate_digits(text: Column, by: Column) -> Column:
    """Every digit moved by 1 to 9 places: same length, each digit another one."""
    k = F.lit(1) + by % 9
    turned = F.concat(*((F.lit(d) + k).cast("int") % 10 for d in range(10)))
    return F.call_function("translate", text, F.lit("0123456789"), turned)


def address_surrogate(text: Column, digest: Column) -> Column:
    """An e-mail address of the same length class at a reserved domain."""
    return F.concat(F.lit("u"), F.substring(digest, 1, 10), F.lit("@example.org"))
