"""Strict reading of predictions: any breach voids the whole output and nothing is repaired.

A contract is the set of a mention's keys with a test for each: `spans` places a mention by character offsets,
`anchors` by its text and the number of its occurrence.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from veilframe.functions.text import ENTITY_TYPES

_FIELDS = {"text": StringType(), "n": LongType(), "start": LongType(), "end": LongType(), "type": StringType(), "id": StringType()}
_MENTION = StructType()
for _name, _type in _FIELDS.items():
    _MENTION = _MENTION.add(_name, _type)
PARSED = StructType().add("mentions", ArrayType(_MENTION)).add("error", StringType())

Test = Callable[[object], str | None]


def _filled(value) -> str | None:
    return None if isinstance(value, str) and value else "empty_string"


def _known(value) -> str | None:
    return _filled(value) or (None if value in ENTITY_TYPES else "unknown_type")


def _counted(value) -> str | None:
    return None if type(value) is int and 1 <= value < 2**63 else "bad_count"


def _paired(value) -> str | None:
    whole = isinstance(value, list) and [type(x) for x in value] == [int, int]
    return None if whole and 0 <= value[0] < value[1] < 2**63 else "bad_span"


CONTRACTS: dict[str, dict[str, Test]] = {
    "anchors": {"text": _filled, "id": _filled, "n": _counted, "type": _known},
    "spans": {"span": _paired, "id": _filled, "type": _known},
}


def _pairs(items):
    keys = [k for k, _ in items]
    if len(set(keys)) < len(keys):
        raise ValueError("repeated_key")
    return dict(items)


def read(raw: str | None, contract: str, size: int | None = None) -> tuple[list[dict] | None, str | None]:
    """(mentions, None) or (None, reason) of {"mentions": [...]}; spans must end within size characters, if it is given."""
    if raw is None:
        return None, "no_output"
    try:
        whole = json.loads(raw, object_pairs_hook=_pairs)
    except (ValueError, RecursionError) as e:
        return None, "repeated_key" if str(e) == "repeated_key" else "not_json"
    mentions = whole.get("mentions") if isinstance(whole, dict) and len(whole) == 1 else None
    if not isinstance(mentions, list):
        return None, "wrong_shape"
    tests, out = CONTRACTS[contract], []
    for m in mentions:
        if not isinstance(m, dict) or m.keys() != tests.keys():
            return None, "wrong_keys"
        if faults := [fault for key, test in tests.items() if (fault := test(m[key]))]:
            return None, faults[0]
        if contract == "spans":
            m["start"], m["end"] = m.pop("span")
            if size is not None and m["end"] > size:
                return None, "bad_span"
        out.append({name: m.get(name) for name in _FIELDS})
    return out, None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["mentions", "error"])


@F.pandas_udf(PARSED)
def parse_anchored(raw: pd.Series) -> pd.DataFrame:
    return _frame([read(x, "anchors") for x in raw])


@F.pandas_udf(PARSED)
def _parse_spans(raw: pd.Series, size: pd.Series) -> pd.DataFrame:
    return _frame([read(x, "spans", None if pd.isna(n) else int(n)) for x, n in zip(raw, size, strict=True)])


def parse_spans(raw: Column, size: Column | None = None) -> Column:
    """struct(mentions, error); size: characters of the text that the spans lie in."""
    return _parse_spans(raw, F.lit(None).cast("long") if size is None else size.cast("long"))
