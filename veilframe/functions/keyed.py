"""Keyed hashes and draws as column expressions; every random choice derives from them."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The public key of the catalogue's queries; a secret one never becomes a plan literal (see scope_keys).
TEST_KEY = b"veilframe-public-test-key"


def _pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA256 (RFC 2104)."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_hex(message: Column, key: bytes = TEST_KEY) -> Column:
    """HMAC-SHA256 of a string column in hex, inside codegen; for public keys."""
    inner, outer = _pads(key)
    digest = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)


def scope_keys(secret: bytes):
    """An Arrow UDF scope -> hex key. The secret travels in the closure and shows in no plan."""
    @F.pandas_udf("string")
    def key(scope: pd.Series) -> pd.Series:
        return scope.map(lambda s: None if s is None else hmac.new(secret, str(s).encode(), "sha256").hexdigest())

    return key


def first_bits(hexdigest: Column) -> Column:
    """The digest's first 60 bits as a non-negative long."""
    return F.conv(F.substring(hexdigest, 1, 15), 16, 10).cast("long")


def shift_days(hexdigest: Column, low: int = 4, high: int = 52, direction: int = -1) -> Column:
    """A whole number of weeks in [low, high], as days."""
    return (F.lit(7 * direction) * (F.lit(low) + first_bits(hexdigest) % (high - low + 1))).cast("int")


def is_val(key: Column, share: int = 1000) -> Column:
    """True for `share` of 10,000 keys, by the first eight bytes of their SHA-256."""
    number = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % 10000).cast("int") < share
