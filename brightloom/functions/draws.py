"""Reproducible draws from hashes: the same on every run, in any engine with SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_number(*parts: Column) -> Column:
    """The first 48 bits of the SHA-256 of the parts, joined by '|'."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 12), 16, 10).cast("long")


def hash_index(n: Column, *parts: Column) -> Column:
    """A draw from 0 .. n - 1."""
    return F.pmod(hash_number(*parts), n)


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    """prefix-<hex>: the beginning of the SHA-256 of the parts, joined by the unit separator."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, length))


def stable_seed(*parts: Column) -> Column:
    """The first 64 bits of that digest, modulo 2**31 - 1."""
    digest = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(2147483647).cast("decimal(20,0)")).cast("long")
