"""Content digests as lower-case hex text."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions.columns import as_col
from treeline.schema import ALGORITHMS

# Hashing this long with Spark's fixed seed 42 yields 0, and each further argument is
# hashed with the result so far as seed: the next one gets the standard seed 0.
_SEED_ZERO = -365884300664092260


@F.pandas_udf(T.StringType())
def _blake2b_256(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else hashlib.blake2b(b, digest_size=32).hexdigest())


def _hex(number: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(number), digits, "0"))


def fast_hash(content: Column | str) -> Column:
    """Standard XXH64 as 16 hex digits, in the JVM."""
    return _hex(F.xxhash64(F.lit(_SEED_ZERO).cast("bigint"), as_col(content)), 16)


def digest(content: Column | str, algorithm: str) -> Column:
    """Digest of a string or binary column. Only blake2b leaves the JVM (Arrow batches);
    to group equal contents any native algorithm serves as well."""
    name = algorithm.lower()
    if name not in ALGORITHMS:
        raise ValueError(f"unsupported hash algorithm: {algorithm}")
    content = as_col(content)
    if name == "md5":
        return F.md5(content)
    if name == "sha1":
        return F.sha1(content)
    if name == "sha256":
        return F.sha2(content, 256)
    if name == "sha512":
        return F.sha2(content, 512)
    if name == "crc32":
        return _hex(F.crc32(content), 8)
    if name == "xxhash64":
        return fast_hash(content)
    return _blake2b_256(content.cast("binary"))
