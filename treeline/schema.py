"""The schema of stored results, and names that settings may have."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_TEXT_MAP = T.MapType(_S, _S)

# Field names of errors and results.
OPERATION_ERROR = _struct(file=_S, operation=_S, error=_S, timestamp=_TS, recoverable=_B)

OPERATION_RESULT = _struct(
    id=_S, operation_type=_S, status=_S, start_time=_TS, end_time=_TS, duration=_L,
    items_processed=_L, bytes_processed=_L, files_affected=T.ArrayType(_S), summary=_S,
    details=_TEXT_MAP, errors=T.ArrayType(OPERATION_ERROR), warnings=T.ArrayType(_S),
)

# Digest names, digest names allowed in the settings file, log levels.
ALGORITHMS = ("md5", "sha1", "sha256", "sha512", "blake2b", "xxhash64", "crc32")
SETTINGS_ALGORITHMS = ("blake2b", "sha256", "xxhash64", "crc32")
LOG_LEVELS = ("debug", "info", "warn", "error", "fatal")
