"""Contract keys: canonical JSON, idempotency keys, validity, retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(kinds: T.StructType | None = None, **fields: Column) -> Column:
    """Compact JSON with sorted keys at every level; nulls are kept, and a number that isn't finite is an error.

    ``kinds`` has the fields' types where they are nested or may not be finite.
    """
    kind = {f.name: f.dataType for f in kinds.fields} if kinds else {}
    return F.to_json(F.struct(*(_sorted(fields[k], kind.get(k)).alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def _sorted(column: Column, kind: T.DataType | None) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(_sorted(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(column, lambda _, v: _sorted(v, kind.valueType)))))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        finite = ~F.isnan(column) & (F.abs(column) != float("inf"))
        return F.when(column.isNull() | finite, column).otherwise(F.raise_error(F.lit("a number is not finite")).cast(kind))
    return column


def idempotency_key(name: Column, version: Column, payload: Column, config_version: Column, rerun: Column | None = None) -> Column:
    """name:version: and the digest of the configuration's version, the input and the stage; a rerun adds its nonce's digest, an empty nonce nothing."""
    say = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    preimage = F.concat(F.lit('{"configuration_version":'), say(config_version), F.lit(',"input":'), payload, F.lit(',"stage":{"name":'), say(name), F.lit(',"version":'), say(version), F.lit("}}"))
    key = F.concat(name, F.lit(":"), version, F.lit(":"), F.sha2(preimage, 256))
    forced = F.when(F.coalesce(rerun, F.lit("")) != "", F.concat(F.lit(":force:"), F.sha2(rerun, 256))).otherwise("") if rerun is not None else F.lit("")
    return F.concat(key, forced)


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[a-z][a-z0-9_]*$"), F.lit(False))


def valid_digest(digest: Column) -> Column:
    return F.coalesce(digest.rlike(r"^[0-9a-f]{64}$"), F.lit(False))


def retry_delay(attempt: Column, base_ms: int, max_ms: int) -> Column:
    """Doubling from the base, up to the limit."""
    return F.least(F.lit(max_ms), F.lit(base_ms) * F.pow(F.lit(2.0), F.least(attempt, F.lit(40)) - 1)).cast("long")


def jittered(delay: Column, key: Column) -> Column:
    """Full jitter that a key determines."""
    return F.floor(delay * (F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1_000_000.0)).cast("long")
