"""Canonical JSON, and the identities and checksums derived from it.

Floats must keep their Python form (1.0 stays 1.0), which Spark's JSON functions don't; so the
canonical bytes come from an Arrow-batched function over the raw text. Everything derived from the
bytes is built in.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def canonical(payload: object, allow_nan: bool = True) -> bytes:
    text = json.dumps(payload, separators=(",", ":"), sort_keys=True, ensure_ascii=False, allow_nan=allow_nan)
    return text.encode()


def record_id(raw: bytes) -> int:
    """An unsigned 64-bit number: the first eight bytes of the SHA-256, little end first."""
    return int.from_bytes(hashlib.sha256(raw).digest()[:8], "little")


def crc32(raw: bytes) -> int:
    return zlib.crc32(raw)


def _canonical_text(text: str | None) -> str | None:
    try:
        return None if text is None else canonical(json.loads(text)).decode()
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """Canonical text of JSON text; null for null and for what isn't JSON."""
    return raw.map(_canonical_text)


def record_id_of(canonical_text: Column) -> Column:
    """``record_id`` of canonical text as DECIMAL(20,0), which holds any unsigned 64-bit number."""
    digest = F.sha2(F.encode(canonical_text, "UTF-8"), 256)
    pairs = [F.substring(digest, 2 * k + 1, 2) for k in reversed(range(8))]
    return F.conv(F.concat(*pairs), 16, 10).cast("decimal(20,0)")


def crc32_of(canonical_text: Column) -> Column:
    return F.crc32(F.encode(canonical_text, "UTF-8"))


def _little(number: Column) -> Column:
    """Four bytes, little end first."""
    digits = F.lpad(F.hex(number.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]))


def batch_frame(payload: Column, kind: Column, trust: Column) -> Column:
    """A batch's record around its payload (text): id, kind, trust, length, CRC, payload; null for null."""
    raw = F.encode(payload, "UTF-8")
    # the id's bytes, little end first, are those of the digest as they stand
    return F.concat(F.unhex(F.substring(F.sha2(raw, 256), 1, 16)), _little(kind), _little(trust), _little(F.octet_length(raw)), _little(F.crc32(raw)), raw)
