"""Identifiers: ULIDs and digests."""

from __future__ import annotations

import hashlib
import secrets
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import BadRequest

# fixed value: the base-32 alphabet of ULIDs
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
PATTERN = f"^[0-7][{ALPHABET}{ALPHABET[10:].lower()}]{{25}}$"


def new_ulid() -> str:
    """48 bits of milliseconds, then 80 random bits."""
    n = (time.time_ns() // 1_000_000 & (1 << 48) - 1) << 80 | secrets.randbits(80)
    return "".join(ALPHABET[n >> s & 31] for s in range(125, -1, -5))


def parse_ulid(text: str) -> str:
    up = text.upper()
    if len(up) != 26 or up[0] not in ALPHABET[:8] or any(c not in ALPHABET for c in up):
        raise BadRequest(f"Invalid ID {text}, expected ULID")
    return up


def is_ulid(col: Column) -> Column:
    return col.rlike(PATTERN)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def sha256_column(col: Column) -> Column:
    return F.sha2(col, 256)
