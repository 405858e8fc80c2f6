"""Keyed digests. Keys are driver constants that enter the plan as pad literals.

Pad literals show up in explain() and in event logs; set
`spark.sql.redaction.string.regex` where plans are shared.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import KEY_NAMESPACE
from .hashes import _col

_SHA_BLOCK = 64


def derive_subkey(
    master: bytes, purpose: str, size: int = 32, namespace: str = KEY_NAMESPACE
) -> bytes:
    """Sub-key for one purpose; counter-stretched beyond one digest."""
    if len(master) < 16:
        raise ValueError("master key must be at least 16 bytes")
    if not purpose:
        raise ValueError("purpose must not be empty")
    info = (namespace + purpose).encode()
    blocks = -(-size // 32)
    suffixes = [b""] + [n.to_bytes(4, "big") for n in range(1, blocks)]
    stream = b"".join(
        hmac.new(master, info + s, hashlib.sha256).digest() for s in suffixes
    )
    return stream[:size]


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a string or binary column as 64 hex digits."""
    if len(key) > _SHA_BLOCK:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(_SHA_BLOCK, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in padded))
    outer = F.lit(bytes(b ^ 0x5C for b in padded))
    first = F.sha2(F.concat(inner, message.cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def payload_hex(
    account: Column | str,
    timestamp: Column | str,
    device: Column | str,
    master: bytes,
    namespace: str = KEY_NAMESPACE,
) -> Column:
    """128-bit provenance payload of (account, microseconds, device)."""
    # fixed value: the purpose that payload keys are derived for
    key = derive_subkey(master, "watermark/payload/v1", namespace=namespace)
    micros = F.unix_micros(_col(timestamp).cast("timestamp"))
    # concat_ws leaves nulls out, which would let two different rows agree
    parts = (_col(account), micros.cast("string"), _col(device))
    message = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.substring(hmac_sha256(message, key), 1, 32)


def account_public_key(
    account: Column | str, master: bytes, namespace: str = KEY_NAMESPACE
) -> Column:
    """Stable identifier for accounts that bring no key of their own."""
    info = F.concat(F.lit(namespace + "account_pubkey/v1/"), _col(account))
    return F.concat(F.lit("04"), hmac_sha256(info, master))
