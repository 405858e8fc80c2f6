"""Text encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashes import _col


def b64url_encode(c: Column | str) -> Column:
    """URL-safe base64 of a binary or string column, without padding."""
    return F.translate(F.base64(_col(c).cast("binary")), "+/=\r\n", "-_")


def b64url_decode(c: Column | str) -> Column:
    """Bytes of URL-safe base64 with or without padding; null when malformed."""
    plain = F.rtrim(_col(c), F.lit("="))
    standard = F.translate(plain, "-_", "+/")
    missing = F.pmod(-F.length(plain), F.lit(4))
    whole = F.concat(standard, F.substring(F.lit("=="), F.lit(1), missing))
    well_formed = plain.rlike("^[A-Za-z0-9_-]*$") & (missing != 3)
    return F.when(well_formed, F.unbase64(whole))


def parse_hex_lenient(c: Column | str) -> Column:
    """Bytes of hex text: blanks trimmed, 0x dropped, odd lengths padded."""
    trimmed = F.regexp_replace(_col(c), r"^\s+|\s+$", "")
    bare = F.regexp_replace(trimmed, "^0[xX]", "")
    even = F.when(F.length(bare) % 2 == 1, F.concat(F.lit("0"), bare)).otherwise(bare)
    pairs = even.rlike(r"^(\s*[0-9a-fA-F]{2})*\s*$")
    return F.when(pairs, F.unhex(F.regexp_replace(even, r"\s", "")))


def iso_utc(c: Column | str) -> Column:
    """ISO time with six fraction digits; the session time zone must be UTC."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def uuid_text(digest: Column | str) -> Column:
    """First 32 hex digits in the shape of a UUID."""
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(_col(digest), at, n) for at, n in cuts])


def account_hash16(c: Column | str) -> Column:
    return F.substring(F.sha2(_col(c).cast("binary"), 256), 1, 16)
