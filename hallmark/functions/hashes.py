"""64-bit hash arithmetic on hex strings and bigints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..settings import HASHES, MATCH_THRESHOLDS

HEX_PATTERN = "^[0-9a-fA-F]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_hex(c: Column | str) -> Column:
    return _col(c).rlike(HEX_PATTERN)


def hex_to_i64(c: Column | str) -> Column:
    """Up to 16 hex digits as a signed bigint, all 64 bits kept; null for longer text."""
    text = _col(c)
    return F.when(F.length(text) <= 16, F.conv(text, 16, -10).cast("bigint"))


def i64_to_hex(c: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(_col(c))), 16, "0")


def bits_to_hex(bits: Column) -> Column:
    """Array of 64 booleans, most significant first, as 16 hex digits."""
    word = F.aggregate(
        bits,
        F.lit(0).cast("bigint"),
        lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("bigint")),
    )
    return i64_to_hex(word)


def hamming64(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def hamming_hex(a: Column | str, b: Column | str) -> Column:
    """Bits that differ between two hex strings of any even length.

    Strings of unequal length are as far apart as can be: four bits for each
    digit of the longer one. Text that is no whole number of hex bytes gives
    null, where a single-row caller would get an error.
    """
    a, b = _col(a), _col(b)
    size = F.length(a)
    pieces = F.sequence(F.lit(0), F.ceil(size / 16).cast("int") - 1)
    total = F.aggregate(
        F.when(size > 0, pieces).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda acc, i: acc
        + hamming64(
            hex_to_i64(F.substring(a, i * 16 + 1, F.lit(16))),
            hex_to_i64(F.substring(b, i * 16 + 1, F.lit(16))),
        ),
    )
    usable = a.rlike("^([0-9a-fA-F]{2})*$") & b.rlike("^([0-9a-fA-F]{2})*$")
    return F.when(
        size != F.length(b), F.greatest(size, F.length(b)) * 4
    ).when(usable, total)


def hash_distances(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """Struct of the four distances between two hash bundles of bigints."""
    return F.struct(*[hamming64(a[h], b[h]).alias(h) for h in HASHES])


def within_threshold(
    distances: Column, thresholds: Mapping[str, int] | None = None
) -> Column:
    """True when any one of the four distances is within its own tolerance."""
    limits = dict(MATCH_THRESHOLDS, **(thresholds or {}))
    hit = F.lit(False)
    for h in HASHES:
        hit = hit | (distances[h] <= F.lit(limits[h]))
    return hit


def trigrams(c: Column | str) -> Column:
    """Distinct 3-grams of the lower-cased word, padded with two blanks and one."""
    padded = F.concat(F.lit("  "), F.lower(_col(c)), F.lit(" "))
    starts = F.sequence(F.lit(1), F.length(padded) - 2)
    return F.array_distinct(
        F.transform(starts, lambda i: F.substring(padded, i, F.lit(3)))
    )


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    ta, tb = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))


def register_sql_functions(spark: SparkSession) -> None:
    """Make `hamming_hex(a, b)` callable from SQL text."""
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION hamming_hex(a STRING, b STRING)
        RETURNS INT RETURN CASE
          WHEN length(a) <> length(b) THEN greatest(length(a), length(b)) * 4
          WHEN a = '' THEN 0
          WHEN a RLIKE '^([0-9a-fA-F]{2})+$' AND b RLIKE '^([0-9a-fA-F]{2})+$' THEN
            aggregate(sequence(0, cast(ceil(length(a) / 16) AS INT) - 1), 0, (acc, i) ->
              acc + bit_count(cast(conv(substr(a, i * 16 + 1, 16), 16, -10) AS BIGINT)
                            ^ cast(conv(substr(b, i * 16 + 1, 16), 16, -10) AS BIGINT)))
        END
        """
    )
