"""Digest expressions. Text forms are engine-neutral, so other engines can recompute them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# A fingerprint has 60 bits. It is summed in parts of 20, which keeps the sums in bigint for
# up to 2^43 rows per key; one decimal per row would cost as much as the hash itself.
PART = 20


def canonical_text(df: DataFrame, cols: Sequence[str]) -> Column:
    """Injective text of a row of ``df``: fields joined by ``|``, with a mark for null.

    Text fields carry their length, since they may contain ``|`` or look like the mark.
    """
    def field(name: str) -> Column:
        text = F.col(name).cast("string")
        if isinstance(df.schema[name].dataType, T.StringType):
            text = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        return F.coalesce(text, F.lit("N"))
    return F.concat_ws("|", *[field(c) for c in cols])


def row_hash(df: DataFrame, cols: Sequence[str]) -> Column:
    return F.sha2(canonical_text(df, cols), 256)


def fingerprint(df: DataFrame, cols: Sequence[str]) -> Column:
    """60-bit number of a row."""
    return F.conv(F.substring(F.md5(canonical_text(df, cols)), 1, 15), 16, 10).cast("long")


def sum_fingerprints(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Rows ``n`` and exact sum of fingerprints ``digest`` (decimal) per key."""
    mask = F.lit((1 << PART) - 1).cast("long")
    fp = F.col("_fp")
    sums = (df.select(key, fingerprint(df, cols).alias("_fp")).groupBy(key)
            .agg(F.count("*").alias("n"), F.sum(F.shiftright(fp, 2 * PART)).alias("_hi"),
                 F.sum(F.shiftright(fp, PART).bitwiseAND(mask)).alias("_mid"),
                 F.sum(fp.bitwiseAND(mask)).alias("_lo")))

    def times(name: str, power: int) -> Column:
        return F.col(name).cast("decimal(20,0)") * F.lit(1 << power).cast("decimal(13,0)")

    total = times("_hi", 2 * PART) + times("_mid", PART) + times("_lo", 0)
    return sums.select(key, "n", total.cast("decimal(38,0)").alias("digest"))
