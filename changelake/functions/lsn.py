"""Log positions: 64-bit integers, written as ``X/Y`` in hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 1 << 32

# Position columns in the order in which changes take effect.
ORDER = ("commit_lsn", "lsn", "seq")


def parse_lsn(text: Column | str) -> Column:
    """``'16/B374D848'`` as BIGINT; NULL for other text and for positions of 2^63 or more."""
    text = F.col(text) if isinstance(text, str) else text
    high = F.conv(F.substring_index(text, "/", 1), 16, 10).cast("bigint")
    low = F.conv(F.substring_index(text, "/", -1), 16, 10).cast("bigint")
    valid = text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")
    return F.when(valid, F.when(high < LOW // 2, high * LOW + low))


def format_lsn(lsn: Column | str) -> Column:
    lsn = F.col(lsn) if isinstance(lsn, str) else lsn
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"),
                    F.hex(lsn.bitwiseAND(F.lit(LOW - 1))))


def position(prefix: str = "") -> Column:
    """One comparable value per change: commit position first, then place in the log."""
    return F.struct(*[F.col(prefix + c) for c in ORDER])
