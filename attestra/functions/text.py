"""Text cells.  A missing value is the empty string, never NULL, once a table is loaded."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a cell is trimmed of (Unicode white space).
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Trim white space.  A cell that starts and ends with a printable ASCII character, which nearly
    every cell does, is recognised by two comparisons and returned as it is."""
    bare = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(bare, c).otherwise(F.trim(c, F.lit(WHITESPACE)))


def cell(c: Column) -> Column:
    """A trimmed cell, NULL read as empty."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def filled(c: Column) -> Column:
    return cell(c) != ""


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a fixed table, NULL when the key is absent."""
    if not table:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def after_colon(c: Column, default: str) -> Column:
    """What follows the first colon, or ``default`` when there is none."""
    at = F.instr(c, ":")
    return F.when(at > 0, F.substring(c, at + F.lit(1), F.length(c))).otherwise(F.lit(default))


def ratio(n: Column, d: Column) -> Column:
    """n / d as DOUBLE; NULL for an empty denominator, never a zero."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def ratio_or_zero(n: Column, d: Column) -> Column:
    return F.coalesce(ratio(n, d), F.lit(0.0))
