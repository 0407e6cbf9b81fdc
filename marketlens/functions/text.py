"""Text expressions shared by question routing, follow-ups and explanations."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as blank, as ranges of code points. These are the
# Unicode white space characters and the four ASCII separators.
BLANKS = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)
BLANK_CHARACTERS = "".join(chr(c) for first, last in BLANKS for c in range(first, last + 1))
BLANK_RUN = "[" + "".join(f"\\u{first:04x}-\\u{last:04x}" for first, last in BLANKS) + "]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARACTERS))


def normalize(c: Column) -> Column:
    """Trimmed, lower case, blanks collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, BLANK_RUN, " ")))


def contains_any(c: Column, terms) -> Column:
    found = F.lit(False)
    for term in _shortest(terms):
        found = found | c.contains(term)
    return found


def bound(c: Column, expression) -> Column:
    """`expression(c)` with `c` computed once per row.

    A filter on a computed column is pushed down with the column's expression in place of its
    name; an expression that names a costly one many times would repeat it as often.
    """
    return F.get(F.transform(F.array(c), expression), F.lit(0))


def _shortest(terms):
    # A term that contains another term of the list can never decide the outcome.
    return [t for t in terms if not any(o != t and o in t for o in terms)]
