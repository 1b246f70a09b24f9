"""What the corpus operators share: words, and characters of a class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words; a word is a run of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = r"\x20\x09-\x0D"


def words(text: Column) -> Column:
    """Array of the words of a text, in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, as a long; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def chars_of(text: Column, which: str) -> Column:
    """How many characters of the text the class `which` (as within regex brackets) holds. translate() would build an object for each character."""
    return F.regexp_count(text, F.lit(f"[{which}]"))
