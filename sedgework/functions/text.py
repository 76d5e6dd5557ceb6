"""Spellings of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PREDICATE = "child"


def one_spelling(predicate: Column) -> Column:
    """A predicate without outer blanks and leading colon, in lower case; null and empty stand for the default.

    Blanks are any white space of ASCII; they may also stand between the colon and the name.
    """
    bare = F.regexp_replace(F.lower(predicate), r"^\s*:?\s*|\s+$", "")
    return F.coalesce(F.when(bare != "", bare), F.lit(DEFAULT_PREDICATE))
