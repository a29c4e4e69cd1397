"""Column functions on strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_all(text: Column, separator: str) -> Column:
    """Parts between separators, empty ones too."""
    return F.split(text, re.escape(separator))


def split_nonempty(text: Column, separator: str) -> Column:
    """Parts between separators that are not blank."""
    return F.filter(split_all(text, separator), lambda x: F.trim(x) != "")


def to_int(text: Column) -> Column:
    """32-bit integer, null if the text is none."""
    return text.try_cast("int")


def to_long(text: Column) -> Column:
    return text.try_cast("bigint")
