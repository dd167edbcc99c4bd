"""Words of a text, in two readings: the corpus operators' and the profile panel's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Maximal runs of letters and digits; separators of the panel's words.
RUNS = r"[\p{L}\p{Nd}]+"
SEPARATORS = r"""[\s,.;:!?'"()\[\]{}\-/\\]+"""


def runs(text: Column) -> Column:
    """The runs of Unicode letters and digits of the lower-cased text, in order; null and empty give an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RUNS), F.lit(0))
