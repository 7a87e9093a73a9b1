"""Unicode NFC. Spark has no built-in for it, so this is the one vectorised UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import is_ascii

# Text without any of these characters is already in NFC: all but what lies below the combining
# marks, Cyrillic without its own marks, and general punctuation without the quads, which change.
# A joiner or a space of fixed width neither changes nor combines.
MAY_CHANGE = r"\u0300-\u03ff\u0483-\u0489\u0500-\u2001\u205f-\ufefe\uff00-\x{10ffff}"


@F.pandas_udf(T.StringType())
def nfc_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """NFC form of ``c``. Only text that can change is sent to Python; the rest goes as NULL."""
    # Bytes are counted first: the pattern, whose first range settles most letters, is for the others.
    changes = ~is_ascii(c) & c.rlike(rf"[\u0300-\x{{10ffff}}&&[{MAY_CHANGE}]]")
    return F.coalesce(nfc_udf(F.when(changes, c)), c)
