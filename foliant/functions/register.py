"""SQL access: the text functions as temporary SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliant.functions import grounding, nfc, ocrtext, script, typography


def _sql_functions() -> dict[str, tuple]:
    return {
        "repair_typography": (typography.repair_typography, "STRING"),
        "fix_caps_digraphs": (typography.fix_caps_digraphs, "STRING"),
        "detect_script": (script.detect_script, "STRING"),
        "to_latin": (script.to_latin, "STRING"),
        "is_garbled": (ocrtext.is_garbled, "BOOLEAN"),
        "fix_mixed_script_words": (ocrtext.fix_mixed_script_words, "STRING"),
        "normalise_apostrophes": (ocrtext.normalise_apostrophes, "STRING"),
        "split_for_grounding": (grounding.split_for_grounding, "ARRAY<STRING>"),
    }


# Spark prints operators as calls, ``<(a, b)``; quoted, the name is valid SQL.
_STRING_OR_OPERATOR = re.compile(r"('(?:[^'\\]|\\.)*')|(<=|>=|[<>=+\-*/!%]|\b(?:and|or))(?=\()")


def sql_text(function, argument: str) -> str:
    """The SQL form of a Column function applied to ``argument``, as Spark prints it."""
    printed = repr(function(F.col(argument)))[len("Column<'"):-len("'>")]
    return _STRING_OR_OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`", printed)


def register(spark: SparkSession) -> None:
    """Publish the functions for ``spark.sql``. ``nfc`` is a UDF; the others are SQL expressions."""
    spark.udf.register("nfc", nfc.nfc_udf)
    for name, (function, result) in _sql_functions().items():
        body = sql_text(function, "input_text")
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(input_text STRING) "
            f"RETURNS {result} RETURN {body}"
        )
    # Only text that NFC can change goes to Python, as in ``nfc.nfc``.
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION clean_text(input_text STRING) RETURNS STRING RETURN "
        "repair_typography(coalesce(nfc(CASE WHEN input_text RLIKE r'[" + nfc.MAY_CHANGE + "]' "
        "THEN input_text END), input_text))"
    )
