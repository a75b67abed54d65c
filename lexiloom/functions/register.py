"""SQL names of the codecs and of the matcher."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.matching import Dictionary
from .codec import bytes_udf, escape_udf, letters_udf, unescape_udf


def register(spark: SparkSession, dictionary: Dictionary | None = None) -> None:
    """byte_letters, letter_bytes, escape_bytes, unescape_bytes; with a dictionary also the table function
    ``token_matches(data, past_end)`` -> (start, end, token_id), for a handful of texts in SQL."""
    for name, f in (("byte_letters", letters_udf), ("letter_bytes", bytes_udf), ("escape_bytes", escape_udf), ("unescape_bytes", unescape_udf)):
        spark.udf.register(name, f)
    if dictionary is None:
        return

    class TokenMatches:
        def eval(self, data, past_end):
            import numpy as np

            raw = bytes(data or b"")
            for s, e, t in zip(*(x.tolist() for x in dictionary.find(np.frombuffer(raw, np.uint8))), strict=True):
                yield s, e, t
            if past_end:
                yield from dictionary.past_end(raw)

    spark.udtf.register("token_matches", udtf(TokenMatches, returnType="start int, end int, token_id int"))
