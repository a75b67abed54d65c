"""Column functions on byte strings. Bytes are BINARY; regular expressions see their latin-1 view, one character a byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(text) -> Column:
    return F.encode(text, "utf-8")


def latin1(data) -> Column:
    """One character for each byte; loses nothing."""
    return F.decode(data, "ISO-8859-1")


def hex_bytes(data) -> Column:
    """Array of the two-digit codes of the bytes."""
    return F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))


# ---- predicates of candidate tokens


def has_digits_and_others(token) -> Column:
    t = latin1(token)
    return t.rlike("[0-9]") & t.rlike("[^0-9]")


def letters_then_final_space(token) -> Column:
    """At least two bytes, the last a space, an ASCII letter before it (``\\z``: the very end)."""
    return latin1(token).rlike(r"(?s)[A-Za-z].* \z")


def over_three_digits(token) -> Column:
    return F.length(F.regexp_replace(latin1(token), "[^0-9]", "")) > 3


def latin_with_inner_space(token) -> Column:
    t = latin1(token)
    return ~t.startswith(" ") & t.rlike("[A-Za-z]") & t.contains(" ") & (F.length(token) >= 2)


#: Lax UTF-8: lead and continuation bits only; overlong forms, surrogates and values past U+10FFFF pass.
_LAX = r"(?:[\x00-\x7f]|[\xc0-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3})"
#: What one to three bytes 0x80 would complete.
_OPEN = r"(?:[\xc0-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf7][\x80-\xbf]{0,2})"


def lax_utf8(data) -> Column:
    return latin1(data).rlike(rf"\A{_LAX}*+\z")


def tail_of_a_character(token) -> Column:
    """One to three leading continuation bytes, then at least one byte that is lax UTF-8 or begins it."""
    return latin1(token).rlike(rf"(?s)\A(?:[\x80-\xbf]{{3}}|[\x80-\xbf]{{1,2}}(?![\x80-\xbf]))(?=.){_LAX}*+{_OPEN}?\z")


FILTERS = (
    ("digits_and_others", has_digits_and_others),
    ("letters_then_space", letters_then_final_space),
    ("over_three_digits", over_three_digits),
    ("latin_with_inner_space", latin_with_inner_space),
    ("tail_of_a_character", tail_of_a_character),
)


def filter_reason(token) -> Column:
    """The first filter that a token meets, or null: it is kept."""
    out = F.lit(None).cast("string")
    for name, test in reversed(FILTERS):
        out = F.when(test(token), name).otherwise(out)
    return out


# ---- rendering and case


def printable(data, upper: bool = False) -> Column:
    """ASCII 32 to 126 as it is, other bytes as ``\\xNN``; upper: capital digits, and the apostrophe escaped too."""
    plain = r"[ -&(-~]" if upper else "[ -~]"
    pairs = hex_bytes(data)

    def show(h):
        c = F.decode(F.unhex(h), "ISO-8859-1")
        return F.when(c.rlike(rf"\A{plain}\z"), c).otherwise(F.concat(F.lit("\\x"), h if upper else F.lower(h)))

    return F.array_join(F.transform(pairs, show), "")


def ascii_upper(text) -> Column:
    """Capital ASCII letters; every other character stays."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def utf8_or_null(data) -> Column:
    """The text of strictly valid UTF-8, else null."""
    return F.try_validate_utf8(data.cast("string"))


def suffix_prefix_overlap(a, b) -> Column:
    """Some proper suffix of ``a`` is a prefix of ``b``, both shorter than their whole (binary columns)."""
    la = latin1(a)
    lb = latin1(b)
    n = F.least(F.length(la), F.length(lb)) - 1
    return F.when(n < 1, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(la, F.length(la) - k + 1, k) == F.substring(lb, F.lit(1), k)))


def packed_index(gram) -> Column:
    """Bytes of up to seven as one big-endian number."""
    return F.conv(F.hex(gram), 16, 10).cast("bigint")


def bit_positions(mask) -> Column:
    """Places of the set bits of a whole number, from 0."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.getbit(mask.cast("bigint"), k) == 1)
