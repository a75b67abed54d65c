import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import bytestrings as B
from lexiloom.functions import codec

TOKENS = [b"a1", b"ab ", b"1234", b"a b", b" a b", b"\x80A", b"\xc0\xaf", b"\xed\xa0\x80", b"\x80", b"a \n", b"a \n ", b"", b"\x80\xc3", b"\x80\x80\x80\x80", b"\x80\x80\x80A", b"\xbf\xff", b"1", b"12345a", b"  ", b"\x80\xe2\x82", b"\xf0\x9f\x98\x80", b"\x90\xf0\x9f"]


def lax(b: bytes) -> bool:
    i = 0
    while i < len(b):
        n = 1 if b[i] < 0x80 else 2 if 0xC0 <= b[i] < 0xE0 else 3 if 0xE0 <= b[i] < 0xF0 else 4 if 0xF0 <= b[i] < 0xF8 else 0
        if not n or i + n > len(b) or any(x & 0xC0 != 0x80 for x in b[i + 1 : i + n]):
            return False
        i += n
    return True


def tail(t: bytes) -> bool:
    i = 0
    while i < min(3, len(t)) and t[i] & 0xC0 == 0x80:
        i += 1
    return 0 < i < len(t) and any(lax(t[i:] + b"\x80" * k) for k in range(4))


def reason(t: bytes):
    digits = [48 <= b <= 57 for b in t]
    letter = lambda s: re.search(rb"[A-Za-z]", s)
    if any(digits) and not all(digits):
        return "digits_and_others"
    if len(t) > 1 and t.endswith(b" ") and letter(t[:-1]):
        return "letters_then_space"
    if sum(digits) > 3:
        return "over_three_digits"
    if len(t) > 1 and not t.startswith(b" ") and letter(t) and b" " in t:
        return "latin_with_inner_space"
    return "tail_of_a_character" if tail(t) else None


def test_filters_and_validity(spark):
    import random

    draw = random.Random(1)
    tokens = TOKENS + [bytes(draw.choice([0x80, 0x9F, 0xBF, 0xC3, 0xE2, 0xF0, 0xF8, 65, 32, 49]) for _ in range(draw.randint(1, 6))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in tokens], "token binary").select("token", B.filter_reason(F.col("token")).alias("r"), B.lax_utf8(F.col("token")).alias("v"))
    for row in df.collect():
        t = bytes(row["token"])
        assert row["r"] == reason(t), t
        assert row["v"] == lax(t), t


def test_printable(spark):
    df = spark.createDataFrame([(b"a'\xff ~\x7f",)], "t binary")
    assert tuple(df.select(B.printable(F.col("t")), B.printable(F.col("t"), True)).first()) == ("a'\\xff ~\\x7f", "a\\x27\\xFF ~\\x7F")


def test_utf8_or_null_and_bits(spark):
    df = spark.createDataFrame([(b"ok \xc3\xa9", 5), (b"\xc0\xaf", 0)], "t binary, m long")
    assert [(r[0], r[1]) for r in df.select(B.utf8_or_null(F.col("t")), B.bit_positions(F.col("m"))).collect()] == [("ok é", [0, 2]), (None, [])]


def test_overlap(spark):
    pairs = [(b"abc", b"bcd"), (b"abc", b"abc"), (b"aa", b"aa"), (b"a", b"a"), (b"ab", b"cd"), (b"", b"x")]
    df = spark.createDataFrame(pairs, "a binary, b binary").select(B.suffix_prefix_overlap(F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == [True, False, True, False, False, False]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_escape_round_trip(data):
    assert codec.unescape(codec.escape(data)) == data


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_valid_text_only_doubles_the_escape(text):
    own = chr(0xE000)
    assert codec.escape(text.encode()) == text.replace(own, own * 2)


def test_broken_escapes():
    import pytest

    for bad in (chr(0xE000), chr(0xE000) + "a", "x" + chr(0xE000) + chr(0xE101)):
        with pytest.raises(ValueError):
            codec.unescape(bad)


def test_byte_letters():
    letters = codec.byte_letters()
    assert len(set(letters)) == 256 and letters[65] == "A" and letters[32] == "Ġ" and letters[10] == "Ċ"
    assert codec.from_letters(codec.to_letters(bytes(range(256)))) == bytes(range(256))
    assert codec.from_letters("あ") == b"\xaa"
