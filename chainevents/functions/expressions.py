"""Scalar column expressions on stored text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "0123456789abcdef"
# Hex digits that have bit 0, 1, 2 or 3 set.
NIBBLES_WITH_BIT = ("13579bdf", "2367abef", "4567cdef", "89abcdef")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_quantity(number: Column | str) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(number)))


def hex_text(raw: Column | str) -> Column:
    """Binary to unprefixed lower-case hex."""
    return F.lower(F.hex(raw))


def prefixed_hex(raw: Column | str) -> Column:
    return F.concat(F.lit("0x"), hex_text(raw))


def is_hex_bytes(text: Column | str) -> Column:
    """True for an even number of hex digits, with or without ``0x``."""
    text = _col(text)
    return (F.length(text) % 2 == 0) & text.rlike(r"\A(0x)?[0-9a-fA-F]*\z")


def bytes_or_null(text: Column | str) -> Column:
    """Hex text, with or without ``0x``, to binary; malformed text gives NULL."""
    return F.when(is_hex_bytes(text), F.unhex(F.regexp_replace(_col(text), "^0x", "")))


def _parsed_topics(text: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(text))
    parsed = F.from_json(text, "array<string>")
    return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(parsed, lambda t: t.isNotNull()), parsed)


def topics_array(text: Column | str) -> Column:
    """Topics text to an array; NULL unless it is a JSON array of strings.

    Text in the stored form is split directly; anything else goes through the JSON parser.
    """
    text = _col(text)
    plain = text.rlike(r'\A\["[0-9a-zA-Z]*"(,"[0-9a-zA-Z]*"){0,15}\]\z')
    return F.when(plain, F.split(F.substring(text, F.lit(3), F.length(text) - 4), '","')).otherwise(_parsed_topics(text))


def topics_text(topics: Column | str) -> Column:
    return F.to_json(_col(topics))


def decoded_json(text: Column | str) -> Column:
    """Parsed value; SQL NULL on malformed text, a variant null for a stored ``null``."""
    return F.try_parse_json(_col(text))


def decoded_field(text: Column | str, field: str) -> Column:
    """One field as text, so that 256-bit numbers keep every digit."""
    return F.get_json_object(_col(text), f"$.{field}")


def has_decode_error(text: Column | str) -> Column:
    return F.coalesce(decoded_field(text, "_decode_error").isNotNull(), F.lit(False))


def json_string(text: Column | str) -> Column:
    """Quoted and escaped JSON form of a text column; plain words need no JSON writer."""
    text = _col(text)
    whole = F.to_json(F.struct(text.alias("s")))
    escaped = F.substring(whole, F.lit(6), F.length(whole) - 6)
    return F.when(text.rlike(r"\A[0-9A-Za-z_$]*\z"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(escaped)


def reason_text(reason: Column | str, gap_from: Column | str, gap_to: Column | str) -> Column:
    """Operator-facing text of an incomplete reason."""
    reason = _col(reason)
    return (
        F.when(reason == "PreparationFailed", "ABI resolution failure")
        .when(reason == "SourceFailure", "archive source read failure")
        .when(reason == "VerifyFailure", "receipt verification failure")
        .when(reason == "DecodeFailure", "event decode failure")
        .when(reason == "StoreFailure", "event storage failure")
        .when(reason == "CoverageWriteFailed", "coverage record failure")
        .when(
            reason == "NoSourceData",
            F.format_string("no backing source data for blocks %d-%d", _col(gap_from), _col(gap_to)),
        )
    )


# --- Bloom bits ------------------------------------------------------------------


def bloom_bit(digest_hex: Column | str, which: int) -> Column:
    """Bit 0, 1 or 2 (of 2048) that a value with this hex digest sets."""
    nibble = lambda at: F.instr(F.lit(_DIGITS), F.substring(_col(digest_hex), at, 1)) - 1
    first = 4 * which + 2  # the low eleven bits of the pair of bytes
    return nibble(first) % 8 * 256 + nibble(first + 1) * 16 + nibble(first + 2)


def bloom_digit(bit: Column) -> Column:
    """1-based position, in the 512 hex digits of a Bloom, of the digit holding ``bit``."""
    return F.lit(512) - F.call_function("div", bit, F.lit(4)).cast("int")


def bloom_digit_set(bit: Column) -> Column:
    """The hex digits that have ``bit`` set."""
    return F.element_at(F.array(*[F.lit(s) for s in NIBBLES_WITH_BIT]), bit % 4 + 1)
