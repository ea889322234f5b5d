"""32-byte ABI words to JSON text, in column expressions.

A layout is compiled once, where the registry is built, into a *program*: pieces of text, most of them followed by one
word of the data. Any number of layouts then shares one expression that walks through a row's program.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces of a program: literal text, then what follows it and where.
PROGRAM = T.ArrayType(T.StructType().add("text", T.StringType()).add("kind", T.StringType()).add("at", T.IntegerType()))
_ZEROS, _ONES = "0" * 48, "f" * 48
#: Digits of one limb, and powers of its base in nine-digit pieces, smallest first: what a limb adds to each piece.
_DIGITS, _PIECES = 7, 9
_POWERS = [[(1 << 4 * _DIGITS * i) // 10 ** (9 * j) % 10**9 for j in range(_PIECES)] for i in range(-(-64 // _DIGITS))]


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once: a lambda variable is not inlined."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _limbs(word: Column) -> Column:
    """Ten limbs of 28 bits, smallest first; the last has four."""
    starts = [max(64 - _DIGITS * (i + 1), 0) for i in range(len(_POWERS))]
    return F.array(*[F.conv(F.substring(word, s + 1, min(_DIGITS, 64 - _DIGITS * i)), 16, 10).cast("long") for i, s in enumerate(starts)])


def _large(word: Column, minus: Column) -> Column:
    """Decimal text of 256 bits: limbs times powers, summed per nine-digit piece, then carried; no sum passes 63 bits.

    A negative number's bits are turned and one is added.
    """

    def pieces(limbs: Column) -> Column:
        sums = []
        for j in range(_PIECES):
            terms = [F.get(limbs, F.lit(i)) * F.lit(power[j]) for i, power in enumerate(_POWERS) if power[j]]
            sums.append(sum(terms[1:], terms[0]))
        return F.array(*sums)

    def text(given: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("text"))
        last = lambda s, x: F.struct(
            F.call_function("div", s["carry"] + x, F.lit(10**9)).alias("carry"), F.concat(F.lpad(((s["carry"] + x) % 10**9).cast("string"), 9, "0"), s["text"]).alias("text")
        )
        return F.regexp_replace(F.aggregate(given, none, last)["text"], "^0+(?!$)", "")

    def turned(limbs: Column) -> Column:
        full = F.array(*[F.lit((1 << 4 * min(_DIGITS, 64 - _DIGITS * i)) - 1).cast("long") for i in range(len(_POWERS))])
        return F.zip_with(full, limbs, lambda f, x: f - x)

    one = F.array(*[F.lit(int(j == 0)).cast("long") for j in range(_PIECES)])
    plain = lambda limbs: text(pieces(limbs))
    negative = lambda limbs: F.concat(F.lit("-"), text(F.zip_with(pieces(limbs), one, lambda p, o: p + o)))
    return F.when(minus, _bound(turned(_limbs(word)), negative)).otherwise(_bound(_limbs(word), plain))


def decimal_text(word: Column, signed: Column) -> Column:
    """The number that 64 lower-case hex digits stand for; almost all fit 64 bits and take the short way."""
    head, tail, minus = F.substring(word, 1, 48), F.substring(word, 49, 16), signed & (F.substring(word, 1, 1) >= "8")
    return (
        F.when(head == _ZEROS, F.conv(tail, 16, 10))
        .when(minus & (head == _ONES) & (F.substring(word, 49, 1) >= "8"), F.conv(tail, 16, -10))
        .otherwise(_large(word, minus))
    )


def rendered(program: Column, data: Column, others: Column) -> Column:
    """The text of a program over binary ``data``; a piece of kind ``other`` takes the element of ``others`` at its place."""

    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))

    def value(p: Column, word: Column) -> Column:
        return (
            F.when(p["kind"] == "bool", F.when(word == "0" * 64, "false").otherwise("true"))
            .when(p["kind"] == "word", quoted(F.concat(F.lit("0x"), word)))
            .otherwise(quoted(decimal_text(word, p["kind"] == "int")))
        )

    def piece(p: Column) -> Column:
        word = F.lower(F.hex(F.substring(data, p["at"] + 1, F.lit(32))))
        wordless = (
            F.when(p["kind"] == "text", F.lit(""))
            .when(p["kind"] == "other", F.get(others, p["at"]))
            .when(p["kind"] == "function", F.lit('"[unknown]"'))
            .otherwise(_bound(word, lambda w: value(p, w)))
        )
        return F.concat(p["text"], wordless)

    return F.array_join(F.transform(program, piece), "")
