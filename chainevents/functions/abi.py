"""Event ABI types: canonical text, checking, compiled layouts, and decoding of dynamic data for Arrow batches."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainevents.functions.keccak import checksum_addresses, keccak256_many
from chainevents.functions.words import PROGRAM

_ARRAY = re.compile(r"^(.+)\[(\d*)\]$", re.S)
_NUMBER = re.compile(r"^(uint|int|bytes)(\d+)$")
OVERRUN = "ABI decode error: buffer overrun while deserializing"


def canonical_type(kind: str, components: list) -> str:
    """Tuples expand to their components and keep any array suffix."""
    if kind != "tuple" and not kind.startswith("tuple["):
        return kind
    inner = ",".join(canonical_type(c["type"], c.get("components") or []) for c in components)
    return f"({inner}){kind[5:]}"


def _split(body: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(body[start:i])
            start = i + 1
    return parts + [body[start:]] if body else []


@lru_cache(maxsize=4096)
def parse_type(text: str) -> tuple:
    """Layout of a Solidity type, or ValueError."""
    array = _ARRAY.match(text)
    if array:
        return ("array", parse_type(array[1]), int(array[2]) if array[2] else None)
    inner = text[5:] if text.startswith("tuple(") else text
    if inner.startswith("(") and inner.endswith(")"):
        return ("tuple", tuple(parse_type(p.strip()) for p in _split(inner[1:-1])))
    if text in ("address", "bool", "string", "bytes", "function"):
        return (text,)
    if text in ("uint", "int"):
        return (text,)
    sized = _NUMBER.match(text)
    if sized:
        n = int(sized[2])
        if sized[1] == "bytes" and 1 <= n <= 32:
            return ("word",)
        if sized[1] != "bytes" and n % 8 == 0 and 8 <= n <= 256:
            return (sized[1],)
    raise ValueError(f"unknown type: {text}")


def _dynamic(t: tuple) -> bool:
    if t[0] == "array":
        return t[2] is None or _dynamic(t[1])
    return t[0] in ("string", "bytes") or (t[0] == "tuple" and any(map(_dynamic, t[1])))


def _head(t: tuple) -> int:
    if _dynamic(t):
        return 32
    if t[0] == "array":
        return t[2] * _head(t[1])
    return sum(map(_head, t[1])) if t[0] == "tuple" else 32


def _word(data: bytes, at: int) -> bytes:
    if at + 32 > len(data):
        raise ValueError(OVERRUN)
    return data[at : at + 32]


def _sequence(types, data: bytes, base: int) -> list:
    out, at = [], base
    for t in types:
        if _dynamic(t):
            out.append(_value(t, data, base + int.from_bytes(_word(data, at), "big")))
            at += 32
        else:
            out.append(_value(t, data, at))
            at += _head(t)
    return out


def _value(t: tuple, data: bytes, at: int):
    """One value by the ABI layout; addresses stay 20-byte strings until they are named."""
    kind = t[0]
    if kind == "tuple":
        return _sequence(t[1], data, at)
    if kind == "array":
        count = t[2]
        if count is None:
            count = int.from_bytes(_word(data, at), "big")
            at += 32
            if count * max(_head(t[1]), 1) > len(data) - at:
                raise ValueError(OVERRUN)
        return _sequence([t[1]] * count, data, at)
    word = _word(data, at)
    if kind in ("string", "bytes"):
        size = int.from_bytes(word, "big")
        if size > len(data) - at - 32:
            raise ValueError(OVERRUN)
        body = data[at + 32 : at + 32 + size]
        return body.decode("utf-8", "replace") if kind == "string" else "0x" + body.hex()
    if kind == "address":
        return word[12:]
    if kind == "bool":
        return any(word)
    if kind == "function":
        return "[unknown]"
    if kind == "word":
        return "0x" + word.hex()
    return str(int.from_bytes(word, "big", signed=kind == "int"))


def _json(value, names: dict[bytes, str]) -> str:
    if isinstance(value, bytes):
        return f'"{names[value]}"'
    if isinstance(value, list):
        return "[" + ",".join(_json(v, names) for v in value) + "]"
    return json.dumps(value, ensure_ascii=False)


def _found_addresses(value, found: set[bytes]) -> None:
    if isinstance(value, bytes):
        found.add(value)
    elif isinstance(value, list):
        for item in value:
            _found_addresses(item, found)


def _static_column(kind: str, words: np.ndarray) -> list:
    """One 32-byte word per row to values of a static type, column-wise."""
    if kind == "address":
        flat = words[:, 12:].tobytes()
        return [flat[i : i + 20] for i in range(0, len(flat), 20)]
    if kind == "bool":
        return words.any(axis=1).tolist()
    if kind == "word":
        digits = words.tobytes().hex()
        return ["0x" + digits[i : i + 64] for i in range(0, len(digits), 64)]
    small = ~words[:, :24].any(axis=1)
    texts = list(map(str, np.ascontiguousarray(words[:, 24:]).view(">u8")[:, 0].tolist()))
    for i in np.flatnonzero(~small):
        texts[i] = str(int.from_bytes(words[i].tobytes(), "big", signed=kind == "int"))
    return texts


_STATIC = ("address", "bool", "word", "uint", "int")
#: Words of a static array or tuple that a program may name one by one; larger ones are decoded in Arrow batches.
_WORDS = 64


def _decode_alike(types: list[tuple], places: list[int], raws: list[bytes]) -> tuple[list[list], list[str | None]]:
    """Values per field and errors per row, for rows that share one layout and hold all of its head."""
    errors: list[str | None] = [None] * len(raws)
    columns = []
    for t, at in zip(types, places):
        if t[0] in _STATIC:
            words = np.frombuffer(b"".join(r[at : at + 32] for r in raws), dtype=np.uint8)
            columns.append(_static_column(t[0], words.reshape(len(raws), 32)))
            continue
        column = []
        for i, raw in enumerate(raws):
            value = None
            if errors[i] is None:
                try:
                    start = int.from_bytes(raw[at : at + 32], "big") if _dynamic(t) else at
                    value = _value(t, raw, start)
                except (ValueError, OverflowError, RecursionError) as err:
                    errors[i] = str(err)
            column.append(value)
        columns.append(column)
    return columns, errors


def _texts(column: list, kind: str, names: dict[bytes, str]) -> list[str]:
    if kind == "address":
        return [f'"{names[v]}"' for v in column]
    if kind == "bool":
        return ["true" if v else "false" for v in column]
    if kind in ("word", "uint", "int"):
        return [f'"{v}"' for v in column]
    return [_json(v, names) for v in column]


def _plain(t: tuple) -> bool:
    """Whether column expressions can render the type: static, of few words, and without addresses, which need a hash."""
    if t[0] == "array":
        return t[2] is not None and t[2] * max(1, _head(t[1]) // 32) <= _WORDS and _plain(t[1])
    if t[0] == "tuple":
        return _head(t) // 32 <= _WORDS and all(map(_plain, t[1]))
    return t[0] in ("bool", "word", "uint", "int", "function")


def _pieces(t: tuple, at: int, text: str) -> tuple[list[tuple[str, str, int]], str]:
    """Pieces of a value whose words begin at ``at``, behind ``text``, and the text that is left for the next piece."""
    if t[0] not in ("array", "tuple"):
        return [(text, t[0], at)], ""
    parts, text = [], text + "["
    for k, inner in enumerate([t[1]] * t[2] if t[0] == "array" else t[1]):
        own, text = _pieces(inner, at, text + "," if k else text)
        parts, at = parts + own, at + _head(inner)
    return parts, text + "]"


def compile_layout(fields: list[list[str]]) -> dict:
    """``size`` of the head, ``program`` of the JSON members, and ``others``: [type, place] of what needs Arrow."""
    types = [parse_type(kind) for _, kind in fields]
    places, size = [], 0
    for t in types:
        places.append(size)
        size += _head(t)
    if size >= 1 << 31:  # longer than any data can be: every row ends in an overrun
        return {"size": min(size, (1 << 63) - 1), "program": [("", "text", 0)], "others": None}
    last = {name: at for at, (name, _) in enumerate(fields)}  # of equal names the last wins
    program, others, text = [], [], ""
    for at in sorted(last.values()):
        key = text + ("," if program else "") + json.dumps(fields[at][0], ensure_ascii=False) + ":"
        if _plain(types[at]):
            own, text = _pieces(types[at], places[at], key)
        else:
            own, text = [(key, "other", len(others))], ""
            others.append([fields[at][1], places[at]])
        program += own
    # Fields that a later one of the same name hides must be sound as well.
    hidden = [[fields[at][1], places[at]] for at in range(len(fields)) if at not in last.values() and _dynamic(types[at])]
    if text:
        program.append((text, "text", 0))
    return {"size": size, "program": program, "others": json.dumps(others + hidden) if others or hidden else None}


_COMPILED = T.StructType().add("size", T.LongType()).add("program", PROGRAM).add("others", T.StringType())


@F.pandas_udf(_COMPILED)
def compiled_layout(layout: pd.Series) -> pd.DataFrame:
    """What decoding needs of a JSON list of [name, type]; nulls where it names an unknown type. For registry-sized tables."""
    rows = []
    for text in layout:
        try:
            rows.append(compile_layout(json.loads(text)))
        except (ValueError, TypeError):
            rows.append({"size": None, "program": None, "others": None})
    frame = pd.DataFrame(rows, columns=["size", "program", "others"])
    frame["size"] = frame["size"].astype("Int64")
    frame["program"] = [None if p is None else [{"text": t, "kind": k, "at": at} for t, k, at in p] for p in frame["program"]]
    return frame


#: Checksummed texts of addresses that a Python worker has met lately, and how many it keeps.
_NAMES: dict[bytes, str] = {}
_KEPT_NAMES = 1 << 17


def _named(found: set[bytes]) -> dict[bytes, str]:
    """Texts of these addresses; logs name the same ones again and again, so they are hashed once per worker."""
    missing = [a for a in found if a not in _NAMES]
    if len(_NAMES) + len(missing) > _KEPT_NAMES:
        _NAMES.clear()
        missing = list(found)
    _NAMES.update(zip(missing, checksum_addresses(missing)))
    return {a: _NAMES[a] for a in found}


@F.pandas_udf(T.StructType().add("values", T.ArrayType(T.StringType())).add("error", T.StringType()))
def decode_others(others: pd.Series, data: pd.Series) -> pd.DataFrame:
    """JSON texts of the fields of ``others`` ([type, place] each), or why they cannot be read.

    Rows of one event share them, so a batch is decoded field by field. The data holds the whole head.
    """
    values: list[list[str] | None] = [None] * len(data)
    errors: list[str | None] = [None] * len(data)
    wanted = others.notna()
    for text, rows in data[wanted].groupby(others[wanted]):
        fields = json.loads(text)
        types = [parse_type(kind) for kind, _ in fields]
        columns, faults = _decode_alike(types, [place for _, place in fields], rows.tolist())
        found: set[bytes] = set()
        for t, column in zip(types, columns):
            found.update(column) if t[0] == "address" else None if t[0] in _STATIC else _found_addresses(column, found)
        names = _named(found)
        texts = [_texts(column, t[0], names) for t, column in zip(types, columns)]
        for i, fault, parts in zip(rows.index, faults, zip(*texts)):
            errors[i] = fault
            values[i] = None if fault else list(parts)
    return pd.DataFrame({"values": values, "error": errors})


@F.pandas_udf(T.StringType())
def layout_error(layout: pd.Series) -> pd.Series:
    """Why a list of non-indexed [name, type] pairs cannot be decoded, or NULL."""

    def check(text):
        try:
            for _, kind in json.loads(text):
                parse_type(kind)
        except ValueError as err:
            return str(err)

    return layout.map(check)


@F.pandas_udf(T.StringType())
def canonical_types(inputs: pd.Series) -> pd.Series:
    """Comma-joined canonical types of a JSON list of {type, components}."""

    def join(text):
        return ",".join(canonical_type(i["type"], json.loads(i.get("components") or "[]")) for i in json.loads(text))

    return inputs.map(join, na_action="ignore")


@F.pandas_udf(T.StringType())
def keccak_text(text: pd.Series) -> pd.Series:
    """``0x`` Keccak-256 of UTF-8 text."""
    return pd.Series(["0x" + d.hex() for d in keccak256_many([t.encode() for t in text])])


@F.pandas_udf(T.StringType())
def keccak_hex(values: pd.Series) -> pd.Series:
    """Unprefixed Keccak-256 hex of binary values."""
    return pd.Series([d.hex() for d in keccak256_many([bytes(v) for v in values])])


@F.pandas_udf(T.StringType())
def checksum_address(raw: pd.Series) -> pd.Series:
    """Mixed-case text of 20-byte addresses; used on registry-sized tables only."""
    return pd.Series(checksum_addresses([bytes(v) for v in raw]))
