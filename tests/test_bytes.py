"""Fixed vectors of the byte helpers."""

import os

import pytest

from chainevents.functions import rlp
from chainevents.functions.abi import _decode_alike, _value, canonical_type, parse_type
from chainevents.functions.frames import crc32c_many, frame_many, unframe_many
from chainevents.functions.keccak import checksum_addresses, keccak256_many
from chainevents.operators.blocks import receipt_roots


def test_keccak_vectors_in_one_batch():
    out = keccak256_many([b"Transfer(address,address,uint256)", b"", b"a" * 1000])
    assert out[0].hex() == "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert out[1].hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert out[2] == keccak256_many([b"a" * 1000])[0]


def test_swap_topic():
    swap = b"Swap(address,address,int256,int256,uint160,uint128,int24)"
    assert keccak256_many([swap])[0].hex() == "c42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67"


@pytest.mark.parametrize("size", [0, 1, 135, 136, 137, 271, 272, 5000])
def test_keccak_does_not_depend_on_the_batch(size):
    items = [os.urandom(size), os.urandom(3), os.urandom(300)] * 200
    assert keccak256_many(items)[0] == keccak256_many(items[:1])[0]


def test_checksummed_addresses():
    texts = [
        "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed",
        "0xfB6916095ca1df60bB79Ce92cE3Ea74c37c5d359",
        "0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48",
    ]
    assert checksum_addresses([bytes.fromhex(t[2:]) for t in texts]) == texts


def test_crc32c_vectors():
    assert [hex(x) for x in crc32c_many([b"123456789", bytes(32), b"\xff" * 32, b""])] == ["0xe3069283", "0x8a9136aa", "0x62a8ab43", "0x0"]


def test_frames_round_trip_and_detect_damage():
    plains = [b"", b"abc", os.urandom(200_000), b"z" * 65536]
    framed = frame_many(plains)
    assert unframe_many(framed) == plains
    broken = framed[2][:50] + bytes([framed[2][50] ^ 1]) + framed[2][51:]
    got = unframe_many([framed[1], broken, framed[2][:-3], b"garbage", framed[3] + b"\xfe\x02\x00\x00hi", framed[3] + b"\x02\x00\x00\x00"])
    assert got[0] == b"abc" and got[4] == plains[3]
    assert [isinstance(g, ValueError) for g in got] == [False, True, True, True, False, True]


def test_rlp_vectors():
    assert rlp.wrap(b"dog") == b"\x83dog" and rlp.wrap_number(0) == b"\x80" and rlp.wrap_number(1024) == b"\x82\x04\x00"
    long = rlp.wrap(b"x" * 56)
    assert long[:2] == b"\xb8\x38" and rlp.head(long, 0, len(long)) == (False, 2, 58)
    for bad in (b"\x81\x05", b"\xb8\x01x", b"\x83do", b"\xb9\x00\x38" + b"x" * 56):
        with pytest.raises(ValueError):
            rlp.head(bad, 0, len(bad))


def test_receipt_roots():
    assert receipt_roots([[]])[0].hex() == "56e81f171bcc55a6ff8345e692c0f86e5b48e01b996cadc001622fb5e363b421"
    # One leaf: the root is the digest of [compact path of 0x80, value].
    value = b"v" * 40
    leaf = rlp.wrap(rlp.wrap(bytes.fromhex("208080")[:1] + b"\x80") + rlp.wrap(value), True)
    assert receipt_roots([[value]])[0] == keccak256_many([leaf])[0]


def _slow_root(values):
    """Plain recursive trie over RLP(index) keys, to check the level-wise one."""
    items = {tuple(n for b in rlp.wrap_number(i) for n in (b >> 4, b & 15)): v for i, v in enumerate(values)}

    def compact(path, leaf):
        digits = [2 * leaf + len(path) % 2, *([] if len(path) % 2 else [0]), *path]
        return bytes(digits[i] * 16 + digits[i + 1] for i in range(0, len(digits), 2))

    def node(entries):
        if len(entries) == 1:
            (path, value), = entries.items()
            return rlp.wrap(rlp.wrap(compact(path, True)) + rlp.wrap(value), True)
        shared = 0
        while len({p[shared] for p in entries}) == 1:
            shared += 1
        if shared:
            first = next(iter(entries))
            return rlp.wrap(rlp.wrap(compact(first[:shared], False)) + ref(node({p[shared:]: v for p, v in entries.items()})), True)
        slots = [{p[1:]: v for p, v in entries.items() if p[0] == n} for n in range(16)]
        return rlp.wrap(b"".join(ref(node(s)) if s else b"\x80" for s in slots) + b"\x80", True)

    def ref(raw):
        return raw if len(raw) < 32 else b"\xa0" + keccak256_many([raw])[0]

    return keccak256_many([node(items)])[0]


@pytest.mark.parametrize("count", [1, 2, 3, 16, 17, 127, 128, 129, 130, 200, 300])
def test_level_wise_root_equals_recursive_root(count):
    values = [bytes([i % 251]) * (1 + i % 60) for i in range(count)]
    assert receipt_roots([values, values[:1]])[0] == _slow_root(values)


def test_canonical_types():
    two = [{"type": "address"}, {"type": "uint256"}]
    assert canonical_type("tuple", two) == "(address,uint256)"
    assert canonical_type("tuple[3]", [{"type": "uint128"}]) == "(uint128)[3]"
    nested = [{"type": "tuple", "components": [{"type": "bool"}]}, {"type": "address"}]
    assert canonical_type("tuple[]", nested) == "((bool),address)[]"


@pytest.mark.parametrize("kind", ["notatype", "uint7", "uint264", "bytes33", "tuple", "tuple[]", "address[x]"])
def test_unknown_types_are_refused(kind):
    with pytest.raises(ValueError):
        parse_type(kind)


def test_values():
    w = lambda n: (n % (1 << 256)).to_bytes(32, "big")
    assert _value(parse_type("uint256"), w(-1), 0) == str((1 << 256) - 1)
    assert _value(parse_type("int24"), w(-5), 0) == "-5"
    assert _value(parse_type("bytes4"), b"\x01\x02\x03\x04" + bytes(28), 0) == "0x01020304" + "00" * 28
    assert _value(parse_type("uint8[2]"), w(1) + w(2), 0) == ["1", "2"]
    assert _value(parse_type("(bool,string)"), w(1) + w(64) + w(2) + b"hi".ljust(32, b"\0"), 0) == [True, "hi"]
    columns, errors = _decode_alike([parse_type("uint256"), parse_type("int64[]")], [0, 32], [w(7) + w(64) + w(1) + w(-2), w(1) + w(64) + w(9), w(1 << 200) + w(64) + w(0)])
    assert columns[0] == ["7", "1", str(1 << 200)] and columns[1] == [["-2"], None, []]
    assert errors[0] is None and errors[1] and errors[2] is None
