"""Byte-level BPE as a streaming transducer with bounded lookahead, and decoding by an incremental state machine.

The encoder reads bytes and knows, for each prefix, the last token of that prefix's encoding: the one token that ends
there and may follow the encoding before it (two tokens may follow each other if merging their bytes gives just them).
So prefix encodings form a tree. A later token cannot begin further back than the longest token is long: that length,
taken from the merge list, is the sufficient lookahead. Tokens that the encodings of the last prefixes within it share
are final and are emitted; what is held never grows with the text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from chainevents.llm.common import in_pandas, narrow, query, table
from chainevents.llm.tokens import PartEncoder, slices


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file: itself where printable, else from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


class Merges:
    """A vocabulary and its merge list; decides which tokens may follow each other."""

    def __init__(self, vocabulary: dict[bytes, int], merges: Sequence[tuple[bytes, bytes]], remember: int = 500_000):
        self.ids = vocabulary
        self.ranks = {pair: k for k, pair in enumerate(merges)}
        made = {a + b for a, b in merges}
        self.lookahead = max(map(len, [*made, b"x"]))
        self.tokens = {t for t in [bytes([b]) for b in range(256)] + sorted(made) if t in vocabulary}
        self._may: dict[tuple[bytes, bytes], bool] = {}
        self._remember = remember
        self.tokens = {t for t in self.tokens if self.merged(t) == [t]}

    def merged(self, text: bytes) -> list[bytes]:
        """Lowest rank first, leftmost first: what the merge list means."""
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = self.ranks
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: ranks.get(p, 1 << 60))
            if best not in ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def may_follow(self, left: bytes, right: bytes) -> bool:
        known = self._may.get((left, right))
        if known is None:
            if len(self._may) >= self._remember:
                self._may.clear()
            known = self._may[left, right] = self.merged(left + right) == [left, right]
        return known


class Transducer:
    """``feed`` bytes of one word, take what is final; ``finish`` gives the rest. Holds ``2 * lookahead`` prefixes at most."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.recent = deque([(b"", None, 0)])  # last token of a prefix's encoding, the prefix before it, number of tokens
        self.tail = b""
        self.emitted = 0

    def feed(self, piece: bytes) -> Iterator[bytes]:
        tokens, may, most = self.merges.tokens, self.merges.may_follow, self.merges.lookahead
        for k in range(len(piece)):
            self.tail = self.tail[-most:] + piece[k : k + 1]
            for n in range(1, min(len(self.tail), len(self.recent)) + 1):
                token = self.tail[-n:]
                before = self.recent[-n]
                if token in tokens and before is not None and (before[1] is None and not before[0] or may(before[0], token)):
                    self.recent.append((token, before, before[2] + 1))
                    break
            else:
                self.recent.append(None)
            if len(self.recent) > 2 * most:
                yield from self._final(most)

    def _final(self, most: int) -> Iterator[bytes]:
        """Emit what the last ``most`` prefixes share, and forget older ones."""
        while len(self.recent) > most:
            self.recent.popleft()
        live = {id(x): x for x in self.recent if x is not None}
        while len(live) > 1:
            deepest = max(live.values(), key=lambda x: x[2])
            del live[id(deepest)]
            live[id(deepest[1])] = deepest[1]
        yield from self._since(next(iter(live.values())))

    def _since(self, node) -> Iterator[bytes]:
        chain = []
        while node[2] > self.emitted:
            chain.append(node[0])
            node = node[1]
        self.emitted += len(chain)
        yield from reversed(chain)

    def finish(self) -> Iterator[bytes]:
        if self.recent[-1] is not None:
            yield from self._since(self.recent[-1])


class StreamingEncoder(PartEncoder):
    """The cache of parts over the transducer instead of the library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], {c: b for b, c in byte_letters().items()}
        raw = lambda text: bytes(letters[c] for c in text)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = Merges({raw(t): i for t, i in model["vocab"].items() if t not in self.added}, [(raw(a), raw(b)) for a, b in pairs])
        self.texts = {i: t for t, i in self.merges.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        # fixed value: how the vocabulary splits texts into words
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")") if self.added else None
        self.special, self.spaces_kept, self.limit, self.longest, self.known, self.older, self.edges = list(self.added), True, 500_000, 48, {}, {}, None
        self.marks = dict(zip(".,", self._library([".", ","]), strict=True))
        pool = [self.texts.get(i, b"") for i in range(max(self.texts) + 1)]
        self.sizes = np.fromiter(map(len, pool), np.int64, len(pool))
        self.pool, self.starts = np.frombuffer(b"".join(pool), np.uint8), np.cumsum(self.sizes) - self.sizes

    def word(self, text: bytes) -> Iterator[bytes]:
        if text in self.merges.tokens:  # a token that merges to itself
            return iter((text,))
        return self._within(text) if len(text) <= self.merges.lookahead else self._stream(text)

    def _within(self, text: bytes) -> Iterator[bytes]:
        """A word no longer than the lookahead: the transducer's states in a list, as nothing is final before the end."""
        tokens, may, known = self.merges.tokens, self.merges.may_follow, self.merges._may
        last: list[bytes | None] = [b""]
        for i in range(1, len(text) + 1):
            for j in range(i - 1, -1, -1):
                token, before = text[j:i], last[j]
                if token in tokens and before is not None:
                    follows = not before or known.get((before, token))
                    if follows or follows is None and may(before, token):
                        last.append(token)
                        break
            else:
                last.append(None)
        chain, at = [], len(text)
        while at and last[at]:
            chain.append(last[at])
            at -= len(last[at])
        return reversed(chain)

    def _stream(self, text: bytes, step: int = 4096) -> Iterator[bytes]:
        machine = Transducer(self.merges)
        for k in range(0, len(text), step):
            yield from machine.feed(text[k : k + step])
        yield from machine.finish()

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a text, each as soon as it is final."""
        for piece in self.split_added.split(text) if self.split_added else [text]:
            if piece in self.added:
                yield self.added[piece]
            else:
                for found in self.words.finditer(piece):
                    yield from (self.merges.ids[t] for t in self.word(found.group().encode()))

    def _library(self, texts: Sequence[str]) -> list[bytes]:
        return [np.fromiter(self.stream(text), "<u4").tobytes() for text in texts]

    def decoded(self, ids: np.ndarray, step: int = 8192) -> Iterator[str]:
        """Text of a stream of ids: bytes that do not yet end a character wait for the ids that follow."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for k in range(0, len(ids), step):
            some = ids[k : k + step]
            each = self.sizes[some]
            ends = np.cumsum(each)
            yield machine.decode(self.pool[np.repeat(self.starts[some] - (ends - each), each) + np.arange(ends[-1])].tobytes())
        yield machine.decode(b"", True)


_encoders: dict[str, StreamingEncoder] = {}


def streaming_encoder(path: str) -> StreamingEncoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = StreamingEncoder(path)
    return _encoders[path]


def _digest(pieces: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of whole texts; null text counts as empty and has no ids, null ids and repeated rows stay as they are."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = streaming_encoder(vocabulary)
        for batch in batches:
            texts, names = batch["text"].tolist(), batch["id"].astype("Int64")
            for a, b in slices(texts):
                ids, bounds = machine.encode(texts[a:b])
                yield pd.DataFrame({"doc_id": names.iloc[a:b].to_numpy(object), "ids": np.split(ids.astype(np.int64), bounds[1:-1])})

    return in_pandas(narrow(docs, id_col, text_col), encode, "doc_id long, ids array<long>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = streaming_encoder(vocabulary)
        for batch in batches:
            yield batch.assign(text=["".join(machine.decoded(np.asarray(i, np.int64))) for i in batch["ids"]])[["doc_id", "text"]]

    return in_pandas(encoded, decode, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; ids and texts never leave the task."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = streaming_encoder(vocabulary)
        decimal = [str(i) for i in range(len(machine.sizes))]
        for batch in batches:
            texts, names = batch["text"].tolist(), batch["id"].astype("Int64")
            for a, b in slices(texts, 1 << 23):
                ids, bounds = machine.encode(texts[a:b])
                rows = [ids[bounds[k] : bounds[k + 1]] for k in range(b - a)]
                yield pd.DataFrame({
                    "doc_id": names.iloc[a:b].to_numpy(object),
                    "n_tokens": np.diff(bounds),
                    "ids_sha256": [_digest([",".join(map(decimal.__getitem__, r.tolist())).encode()]) for r in rows],
                    "decoded_sha256": [_digest(t.encode() for t in machine.decoded(r)) for r in rows],
                })

    return in_pandas(narrow(docs, id_col, text_col), digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query()
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
