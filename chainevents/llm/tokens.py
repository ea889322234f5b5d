"""Token ids of whole texts, by the tokenizers library with a bounded cache of the texts' parts.

Both vocabularies split a text into words before they merge, so ids of parts that begin at such a split can be joined.
A part is what stands between spaces; for the byte-level vocabulary a space before a visible character belongs to the
part that follows, and a full stop or comma after a letter is a word of its own. Texts that spell a special token, and
those with other runs of white space, go to the library whole or cut by pattern. A batch is split and numbered by
Arrow, so Python touches each different part of a batch once.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?= \S)")


def _letters(text: str) -> bool:
    """Whether a text is letters alone, also composed and in lower case, as the vocabularies see it."""
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


@lru_cache(1)
def uneven_letters() -> str:
    """Letters that become more than letters (some sixty): a mark in them takes a following full stop into its word."""
    return "".join(c for c in map(chr, range(0x80, 0x30000)) if c.isalpha() and not _letters(c))


class PartEncoder:
    """``encode(texts)`` gives the ids of all texts in one array, and the bounds of each text's ids in it."""

    def __init__(self, path: str, spaces_kept: bool, limit: int = 250_000, longest: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaces_kept, self.limit, self.longest, self.known, self.older = spaces_kept, limit, longest, {}, {}
        self.marks = dict(zip(".,", self._library([".", ","]), strict=True))
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.edges = np.array([t.startswith("\u0120") if spaces_kept else t.endswith("</w>") for t in names])

    def _words(self, parts: Sequence[str], most: int = 256) -> list[bytes]:
        """Ids of parts. Those that are one word with a space in front, or letters only, are encoded side by side: just their
        first ids begin with a space, or just their last ids end a word."""
        if self.edges is None:
            return self._library(parts)
        if self.spaces_kept:
            side = [k for k, p in enumerate(parts) if p[:1] == " " and p.count(" ") == 1 and len(p) > 1 and not p[1].isspace() and not p[-1].isspace()]
        else:
            side = [k for k, p in enumerate(parts) if _letters(p)]
        found: list[bytes | None] = [None] * len(parts)
        texts = [("" if self.spaces_kept else " ").join(parts[k] for k in side[i : i + most]) for i in range(0, len(side), most)]
        every = b"".join(self._library(texts))
        edge = self.edges[np.frombuffer(every, "<u4")]
        at = (np.flatnonzero(edge) * 4).tolist() if self.spaces_kept else [0, *((np.flatnonzero(edge) + 1) * 4).tolist()][:-1]
        for k, a, b in zip(side, at, [*at[1:], len(every)][: len(at)], strict=True):
            found[k] = every[a:b]
        rest = [k for k, x in enumerate(found) if x is None]
        for k, ids in zip(rest, self._library([parts[k] for k in rest]), strict=True):
            found[k] = ids
        return found

    def _library(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _ids(self, parts: Sequence[str]) -> list[bytes]:
        """Of different parts; those worth it are kept for later batches."""
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = list(map(known.get, parts))
        missing = []
        for k in [k for k, x in enumerate(found) if x is None]:
            part = parts[k]
            found[k] = older.get(part)
            if found[k] is None:
                missing.append(k)
            else:
                known[part] = found[k]
        new = [parts[k] for k in missing]
        for k, part, ids in zip(missing, new, self._words(new), strict=True):
            found[k] = ids
            if len(part) <= self.longest:
                known[part] = ids
        return found

    def _pool(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different parts one behind the other, with starts and sizes. A mark after a letter is a word of its own."""
        marked = pc.match_substring_regex(parts, rf"[^\PL{uneven_letters()}][.,]$")
        heads = pc.if_else(marked, pc.utf8_slice_codeunits(parts, 0, -1), parts).dictionary_encode()
        pieces = self._ids(heads.dictionary.to_pylist())
        at, extra = heads.indices.to_numpy(), marked.to_numpy(zero_copy_only=False).astype(np.int32)
        lengths = np.fromiter(map(len, pieces), np.int32, len(pieces)) >> 2
        own, begin = lengths[at], (np.cumsum(lengths) - lengths)[at]
        sizes = own + extra
        starts = np.cumsum(sizes) - sizes
        pool = np.zeros(int(sizes.sum()), "<u4")
        inside = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        pool[np.repeat(starts, own) + inside] = np.frombuffer(b"".join(pieces), "<u4")[np.repeat(begin, own) + inside]
        dot = pc.ends_with(parts, ".").to_numpy(zero_copy_only=False)
        last = np.flatnonzero(extra)
        pool[starts[last] + own[last]] = np.where(dot[last], *(np.frombuffer(self.marks[m], "<u4")[0] for m in ".,"))
        return pool, starts.astype(np.int32), sizes.astype(np.int32)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        whole: dict[int, bytes] = {}
        plain = list(texts)
        for i, text in enumerate(plain):
            if any(s in text for s in self.special):
                whole[i], plain[i] = self._library([text])[0], ""
            elif self.spaces_kept and ("  " in text or " \n" in text or text[-1:] == " " or not text.isprintable() and re.search(r" \s", text)):
                whole[i], plain[i] = b"".join(self._ids(_CUT.split(text))), ""
        column = pa.array(plain, pa.large_string())
        if not self.spaces_kept:
            column = pc.replace_substring(column, "\n", " ")
        split = pc.split_pattern(column, " ")
        bounds = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        at, different = coded.indices.to_numpy().astype(np.int32), coded.dictionary
        if self.spaces_kept:  # a text's first part has no space before it
            firsts = at[bounds[:-1]]
            used, place = np.unique(firsts, return_inverse=True)
            at[bounds[:-1]] = len(different) + place
            none, space = pa.scalar("", different.type), pa.scalar(" ", different.type)
            different = pa.concat_arrays([pc.binary_join_element_wise(none, different, space), different.take(pa.array(used))])
        pool, starts, sizes = self._pool(different)
        each = sizes[at]
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        ids = pool[np.repeat((starts[at] - ends[:-1]).astype(np.int32), each) + np.arange(ends[-1], dtype=np.int32)]
        ends = ends[bounds]
        if not whole:
            return ids, ends
        rows = [np.frombuffer(whole[i], "<u4") if i in whole else ids[ends[i] : ends[i + 1]] for i in range(len(plain))]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


_encoders: dict[str, PartEncoder] = {}


def encoder(path: str, spaces_kept: bool, limit: int = 250_000) -> PartEncoder:
    """One for each worker process and vocabulary; ``limit`` bounds the parts it keeps from now on."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(path, spaces_kept)
    _encoders[path].limit = limit
    return _encoders[path]


def slices(texts: Sequence[str], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``most`` characters, so that what is in hand stays bounded."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
