"""Large ids beside null ones, and letters whose lower case is more than letters."""

import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from cases import documents, prose
from pyspark.sql import Row
from tokenizers import Tokenizer

from chainevents.llm import bpe, html_text, packing, quality, token_files, tokens, toxicity
from chainevents.llm.common import Scratch
from chainevents.llm.tokens import PartEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LARGE = (1 << 53) + 1


def read_back(spark, docs):
    path = Scratch(spark, "ids").folder
    token_files.write_token_files(docs, path, WORDS, 49408)
    return token_files.token_file_report(spark, path)


@pytest.mark.parametrize(
    "run",
    [
        lambda s, d: packing.packed_documents(d, Scratch(s, "ids"), 64),
        lambda s, d: quality.quality(d, s.createDataFrame([], "doc_id long, quality int, toxic int"), Scratch(s, "ids")),
        lambda s, d: bpe.round_trip(d, BYTES),
        lambda s, d: bpe.decode_documents(bpe.encode_documents(d, BYTES), BYTES),
        read_back,
        lambda s, d: toxicity.toxicity(d, s.createDataFrame([], "doc_id long, quality int, toxic int"), Scratch(s, "ids")),
        lambda s, d: html_text.extract(d.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")).withColumnRenamed("page_id", "doc_id"),
    ],
    ids=["packing", "quality", "round_trip", "decode", "token_files", "toxicity", "html"],
)
def test_large_ids_beside_nulls(spark, run):
    rows = [Row(doc_id=i, text=prose(k, 12), lang="", source="", n_chars=0) for k, i in enumerate([LARGE, None, LARGE + 1, -LARGE, 0])]
    got = {r.doc_id for r in run(spark, documents(spark, rows).coalesce(1)).collect()}
    assert got == {LARGE, None, LARGE + 1, -LARGE, 0}


def test_letters_that_become_more_than_letters():
    every = map(chr, range(sys.maxunicode + 1))
    letters = lambda t: all(unicodedata.category(x)[0] == "L" for x in t)
    uneven = [c for c in every if letters(c) and not letters(unicodedata.normalize("NFC", c).lower())]
    assert "".join(uneven) == tokens.uneven_letters() and "İ" in uneven


@pytest.mark.parametrize("path, kept", [(WORDS, False), (BYTES, True)])
def test_marks_behind_letters_equal_the_library(path, kept):
    letters = [c for c in map(chr, range(0x80, 0x1FFFF)) if c.isalpha() and (c.lower() != c or unicodedata.decomposition(c))] + ["İ"]
    texts = [f"{a}{m}{tail}" for a in letters for m in ".," for tail in ("", " Melih geldi")] + ["İstanbul. İ, xİ. İ.İ"]
    ids, bounds = PartEncoder(path, kept).encode(texts)
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, a, b, w in zip(texts, bounds, bounds[1:], want) if not np.array_equal(ids[a:b], w.ids)]
    assert wrong == []
