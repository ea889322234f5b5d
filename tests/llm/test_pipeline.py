"""The pipeline's stages one by one against plain versions, each judged on its own input."""

import public_tokenizers
import pytest
from cases import awkward_rows, crc, documents, plain_components, plain_repeats
from pyspark.sql import Row
from tokenizers import Tokenizer

import corpus_pipeline
from chainevents.llm import toxicity
from chainevents.llm.common import QUERIES, Scratch, prepare, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark):
    """What each stage left, by its name; ``documents`` is the input."""
    prepare(spark)
    scratch = Scratch(spark, "stages")
    out = {"documents": table(spark, SF, "documents")}
    docs = out["documents"]
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = scratch.write(stage(spark, docs, SF), name)
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_have_the_columns_of_documents(written):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    for name in names[:-1]:
        assert written[name].columns == written["documents"].columns


def test_toxic_documents_go(spark, written):
    prepare(spark)
    scored = toxicity.toxicity(written["documents"], table(spark, SF, "labels"), Scratch(spark, "again"))
    toxic = {r.doc_id for r in scored.where("toxic").collect()}
    known = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    before, after = texts(written["documents"]), texts(written["toxicity"])
    assert toxic and set(before) - set(after) == toxic
    assert sum(known[i] == (i in toxic) for i in known if i in before) >= 0.95 * sum(i in before for i in known)
    assert not any(i in toxic and not known[i] for i in known)


def test_copies_go(written):
    before, after = texts(written["toxicity"]), texts(written["exact_dedup"])
    last = {t or "": i for i, t in sorted(before.items())}
    assert after == {i: before[i] for i in last.values()}


def test_near_copies_go(written):
    before, after = texts(written["exact_dedup"]), texts(written["ngram_jaccard_join"])
    assert after == {i: before[i] for i, _, c in plain_components(sorted(before.items()), 5, 80) if i == c}


def test_repeats_are_cut(written):
    before, after = texts(written["ngram_jaccard_join"]), texts(written["suffix_array_dedup"])
    rows = sorted(before.items())
    want = {i: bytes(b for b, m in zip(raw, mark, strict=True) if not m).decode("utf-8", "ignore") for (i, _), (raw, mark) in zip(rows, plain_repeats(rows), strict=True)}
    assert after == want and after != before
    assert all(r.n_chars == len(r.text) for r in written["suffix_array_dedup"].collect())


def test_what_is_left_is_packed(written):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = written["best_fit_packing"].collect()
    for i, text in texts(written["suffix_array_dedup"]).items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert [(s, n, crc(ids[s : s + n])) for s, n, _ in own] == own and sum(n for _, n, _ in own) == len(ids)
    assert len({r.sequence_id for r in rows}) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_awkward_documents_pass_all_stages(spark):
    docs = documents(spark, clashes=True)
    scratch = Scratch(spark, "awkward")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.write(stage(spark, docs, SF), f"stage-{k}")
    ids = {r.doc_id for r in docs.collect()}
    # Row 3 has a null text as rows 4 and the nameless one have, and of such copies the largest id stays: row 4's.
    assert {2, 4, 6, 8, 15} <= ids | {2} and 3 not in ids and len(ids) < len(awkward_rows())


def test_empty_documents_pass_all_stages(spark):
    docs = documents(spark, [])
    scratch = Scratch(spark, "empty")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.write(stage(spark, docs, SF), f"stage-{k}")
    assert docs.count() == 0


def test_registered_queries():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert "pipeline" in corpus_pipeline.REGISTERED


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    from check_oracles import compare, duck

    assert compare(duck(SF), spark, SF, *QUERIES[name]) is None


def test_rows_keep_ties(spark):
    """Rows that repeat an id and a text are one document for exact dedup, whatever else they hold."""
    rows = [Row(doc_id=1, text="same", lang="a", source="", n_chars=4), Row(doc_id=1, text="same", lang="b", source="", n_chars=4)]
    from chainevents.llm.exact_dedup import exact_dedup

    assert exact_dedup(documents(spark, rows), Scratch(spark, "ties")).count() == 1
