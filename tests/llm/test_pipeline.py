"""The pipeline stage by stage against plain recomputation, and what it takes without crashing."""

import random
import zlib
from collections import Counter

import pytest
from test_operators import near_classes, prose

import corpus_pipeline
from merchlake.llm import mixing, secrets
from merchlake.llm.tokens import WordTokenizer, tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    kinds = {"en": "the and ing tion of er".split(), "fr": "le éa aux ment que ou".split()}
    words = {k: ["".join(rng.choices(v, k=rng.randrange(1, 5))) for _ in range(1500)] for k, v in kinds.items()}
    rows = [(i, prose(rng, rng.randrange(5, 400), words[k]), k, rng.choice("abc")) for i, k in enumerate(rng.choices(list(kinds), k=150))]
    rows += [(200 + i, rows[i][1], rows[i][2], "a") for i in range(20)]  # copies
    rows += [(300 + i, rows[i][1] + " end", rows[i][2], "b") for i in range(20)]  # near copies
    rows += [(400, rows[3][1] + " token=abcdefghijklmnop", "en", None), (401, None, "en", "a"), (402, "", None, "a"), (403, "1 2 3", "en", "a"), (500, rows[5][1], "en", "a"), (500, rows[5][1], "en", "a")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x") for r in rows], SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder).cache()
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["language_id"]
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {401, 402, 403}
    before, after = seen["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(near_classes(rows).values()))
    before, after = seen["secrets"]
    redacted = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        assert redacted[r.doc_id].text == secrets.redacted(r.text) and redacted[r.doc_id].n_chars == len(redacted[r.doc_id].text)
    before, after = seen["mixing"]
    passes = {r.doc_id: len(r.positions) for r in mixing.assign(before.withColumn("size", mixing.words())).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({k: n for k, n in passes.items() if n})
    before, after = seen["packing"]
    encoder = WordTokenizer(tokenizer_path()).encoder
    assert sum(r.length for r in after.collect()) == sum(len(encoder.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())


def test_run(spark, folder):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert a == b and a and zlib.crc32(repr(a).encode())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
