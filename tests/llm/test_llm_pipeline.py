"""The corpus pipeline: each stage on its own input, whole and in order."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from contentlake.llm.pseudonyms import luhn_digit
from tests.llm.test_llm_operators import base_counts, brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "jaccard_join", "pseudonyms", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_filters_keep_whole_rows(stages):
    for before, after in zip(stages[:3], stages[1:4], strict=True):
        a, b = Counter(map(tuple, before.collect())), Counter(map(tuple, after.collect()))
        assert b and not b - a
    for r in stages[2].collect():
        c = base_counts(r["text"])
        assert c["n_words"] >= 10 and 100 * c["n_repeat_words"] <= 20 * c["n_words"]


def test_one_document_of_each_group_stays(stages):
    groups = brute_components([(r["doc_id"], r["text"]) for r in stages[2].select("doc_id", "text").collect()], 5, 80, 100)
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted({g for _, _, g in groups})


def test_private_data_is_gone_and_everything_is_packed(stages):
    private = re.compile(r"[\w.]+@[\w.]+\w|AKIA[0-9A-Z]{16}|\b\d{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}")
    # A 16-digit number whose check digit is wrong is no card and stays.
    values = lambda t: {x for x in private.findall(t) if not x.isdigit() or luhn_digit([*map(int, x[:-1])]) == int(x[-1])}
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for r in stages[4].collect():
        assert not values(before[r["doc_id"]]) & values(r["text"]) and r["n_chars"] == len(r["text"])
    packed = stages[5].collect()
    assert {r["doc_id"] for r in packed} == set(before)


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[-1].columns
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(got) == key(stages[-1])
