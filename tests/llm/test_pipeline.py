"""The pipeline on the smallest table, stage by stage against brute force."""

import re

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from tests_llm_brute import brute_components

DATA = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "pii", "packing"]

    one = stages["language_id"](spark, docs, DATA)
    rows = {r.doc_id: r for r in one.collect()}
    source = {r.doc_id: r for r in docs.collect()}
    assert one.columns == columns
    lost = set(source) - set(rows)
    assert len(lost) <= 0.01 * len(source) + sum(not re.search(r"[^\W\d_]", source[i].text or "") for i in lost)
    assert np.mean([rows[i].lang == source[i].lang for i in rows]) > 0.98

    two = stages["exact_dedup"](spark, one, DATA)
    best = {}
    for i, r in rows.items():
        k = (r.text or "").translate(UPPER)
        best[k] = max(best.get(k, i), i)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(best.values())

    three = stages["ngram_join"](spark, two, DATA)
    want = [i for i, _, c in brute_components([(r.doc_id, r.text) for r in two.collect()], 5, 80) if i == c]
    assert three.columns == columns and sorted(r.doc_id for r in three.collect()) == want

    four = stages["pii"](spark, three, DATA)
    before = {r.doc_id: r.text for r in three.collect()}
    after = {r.doc_id: r for r in four.collect()}
    assert four.columns == columns and set(after) == set(before)
    for i, t in before.items():
        for secret in re.findall(r"[\w.]+@mail\d+\.example\.com|\bAKIA[A-Z0-9]{16}\b|\(\d{3}\) 555-\d{4}", t):
            assert secret not in after[i].text
        assert len(after[i].text) == after[i].n_chars

    five = stages["packing"](spark, four, DATA).collect()
    assert {r.doc_id for r in five} == set(before)
    at = sorted((r.sequence_id * 4096 + r.offset, r.length) for r in five)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
    assert corpus_pipeline.run(spark, DATA).count() == len(five)
    assert pq.read_table(f"{DATA}/documents.parquet").num_rows == len(source)
