"""What row operators send to Python workers: a text once, and no text where ids decide."""

import numpy as np
import pytest

from tessera.llm import exact_dedup, language_id, ngram_join, pii

SCHEMA = "doc_id long, text string, lang string"
ROWS = [(1, "Write to ann@mail3.example.com", "en"), (2, None, None), (3, "a b c", "en"), (4, "A b C", "en"), (None, "", None)]


def to_python(df) -> list[list[str]]:
    """The columns that each Arrow map of the plan is given."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if node.nodeName() == "MapInArrow":
            own = kids.apply(0).output()
            found.append([own.apply(i).name() for i in range(own.size())])
    return found


@pytest.mark.parametrize("operator", [exact_dedup.annotate, lambda d: language_id.predict(d, None), lambda d: pii.pseudonymise(d, b"k")])
def test_text_goes_once(spark, operator):
    got = operator(spark.createDataFrame(ROWS, SCHEMA))
    assert to_python(got) and all(x == ["row"] for x in to_python(got))
    assert sorted(map(str, (tuple(r.row) for r in got.collect()))) == sorted(map(str, ROWS))


def test_without_sends_ids_only(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = ngram_join.without(docs, spark.createDataFrame([(3,), (99,)], "doc_id long"))
    assert to_python(got) == []
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(r) for r in ROWS if r[0] != 3)


def test_prefixes_made_twice(spark, monkeypatch):
    """Once to count n-grams, once for those in company; what is joined twice is stored between."""
    calls, made = [], ngram_join.prefixes
    monkeypatch.setattr(ngram_join, "prefixes", lambda *a, **k: calls.append(k) or made(*a, **k))
    words = np.random.default_rng(1).integers(0, 50, (20, 40)).astype(str)
    rows = [(i, " ".join(words[i // 2, i % 2 :])) for i in range(40)]
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i in range(40)}
    assert len(calls) == 2 and "only" in calls[1]
