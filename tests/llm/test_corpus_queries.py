"""Registered queries against their SQL, and the pipeline against its parts."""

import re

import pytest

import corpus_pipeline
from barwright.llm import decontaminate as dc
from barwright.llm import neardup, queries
from harness import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, con, name):
    assert difference(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()) == ""


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    """Every stage drops exactly what a plain look at its own input says."""
    docs, names = spark.read.parquet(f"{SF}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps.append((name, before, docs))
    assert [n for n, _, _ in steps] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(d.columns == names for _, _, d in steps[:-1])
    kept = [{r.doc_id for r in d.collect()} for _, _, d in steps]
    assert kept[0] <= set(steps[0][1])
    first = {}
    for d, t in sorted(steps[1][1].items()):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", t), d)
    assert kept[1] == set(first.values())
    assert kept[2] == {d for d, c in _classes(steps[2][1]).items() if d == c}
    windows = {p for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for p in dc.windows_of(dc.words_of(r.text), 10)}
    assert kept[3] == {d for d, t in steps[3][1].items() if not any(p in b" " + b" ".join(dc.words_of(t)) + b" " for p in windows)}
    assert kept[4] == kept[3]
    assert corpus_pipeline.run(spark, SF).count() == steps[4][2].count()


def _classes(texts):
    parts = {d: neardup.shingles(neardup.words_of(t)) for d, t in texts.items()}
    name = {d: d for d in parts}

    def top(d):
        while name[d] != d:
            d = name[d]
        return d

    ids = sorted(parts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if neardup.similarity(parts[a], parts[b]) >= 0.8:
                x, y = top(a), top(b)
                name[max(x, y)] = min(x, y)
    return {d: top(d) for d in parts}
