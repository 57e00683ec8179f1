"""Toxicity and quality: held-out accuracy, fairness of the fit, odd rows."""

import numpy as np
import pytest
from pyspark.sql import types as T

from barwright.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.1"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


@pytest.mark.parametrize("name, column, hits, alarms", [("op10_toxicity", "toxic", 0.85, 0.01), ("op6_quality", "quality", 0.97, 0.05)])
def test_held_out_rows(spark, name, column, hits, alarms):
    got = queries.QUERIES[name](spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    yes = rows[column] == 1
    assert rows[yes].predicted.mean() >= hits
    assert rows[~yes].predicted.mean() <= alarms
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_swaps_take_the_bias_out_of_identity_terms():
    words = sorted({*toxicity.identity_words(), b"scum"})
    at = {w: i for i, w in enumerate(words)}
    rng = np.random.default_rng(0)
    label, has, counts = [], [], toxicity.Counter()
    for _ in range(600):  # a group that is mostly mentioned in toxic texts
        toxic = rng.random() < 0.3
        group = rng.random() < (0.8 if toxic else 0.1)
        has.append(np.array(sorted({*([at[b"muslim"]] if group else []), *([at[b"scum"]] if toxic and rng.random() < 0.7 else [])}), int))
        label.append(float(toxic))
        counts.update([at[b"muslim"]] if group else [])
    label = np.array(label)
    plain = toxicity.fit_weights(label, has, len(words), toxicity.swap_penalty(counts, words, 0.0))
    fair = toxicity.fit_weights(label, has, len(words), toxicity.swap_penalty(counts, words, 5.0))
    assert plain[at[b"muslim"]] > 2 and abs(fair[at[b"muslim"]]) < 0.3
    assert fair[at[b"scum"]] > 2


def test_swaps_take_the_bias_out_of_stems_and_inflected_forms(spark):
    rng = np.random.default_rng(1)
    docs, labels, groups = [], [], ("muslim", "muslims", "transgender", "homosexual", "homosexuals")
    for i in range(1500):  # groups that are mostly mentioned in toxic texts, as terms and inflected
        toxic = rng.random() < 0.3
        words = [f"w{n}" for n in rng.integers(0, 500, 8)]
        words += [str(rng.choice(groups))] if rng.random() < (0.8 if toxic else 0.1) else []
        words += ["scum"] if toxic and rng.random() < 0.7 else []
        docs.append((i, " ".join(map(str, rng.permutation(words))) + ".", "x"))
        labels.append((i, 0, int(toxic)))
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    free, fair = (toxicity.fit(docs, labels, strength=s) for s in (0.0, toxicity.COUNTERFACTUAL))
    assert any(f.startswith(b"musli*") for f in fair["weights"]) and any(f.startswith(b"homos*") for f in fair["weights"])
    none = toxicity.scorer(fair)("the park")
    for word in (*groups, "musliminnen", "homosexuelle", "homosexualen"):  # the last ones in no training text
        assert abs(toxicity.scorer(fair)(f"the {word} park") - none) < 0.05, word
    assert toxicity.scorer(free)("the muslim park") - toxicity.scorer(free)("the park") > 0.3  # what the swaps take out
    assert toxicity.scorer(fair)("the scum park") > 0.8


def test_swaps_follow_the_other_words_of_the_text():
    words = sorted({*toxicity.identity_words(), b"musli*1", b"musli*2"})
    at = {w: i for i, w in enumerate(words)}
    w = np.zeros(len(words) + 1)
    w[at[b"musli*1"]] = 1.0
    change = lambda line: w @ toxicity.swap_penalty(toxicity.Counter([line]), words, 1.0) @ w
    assert change("muslim muslim") > 0 and change("muslim muslims") > 0  # the beginning goes with the term
    assert change("muslim muslim muslinware") == 0  # another word of the text keeps it
    w[at[b"musli*1"]], w[at[b"musli*2"]] = 0.0, 1.0
    assert change("muslim muslim") == 0 and change("muslim muslim muslinware") > 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "x"), (2, "", "x"), (3, "word " * 50_000, "x")], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (None, 1, 1), (2, None, None), (2, 7, 7)], LABELS)
    for marks in (labels, labels.limit(0)):
        for got in (toxicity.score(docs, toxicity.fit(docs, marks)), quality.quality(docs, marks)):
            rows = got.collect()
            assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
            assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert toxicity.drop_toxic(docs, toxicity.fit(docs, labels)).columns == docs.columns
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_scores_do_not_use_labels_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    changed = labels.selectExpr("doc_id", *[f"IF(crc32(cast(doc_id as string)) % 5 = 0, 1 - {c}, {c}) AS {c}" for c in ("quality", "toxic")])
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, changed)
    a, b = ({r.doc_id: round(r.score, 9) for r in quality.quality(docs, m).collect()} for m in (labels, changed))
    assert a == b
