"""Toxicity by a classifier regularised with counterfactuals.

A logistic model over the words that are present in a text, and over word beginnings by the number of different
words that share them (inflected insults show by their stem).  A feature enters when its share of toxic training
texts differs from the overall share by more than chance over all features explains (a Chernoff bound, corrected
for their number); identity terms always enter.  Besides the log loss the fit minimises the change of score when an
identity term of a labelled sentence is swapped for another of its kind, left out, or inflected otherwise.  A swap
replaces all forms of the term in the text, and its change is that of all features, words and beginnings, given the
text's other words.  For a linear score it is a sum of weights, so the sentences are reduced to counts of swaps, and
the penalty is exact.  A group that is mentioned is then worth as much as any other and as none.

Labels are learned from a sample of at most ``TRAIN_ROWS`` labelled rows in the order of a hash of doc_id, never from
held-out rows; repeated texts are learned once.  Word counts are made by Spark over the sample; the driver fits a
model of at most ``MAX_FEATURES`` features.

Nulls: a null text is empty, null or other labels than 0 and 1 are ignored, rows with a null doc_id are scored
but not learned.  A document with several labels counts as toxic if one says so.  Without labels of both kinds all
scores are the smoothed share of toxic labels.  An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import gathered, held_out, small_batches, texts
from .decontaminate import TO_WORDS

TRAIN_ROWS = 40_000
MAX_FEATURES = 512
L2 = 0.1
COUNTERFACTUAL = 5.0
#: Odds that a chosen word would stand out by chance anywhere: one in so many fits.
CHANCE = 20
THRESHOLD = 0.5
#: Bytes of a word beginning, and how many different words must share it, for a feature.
STEM_BYTES = (5, 7)
STEM_WORDS = (1, 2, 3)

#: Terms that name groups, by kind; a term is only swapped within its kind.  Fixed values.
IDENTITY_TERMS = {
    "religion": ("atheist", "buddhist", "catholic", "christian", "hindu", "jew", "jewish", "muslim", "protestant", "sikh",
                 "christ", "muslimisch", "jüdisch", "christlich", "musulman", "juif", "chrétien", "musulmán", "judío", "cristiano"),
    "gender": ("man", "men", "woman", "women", "female", "male", "girl", "boy", "transgender", "mann", "frau", "femme", "homme",
               "mujer", "hombre"),
    "orientation": ("bisexual", "gay", "heterosexual", "homosexual", "lesbian", "queer", "straight", "schwul", "lesbisch"),
    "origin": ("african", "american", "arab", "asian", "black", "chinese", "european", "hispanic", "immigrant", "indian", "latino",
               "mexican", "migrant", "refugee", "white", "türkisch", "arabe", "árabe", "africain", "africano"),
    "body": ("blind", "deaf", "disabled", "elderly", "old", "young", "behindert", "aveugle", "ciego"),
}
#: Endings of inflected terms; terms of fewer than four letters only take the first two.
ENDINGS = ("", "s", "es", "e", "en", "em", "er", "n", "in", "innen", "ne", "nes", "a", "o", "as", "os")
SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(TO_WORDS).split()


def stems(words: set[bytes], wanted: set[bytes] | None = None) -> Iterator[bytes]:
    """A feature ``beginning*k`` for each k that the number of different words with the beginning reaches."""
    for n in STEM_BYTES:
        begin = (w[:n] for w in words if len(w) > n)
        for stem, count in Counter(begin if wanted is None else (b for b in begin if b in wanted)).items():
            for k in STEM_WORDS:
                if count >= k:
                    yield b"%s*%d" % (stem, k)


def features_of(text: str) -> list[bytes]:
    words = set(words_of(text))
    return [*words, *stems(words)]


def identity_words() -> dict[bytes, str]:
    return {t.encode(): kind for kind, terms in IDENTITY_TERMS.items() for t in terms}


def inflected(term: str) -> list[bytes]:
    """The forms of a term, one per ending and in their order."""
    root = term[:-1] if term.endswith("o") else term
    return [(term if not e else (root if e[0] in "aeo" else term) + e).encode() for e in (ENDINGS if len(term) > 3 else ENDINGS[:2])]


def identity_forms() -> dict[bytes, tuple[str, str, int]]:
    """Form -> (kind, term, number of the ending); a term itself is never the form of another."""
    terms = [(kind, t) for kind, ts in IDENTITY_TERMS.items() for t in ts]
    forms = {f: (kind, t, i) for kind, t in sorted(terms, key=lambda x: (len(x[1]), x[1])) for i, f in enumerate(inflected(t))}
    return forms | {t.encode(): (kind, t, 0) for kind, t in terms}


def related_beginnings(forms: dict[bytes, tuple[str, str, int]]) -> dict[str, set[bytes]]:
    """Per kind the beginnings that words of a text may share with its terms."""
    out: dict[str, set[bytes]] = {kind: set() for kind in IDENTITY_TERMS}
    for form, (kind, _, _) in forms.items():
        out[kind].add(form[:min(STEM_BYTES)])
    return out


def training_sample(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """text and label of at most ``rows`` labelled documents, repeated texts once, written to the shared folder."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    chosen = chosen.filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()
    spark = docs.sparkSession
    order = np.argsort(picked["doc_id"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast((picked["doc_id"].to_numpy(np.int64)[order], picked["label"].to_numpy(np.int32)[order]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, label = shared.value
        for b in batches:
            ids = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            if not len(known) or not len(ids):
                continue
            at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            there = np.flatnonzero((known[at] == ids) & np.array(b.column("doc_id").is_valid()))
            yield pa.RecordBatch.from_arrays([b.column("text").take(pa.array(there)), pa.array(label[at[there]])], names=["text", "label"])

    sample = texts(docs).mapInArrow(keep, "text string, label int")
    return cut_lineage(sample.groupBy("text").agg(F.max("label").alias("label")))


def feature_counts(sample: DataFrame) -> DataFrame:
    """Per feature: toxic and other training texts that have it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            toxic, other = Counter(), Counter()
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                (toxic if label else other).update(features_of(text))
            features = list(toxic | other)
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.binary()), pa.array([toxic[f] for f in features], pa.int64()),
                                              pa.array([other[f] for f in features], pa.int64())], names=["feature", "toxic", "other"])

    return sample.mapInArrow(count, "feature binary, toxic long, other long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def chosen_features(sample: DataFrame, share: float, most: int = MAX_FEATURES) -> list[bytes]:
    """Features whose share of toxic texts is surely not the overall one."""
    counts = cut_lineage(feature_counts(sample))
    n, k = F.col("toxic") + F.col("other"), F.col("toxic")
    term = lambda a, b, p: F.when(a > 0, a * F.log(a / (b * F.lit(p)))).otherwise(0.0)
    surprise = term(k, n, share) + term(F.col("other"), n, 1 - share)
    bound = float(np.log(CHANCE * max(1, counts.count())))
    best = counts.select("feature", surprise.alias("surprise")).filter(F.col("surprise") >= bound)
    return [bytes(r.feature) for r in best.orderBy(F.desc("surprise"), "feature").limit(most).collect()]


def training_rows(sample: DataFrame, words: list[bytes]) -> DataFrame:
    """Label and positions of the model's words in each text, and a line per mention of an identity term in a sentence:
    the term, and the words of the text that are forms of its kind or begin like them."""
    index, forms = {w: i for i, w in enumerate(words)}, identity_forms()
    begins = related_beginnings(forms)

    def mentions(text: str, there: set[bytes]) -> list[str]:
        if not there & forms.keys():
            return []
        lines, n = [], min(STEM_BYTES)
        for s in SENTENCE.split(text):
            for kind, term in sorted({forms[w][:2] for w in set(words_of(s)) & forms.keys()}):
                near = sorted(w for w in there if w[:n] in begins[kind])
                lines.append(" ".join([term, *(w.decode() for w in near)]))
        return lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has, terms = [], []
            for text in b.column("text").to_pylist():
                there = set(words_of(text))
                has.append(sorted({index[f] for f in [*there, *stems(there)] if f in index}))
                terms.append(mentions(text, there))
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(has, pa.list_(pa.int32())), pa.array(terms, pa.list_(pa.string()))],
                                             names=["label", "has", "terms"])

    return sample.mapInArrow(run, "label int, has array<int>, terms array<string>")


def swapped(term: str, near: set[bytes], forms: dict[bytes, tuple[str, str, int]]) -> list[set[bytes]]:
    """The words ``near`` a mention after each swap of all forms of the term: for its peers in the same form, for none,
    and for its own other forms."""
    mine = {w: forms[w][2] for w in near if w in forms and forms[w][1] == term}
    rest = near - mine.keys()
    peers = [inflected(p) for p in IDENTITY_TERMS[forms[term.encode()][0]] if p != term]
    changed = [rest | {p[i] if i < len(p) else p[0] for i in mine.values()} for p in peers]
    return [*changed, rest, *(new for f in inflected(term) if (new := rest | {f}) != near)]


def swap_penalty(term_counts: Counter, words: list[bytes], strength: float) -> np.ndarray:
    """Matrix Q of the mean squared score change w'Qw over all swaps of the labelled sentences.

    Mentions are lines of ``training_rows``, or the position of a term that stands alone in its text."""
    index, forms = {w: i for i, w in enumerate(words)}, identity_forms()
    total = max(1, sum(term_counts.values()))

    def positions(near: set[bytes]) -> set[int]:
        return {index[f] for f in [*near, *stems(near)] if f in index}

    shares: Counter = Counter()
    for key, n in sorted(term_counts.items(), key=lambda x: str(x[0])):
        term, *near = [words[key].decode()] * 2 if isinstance(key, int) else key.split(" ")
        near = {w.encode() for w in near}
        before, after = positions(near), swapped(term, near, forms)
        for new in after:
            there = positions(new)
            shares[tuple(sorted(before - there)), tuple(sorted(there - before))] += n / total / len(after)
    q = np.zeros((len(words) + 1,) * 2)
    for (lost, won), share in shares.items():
        at, d = np.array([*lost, *won], int), np.repeat([1.0, -1.0], [len(lost), len(won)])
        q[np.ix_(at, at)] += share * np.outer(d, d)
    return strength * q


def fit_weights(label: np.ndarray, has: list[np.ndarray], n_words: int, penalty: np.ndarray, l2: float = L2) -> np.ndarray:
    """Weights and, last, the bias: damped Newton steps on log loss + l2 + rows * penalty."""
    n = len(label)
    ridge = np.diag(np.append(np.full(n_words, l2), 1e-6)) + n * (penalty + penalty.T) / 2
    w = np.zeros(n_words + 1)

    def block(a: int) -> np.ndarray:
        x = np.zeros((min(2000, n - a), n_words + 1))
        x[:, -1] = 1
        for i, cols in enumerate(has[a:a + 2000]):
            x[i, cols] = 1
        return x

    def loss(v: np.ndarray) -> float:
        z = np.concatenate([block(a) @ v for a in range(0, n, 2000)])
        return float(np.sum(np.logaddexp(0, z) - label * z) + v @ ridge @ v / 2)

    now = loss(w)
    for _ in range(30):
        grad, hess = ridge @ w, ridge.copy()
        for a in range(0, n, 2000):
            x = block(a)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            grad += x.T @ (p - label[a:a + 2000])
            hess += (x * (p * (1 - p))[:, None]).T @ x
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6:
            break
        w, gain, now = w - size * step, now - new, new
        if gain < 1e-9 * max(1.0, abs(now)):
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, strength: float = COUNTERFACTUAL, l2: float = L2) -> dict:
    """{"weights": word -> weight, "bias": number}"""
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, rows=rows)
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    if len(n) < 2:
        return {"weights": {}, "bias": float(np.log(share / (1 - share)))}
    words = sorted({*chosen_features(sample, share), *identity_words()})
    data = training_rows(sample, words).toPandas()
    counts = Counter(str(line) for terms in data["terms"] for line in terms)
    w = fit_weights(data["label"].to_numpy(float), list(data["has"]), len(words), swap_penalty(counts, words, strength), l2)
    return {"weights": dict(zip(words, w[:-1].tolist(), strict=True)), "bias": float(w[-1])}


def scorer(model: dict):
    """The score of one text."""
    weights, bias = model["weights"], model["bias"]
    wanted = {f.rpartition(b"*")[0] for f in weights if b"*" in f}

    def one(text: str | None) -> float:
        words = set(words_of(text or ""))
        there = sorted([*(weights.keys() & words), *(f for f in stems(words, wanted) if f in weights)])
        z = bias + sum(weights[f] for f in there)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))
    return one


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([one(t) for t in b.column("text").to_pylist()], pa.float64())],
                                             names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Rows below the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer(model)
        for b in batches:
            yield b.filter(pa.array([one(t) < threshold for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
