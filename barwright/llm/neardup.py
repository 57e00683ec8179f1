"""Near-duplicates by ProbMinHash, banding and verification.

Words are lower-case runs of letters and digits; a text's elements are its shingles of five words (all words of a
shorter text), weighted by how often they occur.  Every element is a Poisson process of its weight's rate whose
arrivals fall on random registers; a register keeps the element that arrives first, and an element stops as soon as
its next arrival is later than every register.  Two texts agree in a register with their probability Jaccard
similarity; with equal weights that is the plain one.  Bands of registers give candidates, and the exact
similarity of the shingles, from whole texts, decides.

Texts with the same words are one node.  Within a band's bucket all nodes are compared with one centre, and
components of the verified links are formed.  Where a bucket still holds several components, texts whose shingles
outside their own component cannot reach the similarity are set aside, the rest is compared with the bucket's most
typical text, and then every pair in different components whose overlap, bounded by what both share with that
text, can still reach it.  Pairs within a
component need no comparison, since they could not change it; so the pairs of a large group of copies are not
listed, and no link between components is lost.

Nulls: a null text is empty, texts without words are alone.  A row with a null doc_id joins the class of equal words,
but forms no links; its class is null where no row with those words has an id.  Rows that repeat a doc_id are one
document.  An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import gathered, mix64, released, texts
from .components import components
from .decontaminate import words_of

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 36, 6
#: Arrivals drawn at once, and bytes of text taken together.
DRAWS, GATHERED = 1_000_000, 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash per word."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw == 32) + 1])
    lengths = np.diff(np.append(starts, len(raw) + 1))
    place = np.arange(len(raw) + 1) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, 0x100000001B3, np.uint64))
    return mix64(np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers[place[:-1]], starts))


def shingles(words: list[bytes], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how often each occurs."""
    h = word_hashes(words)
    if not len(h):
        return h, np.zeros(0, np.int64)
    size = min(size, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        total = total * GOLDEN + h[j:len(h) - size + 1 + j]
    return np.unique(mix64(total), return_counts=True)


def signatures(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """The element that wins each of k registers, per text (rows of texts without elements are zero)."""
    n = len(parts)
    element = np.concatenate([e for e, _ in parts]) if parts else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in parts]).astype(float) if parts else np.zeros(0)
    owner = np.repeat(np.arange(n), [len(e) for e, _ in parts])
    first, winner = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    total = np.bincount(owner, weight, n)
    # Enough arrivals at once to fill the registers of a short text; a long text's elements start with one.
    draws = np.maximum(1, np.ceil(k * (np.log(k) + 1) * weight / total[owner])).astype(np.int64)
    time, done = np.zeros(len(element)), np.zeros(len(element), np.int64)
    while len(element):
        parts_at, parts_time = [], []
        last = np.zeros(len(element))
        for d in np.unique(draws).tolist():  # elements with as many draws form a matrix, one row each
            mine = np.flatnonzero(draws == d)
            turn = (done[mine, None] + np.arange(1, d + 1)).astype(np.uint64)
            bits = mix64(element[mine, None] + turn * GOLDEN)
            gap = -np.log(((bits >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53) / weight[mine, None]
            arrival = time[mine, None] + np.cumsum(gap, axis=1)
            last[mine] = arrival[:, -1]
            register = (mix64(bits ^ GOLDEN) % np.uint64(k)).astype(np.int64)
            parts_at.append(np.stack([np.repeat(mine, d), (owner[mine, None] * k + register).ravel()]))
            parts_time.append(arrival.ravel())
        (at, cell), arrival = np.concatenate(parts_at, axis=1), np.concatenate(parts_time)
        np.minimum.at(first, cell, arrival)
        best = arrival == first[cell]
        winner[cell[best]] = element[at[best]]
        done = done + draws
        alive = last < first.reshape(n, k).max(axis=1)[owner]
        element, weight, owner, time, done, draws = (x[alive] for x in (element, weight, owner, last, done, -(-draws // 4)))
    return winner.reshape(n, k)


def band_keys(winners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band, which also tells the bands apart."""
    key = np.tile(np.arange(bands, dtype=np.uint64) * GOLDEN, (len(winners), 1))
    for r in range(rows):
        key = mix64(key * GOLDEN + winners[:, r::rows][:, :bands])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard: the chance that both texts' processes are first at the same element."""
    union = np.union1d(a[0], b[0])
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])], y[np.searchsorted(union, b[0])] = a[1], b[1]
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    if (x[both] == y[both]).all():  # equal ratios: common weight over that of the union
        return float(x[both].sum() / np.maximum(x, y).sum())
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio = ratio[order]
    xs = np.append(np.cumsum(x[order][::-1])[::-1], 0.0)  # of elements from here up
    ys = np.concatenate([[0.0], np.cumsum(y[order])])  # of elements below
    at = np.searchsorted(ratio, (x / np.where(y > 0, y, 1.0))[both], side="left")
    return float((1 / (xs[at] / x[both] + ys[at] / y[both])).sum())


def portions(costs: list[int], limit: int) -> Iterator[slice]:
    """Slices whose costs add up to at most ``limit``, one dearer item alone."""
    begin, total = 0, 0
    for i, c in enumerate(costs):
        if i > begin and total + c > limit:
            yield slice(begin, i)
            begin, total = i, 0
        total += c
    if begin < len(costs):
        yield slice(begin, len(costs))


def signed(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, 128-bit hash of the words, band keys (none for a text without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = bands * rows
        for b in gathered(batches, limit=GATHERED):
            words = [words_of(t) for t in b.column("text").to_pylist()]
            parts = [shingles(w) for w in words]
            # A text draws about k (ln k + 1) arrivals at once however short it is, and one more per element.
            cuts = portions([int(k * (np.log(k) + 1)) + len(e) for e, _ in parts], DRAWS)
            keys = np.concatenate([np.zeros((0, bands), np.int64), *(band_keys(signatures(parts[c], k), bands, rows) for c in cuts)])
            same = np.frombuffer(b"".join(hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(same[:, 0]), pa.array(same[:, 1]),
                pa.array([k if w else k[:0] for k, w in zip(keys, words, strict=True)], pa.list_(pa.int64())),
            ], names=["doc_id", "same_a", "same_b", "keys"])

    return texts(docs).mapInArrow(run, "doc_id long, same_a long, same_b long, keys array<long>")


def compared(pairs: DataFrame, shelf: DataFrame, threshold: float) -> DataFrame:
    """For pairs (a, b): whether the texts are similar enough, and how many distinct shingles they have in common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, tuple] = OrderedDict()

        def of(i: int, text: str) -> tuple:
            if i not in recent:
                recent[i] = shingles(words_of(text))
                if len(recent) > 64:
                    recent.popitem(last=False)
            recent.move_to_end(i)
            return recent[i]

        for b in batches:
            a_ids, b_ids = b.column("a").to_pylist(), b.column("b").to_pylist()
            parts = [(of(i, x), of(j, y)) for i, j, x, y in zip(
                a_ids, b_ids, b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column("a"), b.column("b"), pa.array([similarity(x, y) >= threshold for x, y in parts], pa.bool_()),
                pa.array([len(np.intersect1d(x[0], y[0], assume_unique=True)) for x, y in parts], pa.int64()),
            ], names=["a", "b", "near", "inside"])

    left = shelf.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = shelf.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        run, "a long, b long, near boolean, inside long")


def verified(pairs: DataFrame, shelf: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts are similar enough."""
    return compared(pairs, shelf, threshold).filter("near").select("a", "b")


def centred(open_: DataFrame) -> DataFrame:
    """Rows of the buckets with the bucket's centre: the text that has most in common with others, as an original has
    with its copies.  ``slack`` is the number of the centre's shingles that occur in no other component."""
    draw = F.struct((1.0 - F.col("shared") / F.col("total")).alias("away"), "node")
    centre = open_.groupBy("key").agg(F.min(draw).alias("c")).select("key", F.col("c.node").alias("centre"))
    own = open_.select("key", F.col("node").alias("centre"), (F.col("total") - F.col("shared")).alias("slack"))
    return open_.join(centre.join(own, ["key", "centre"]), "key")


def can_link(now: DataFrame, shelf: DataFrame, threshold: float) -> DataFrame:
    """Of (key, node, component) the rows whose node can still be similar to one of another component, with the
    weight of its shingles that occur in other components, of all, and the largest single weight of the bucket.

    Only shingles that occur in another component count.  If their weight is below the threshold's share of the
    text no similarity can reach it; and where all weights of a bucket are 1, s such shingles of n allow partners of
    at most s (1 + t) / t - n shingles, which the smallest text of the bucket may exceed.  This holds for every
    partner, so nothing is lost, and copies too far from all others leave a large group before it is paired.
    """
    per_key = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    now = cut_lineage(now.join(per_key.select("key"), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, component, text in zip(*(b.column(c).to_pylist() for c in ("node", "component", "text")), strict=True):
                element, weight = shingles(words_of(text))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(element), node)), pa.array(np.full(len(element), component)),
                    pa.array(element.view(np.int64)), pa.array(weight)], names=["node", "component", "shingle", "weight"])

    nodes = now.select("node", "component").distinct()
    rows = shelf.join(nodes, "node").select("node", "component", "text").mapInArrow(run, "node long, component long, shingle long, weight long")
    rows = cut_lineage(rows)
    spread = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("shingle")
    common = rows.join(spread, "shingle").groupBy("node").agg(F.sum("weight").alias("shared"))
    sums = rows.groupBy("node").agg(F.sum("weight").alias("total"), F.max("weight").alias("top")).join(common, "node")
    sums = cut_lineage(sums.filter(F.col("shared") >= threshold * F.col("total") - 1e-6))
    left = now.join(sums, "node")
    least = left.groupBy("key").agg(F.min("total").alias("least"), F.max("top").alias("most"))
    room = F.col("shared") * ((1 + threshold) / threshold) - F.col("total") + 1e-6
    return cut_lineage(left.join(least, "key").filter((F.col("most") > 1) | (F.col("least") <= room)).select(
        "key", "node", "component", "shared", "total", "most"))


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size and kept."""
    spark = docs.sparkSession
    released(spark)
    marks = cut_lineage(signed(docs, bands, rows))
    heads = marks.groupBy("same_a", "same_b").agg(F.min("doc_id").alias("node"))
    members = cut_lineage(marks.join(heads, ["same_a", "same_b"]).withColumn(
        "node", F.when(F.size("keys") > 0, F.col("node")).otherwise(F.col("doc_id"))))
    buckets = members.filter("doc_id = node").select("node", F.explode("keys").alias("key")).distinct()
    shared = buckets.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    buckets = cut_lineage(buckets.join(shared, "key"))  # only keys that several nodes have
    wanted = buckets.select("node").distinct()
    shelf = texts(docs).join(wanted, F.col("doc_id") == F.col("node")).groupBy("node").agg(F.max("text").alias("text"))
    shelf = cut_lineage(shelf)

    pairs = buckets.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = verified(pairs, shelf, threshold)
    placed = components(links)
    buckets = buckets.select("key", "node")
    del pairs, links
    for turn in (0, 1):
        released(spark)
        now = buckets.join(placed, "node", "left").select(
            *buckets.columns, F.coalesce("component", "node").alias("component"))
        if turn == 0:
            buckets = can_link(now, shelf, threshold)
            released(spark)
            now = buckets
            buckets = buckets.select("key", "node", "shared", "total", "most")
        counts = now.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"))
        several = cut_lineage(counts.filter("low < high").select("key"))
        if several.isEmpty():
            break
        open_ = now.join(several, "key")
        if turn == 0:
            spokes = cut_lineage(centred(open_).select("key", "node", "component", "shared", "total", "most", "centre", "slack"))
            around = spokes.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
            around = cut_lineage(compared(around, shelf, threshold))
            more = around.filter("near").select("a", "b")
            buckets = cut_lineage(spokes.drop("component").join(
                around.select(F.col("a").alias("node"), F.col("b").alias("centre"), "inside"), ["node", "centre"], "left"
            ).withColumn("inside", F.coalesce("inside", "total")))
        else:
            # What two texts share lies in what both share with the centre, or among the shingles outside it that
            # each has in common with other components.
            extra = F.col("shared") - F.col("inside") + F.col("slack")
            keys = open_.groupBy("node").agg(F.collect_list("key").alias("keys"))
            left = open_.join(keys, "node").select(
                "key", "node", "keys", "component", "shared", "total", "most", "inside", extra.alias("extra"))
            right = left.select("key", *[F.col(c).alias(f"its_{c}") for c in ("node", "keys", "component", "shared", "total", "inside", "extra")])
            overlap = F.least(F.least("shared", "its_shared"), F.least("inside", "its_inside") + F.least("extra", "its_extra"))
            pairs = left.join(right, "key").filter("component < its_component").filter(
                (F.col("most") > 1) | (F.col("total") + F.col("its_total") <= overlap * ((1 + threshold) / threshold) + 1e-6)
            ).filter(F.array_min(F.array_intersect("keys", "its_keys")) == F.col("key"))  # in the first bucket they share
            more = verified(pairs.select(F.col("node").alias("a"), F.col("its_node").alias("b")).distinct(), shelf, threshold)
        placed = components(placed.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        del more
    released(spark)
    classed = members.join(placed, "node", "left").select("doc_id", F.coalesce("component", "node").alias("class_id"))
    sizes = classed.groupBy(F.col("class_id").alias("its")).agg(F.count(F.lit(1)).alias("class_size"))
    return classed.join(sizes, F.col("class_id").eqNullSafe(F.col("its"))).select(
        "doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class, with all columns; rows without an id stay."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
