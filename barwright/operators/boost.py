"""Gradient-boosted trees, many models at once, in rounds that continue from stored margins.

Feature values are cut at approximate quantiles (one aggregate of bounded sketches), and rows are packed into blocks of
small codes that stay persisted.  A tree grows level by level; a level is one pass over the blocks in which every task
adds up gradients, second derivatives and counts per (model, open node, feature, code).  The sums are dealt by model and
merged there, stay there for the next level, and only the best cut of every open node goes to the driver.  All models
(trials times folds) that are still open share the passes.
Every row keeps its margin per model: a round adds one tree, the last few trees are added on the fly, and every
``KEEP`` rounds the blocks are rewritten with new margins and checkpointed.  No round is ever fitted twice.

The sums use RDD passes with numpy: dense partial sums have no DataFrame form without one row per (node, feature, code).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_root

BINS = 32
#: Rows that are worth a task of their own; more come in several blocks per task.
BLOCK_ROWS = 4096
#: Trees added on the fly before the blocks' margins are rewritten.
KEEP = 16
#: Bytes of sums that a task holds in one pass; more open nodes take several passes.
SUM_BYTES = 64 << 20
#: Bytes of sums that are worth a task of their own.
PART_BYTES = 4 << 20
#: Least second derivative of a leaf.
LEAST_CURVE = 1e-3


@dataclass(frozen=True)
class Objective:
    """Loss of a margin: ``kind`` is ``focal`` (labels 0 and 1) or ``squared``."""

    kind: str = "squared"
    alpha: float = 0.25
    gamma: float = 2.0
    pos_weight: float = 1.0

    def _true_class(self, m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sign of the class, probability of the true one and weight of the class."""
        sign = np.where(y > 0.5, 1.0, -1.0)
        q = 1.0 / (1.0 + np.exp(-np.clip(sign * m, -500.0, 500.0)))
        return sign, q, np.where(y > 0.5, self.alpha * self.pos_weight, 1.0 - self.alpha)

    def slopes(self, m: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives by the margin."""
        if self.kind == "squared":
            return w * (m - y), w
        sign, q, a = self._true_class(m, y)
        rest, log_q = 1.0 - q, np.log(q + 1e-12)
        scale = w * a * rest ** self.gamma
        return sign * scale * (self.gamma * q * log_q - rest), scale * (self.gamma * (rest - q * log_q) + 1.0) * q * rest

    def loss(self, m: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        if self.kind == "squared":
            return w * (m - y) ** 2
        _, q, a = self._true_class(m, y)
        return -w * a * (1.0 - q) ** self.gamma * np.log(q + 1e-12)


@dataclass(frozen=True)
class Spec:
    """One model: its objective, tree limits and rows.  Rows below ``fit_to`` are fitted, those from there to
    ``stop_to`` decide when boosting stops, those from there to ``score_to`` are scored."""

    objective: Objective
    fit_to: int
    stop_to: int
    score_to: int
    depth: int = 6
    leaves: int = 31
    step: float = 0.1
    subsample: float = 1.0
    min_rows: int = 20
    feature_share: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    seed: int = 0


@dataclass
class Tree:
    """Nodes as arrays; an inner node sends codes up to ``cut`` to ``left`` and others to ``left + 1``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def packed(self) -> tuple:
        return (np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.value), self.depth)


def node_of(tree: tuple, codes: np.ndarray) -> np.ndarray:
    """The leaf (or open node) of every row."""
    feature, cut, left, _, depth = tree
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for _ in range(depth):
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            break
        node = np.where(inner, left[node] + (codes[rows, np.maximum(f, 0)] > cut[node]), node)
    return node


def drawn(rows: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Which rows a round uses: a hash of the row's index, so that any task decides alike."""
    if share >= 1.0:
        return np.ones(len(rows), bool)
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + turn) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / 2.0 ** 53 < share


def code_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct approximate quantiles of every feature, from one pass of bounded sketches."""
    shares = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, 2000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q if q is not None else [], float)) for q in found]


def packed_blocks(df: DataFrame, features: Sequence[str], label: str, weight: str | None, row: str, edges: Sequence[np.ndarray]):
    """Persisted RDD of blocks: codes, label, weight and row index as arrays."""
    names = list(features)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.empty((b.num_rows, len(names)), np.uint8)
            for i in range(len(names)):
                x = np.nan_to_num(b.column(3 + i).to_numpy(zero_copy_only=False).astype(float), nan=0.0)
                codes[:, i] = np.searchsorted(edges[i], x, side="left")
            parts = [codes, *(b.column(j).to_numpy(zero_copy_only=False).astype(t) for j, t in enumerate((np.int64, float, float)))]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["codes", "row", "y", "w"])

    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    chosen = df.select(F.col(row).cast("long").alias("row"), F.col(label).cast("double").alias("y"), w.alias("w"),
                       *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(names)])
    parts = min(max(1, -(-df.count() // BLOCK_ROWS)), 4 * df.sparkSession.sparkContext.defaultParallelism)
    dealt = chosen.repartition(parts, "row").sortWithinPartitions("row")
    packed = dealt.mapInArrow(pack, "codes binary, row binary, y binary, w binary")
    width = len(names)

    def unpack(r) -> dict:
        return {"codes": np.frombuffer(r[0], np.uint8).reshape(-1, width), "row": np.frombuffer(r[1], np.int64),
                "y": np.frombuffer(r[2]), "w": np.frombuffer(r[3]), "margins": {}}

    return packed.rdd.map(unpack)


def added(left: dict, right: dict) -> dict:
    """Partial sums merged."""
    for key, value in right.items():
        left[key] = left[key] + value if key in left else value
    return left


def gains(sums: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Gain of every (feature, cut) of a node, and the node's own score; ``sums`` are (feature, code, 3)."""
    total = sums[0].sum(axis=0)
    low = np.cumsum(sums, axis=1)[:, :-1]
    high = total - low

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(g) - spec.l1, 0.0) ** 2 / (h + spec.l2 + 1e-12)

    fits = (low[..., 2] >= spec.min_rows) & (high[..., 2] >= spec.min_rows)
    fits &= (low[..., 1] >= LEAST_CURVE) & (high[..., 1] >= LEAST_CURVE)
    value = score(low[..., 0], low[..., 1]) + score(high[..., 0], high[..., 1]) - score(total[0], total[1])
    return np.where(fits, value, -np.inf), total


def stopping_loss(spec: Spec, b: dict, m: np.ndarray) -> np.ndarray:
    """Loss and weight of the rows of a block that decide when boosting stops."""
    mine = (b["row"] >= spec.fit_to) & (b["row"] < spec.stop_to)
    return np.array([spec.objective.loss(m[mine], b["y"][mine], b["w"][mine]).sum(), b["w"][mine].sum()])


def leaf_value(total: np.ndarray, spec: Spec) -> float:
    """A damped Newton step."""
    g = np.sign(total[0]) * max(abs(total[0]) - spec.l1, 0.0)
    return float(-spec.step * g / (total[1] + spec.l2 + 1e-12))


def own(model: int) -> int:
    """Partition of a model's sums."""
    return model


def best_cut(sums: np.ndarray, spec: Spec) -> tuple:
    """Gain, feature and code of a node's best cut, the node's own sums and those of both sides."""
    gain, total = gains(sums, spec)
    best = int(np.argmax(gain))
    f, cut = divmod(best, gain.shape[1])
    return float(gain.flat[best]), f, cut, total, sums[f, :cut + 1].sum(axis=0), sums[f, cut + 1:].sum(axis=0)


def opened(records: Iterator[tuple], frontier: dict[int, list[tuple]]) -> Iterator[tuple]:
    """From the sums of smaller children, and of all nodes one level up, the sums of every open node of the models of a
    partition: a larger child has what its parent has besides the smaller one.  Losses pass through."""
    near, above = {}, {}
    for i, (kind, found) in records:
        if kind == "loss":
            yield i, (kind, found)
        else:
            (near if kind == "near" else above).setdefault(i, {}).update(found)
    for i, found in near.items():
        sums = {}
        for node, other, parent in frontier[i]:
            if node in found:
                sums[node] = found[node]
                if other is not None:
                    sums[other] = above[i][parent] - found[node]
        yield i, ("sums", sums)


class Boosting:
    """Models that grow together.  ``trees[i]`` are a model's trees, ``losses[i][k]`` its loss on the stopping rows with
    ``k`` of them; the loss of the last tree comes with the next pass."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, weight: str | None, row: str, specs: Sequence[Spec],
                 keep: int = KEEP, bins: int = BINS):
        checkpoint_root(df.sparkSession)
        self.specs, self.keep, self.bins, self.width = list(specs), keep, bins, len(features)
        edges = code_edges(df, features, bins)
        self.blocks = packed_blocks(df, features, label, weight, row, edges).persist(StorageLevel.MEMORY_AND_DISK)
        self.trees: list[list[Tree]] = [[] for _ in specs]
        self.losses: list[list[float]] = [[] for _ in specs]
        self.stored = [0] * len(specs)  # trees already in the blocks' margins
        whole = sum(s.leaves for s in specs) * self.width * bins * 24  # bytes of all sums of a round's last levels
        self.parts = max(1, min(len(specs), df.sparkSession.sparkContext.defaultParallelism, whole // PART_BYTES))
        self.base = self._starting_margins()

    def _starting_margins(self) -> list[float]:
        """0 for a class, the weighted mean of the fitted labels for a value."""
        specs = self.specs

        def sums(blocks: Iterator[dict]) -> Iterator[dict]:
            total: dict = {}
            for b in blocks:
                for i, s in enumerate(specs):
                    mine = b["row"] < s.fit_to
                    added(total, {i: np.array([(b["w"] * b["y"])[mine].sum(), b["w"][mine].sum()])})
            yield total

        found = self.blocks.mapPartitions(sums).treeAggregate({}, added, added)
        return [float(found[i][0] / found[i][1]) if s.objective.kind == "squared" and i in found and found[i][1] else 0.0
                for i, s in enumerate(specs)]

    # -- passes over the rows -----------------------------------------------------------------------------------

    def _partial(self, models: Sequence[int], work: Callable, upto: dict[int, int] | None = None):
        """Every task's sums of ``work(model, block, margins)``.  With ``upto`` the margins are those of a model's
        first trees only, counted from the start."""
        late = {i: [t.packed() for t in (self.trees[i][self.stored[i]:] if upto is None else self.trees[i][:upto[i]])] for i in models}
        base, whole = self.base, upto is not None

        def run(blocks: Iterator[dict]) -> Iterator[dict]:
            total: dict = {}
            for b in blocks:
                for i in models:
                    m = b["margins"].get(i)
                    m = np.full(len(b["y"]), base[i]) if m is None or whole else m
                    for t in late[i]:
                        m = m + t[3][node_of(t, b["codes"])]
                    added(total, work(i, b, m))
            yield total

        return self.blocks.mapPartitions(run)

    def _pass(self, models: Sequence[int], work: Callable, upto: dict[int, int] | None = None) -> dict:
        """Few numbers per model, added up over all blocks."""
        return self._partial(models, work, upto).treeAggregate({}, added, added)

    def _store(self) -> None:
        """Margins of all trees so far go into the blocks."""
        late = {i: [t.packed() for t in trees[self.stored[i]:]] for i, trees in enumerate(self.trees)}
        base = self.base

        def rewrite(b: dict) -> dict:
            margins = dict(b["margins"])
            for i, trees in late.items():
                m = margins.get(i, np.full(len(b["y"]), base[i]))
                for t in trees:
                    m = m + t[3][node_of(t, b["codes"])]
                margins[i] = m
            return {**b, "margins": margins}

        before, self.blocks = self.blocks, self.blocks.map(rewrite).persist(StorageLevel.MEMORY_AND_DISK)
        self.blocks.checkpoint()
        self.blocks.count()
        before.unpersist()
        self.stored = [len(t) for t in self.trees]

    def _sums(self, open_: dict[int, list[int]], grown: dict[int, tuple], columns: dict[int, np.ndarray], unknown: set[int]):
        """RDD of (feature, code, 3) sums by node for every model, dealt by model, and of the losses of the ``unknown``
        models on their stopping rows."""
        specs, bins, turn = self.specs, self.bins, {i: len(self.trees[i]) for i in open_}

        def work(i: int, b: dict, m: np.ndarray) -> dict:
            s, out = specs[i], {}
            if i in unknown:
                out["loss", i] = stopping_loss(s, b, m)
            fitted = np.flatnonzero((b["row"] < s.fit_to) & drawn(b["row"], s.seed, turn[i], s.subsample))
            if not len(fitted):
                return out
            codes = b["codes"][fitted]
            slot = np.full(len(grown[i][0]), -1)
            slot[open_[i]] = np.arange(len(open_[i]))
            at = slot[node_of(grown[i], codes)]
            there = at >= 0
            g, h = s.objective.slopes(m[fitted], b["y"][fitted], b["w"][fitted])
            used = columns[i]
            cell = ((at[there, None] * len(used) + np.arange(len(used))) * bins + codes[there][:, used]).ravel()
            size = len(open_[i]) * len(used) * bins
            sums = [np.bincount(cell, np.repeat(x[there], len(used)), size) for x in (g, h)] + [np.bincount(cell, minlength=size).astype(float)]
            out["near", i] = np.stack(sums, axis=-1).reshape(len(open_[i]), len(used), bins, 3)
            return out

        def by_model(totals: Iterator[dict]) -> Iterator[tuple]:
            for total in totals:
                for (kind, i), value in total.items():
                    yield i, {kind: value}

        def parted(pair: tuple) -> Iterator[tuple]:
            i, found = pair
            if "loss" in found:
                yield i, ("loss", found["loss"])
            if "near" in found:
                yield i, ("near", dict(zip(open_[i], found["near"], strict=True)))

        dealt = self._partial(list(open_), work).mapPartitions(by_model).reduceByKey(added, self.parts, own)
        return dealt.mapPartitions(lambda pairs: (x for pair in pairs for x in parted(pair)), preservesPartitioning=True)

    def _level(self, frontier: dict[int, list[tuple]], grown: dict[int, tuple], columns: dict[int, np.ndarray], above) -> tuple:
        """The sums of all open nodes, as a persisted RDD, and the best cut of each; ``above`` are the sums one level up."""
        unknown, asked = {i for i in frontier if len(self.losses[i]) <= len(self.trees[i])}, set()
        records = above.filter(lambda x: x[1][0] == "sums").mapValues(lambda v: ("above", v[1])) if above is not None else None
        for part in self._portions({i: [n for n, _, _ in nodes] for i, nodes in frontier.items()}, columns):
            found = self._sums(part, {i: grown[i] for i in part}, {i: columns[i] for i in part}, (unknown - asked) & set(part))
            asked |= set(part)
            records = found if records is None else records.union(found)
        specs = self.specs
        level = records.mapPartitions(lambda r: opened(r, frontier), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)

        def offers(pairs: Iterator[tuple]) -> Iterator[tuple]:
            for i, (kind, found) in pairs:
                if kind == "loss":
                    yield ("loss", i), found
                else:
                    yield from (((i, node), best_cut(sums, specs[i])) for node, sums in found.items())

        known = dict(level.mapPartitions(offers).collect())
        if above is not None:
            above.unpersist()
        return level, self._heard(unknown, known)

    def _heard(self, unknown: set[int], found: dict) -> dict:
        """Losses among sums go to their list."""
        for i in unknown:
            total = found.pop(("loss", i), np.zeros(2))
            self.losses[i].append(float(total[0] / total[1]) if total[1] else 0.0)
        return found

    def _last_losses(self, models: Sequence[int]) -> None:
        specs, unknown = self.specs, {i for i in models if len(self.losses[i]) <= len(self.trees[i])}
        if unknown:
            self._heard(unknown, self._pass(sorted(unknown), lambda i, b, m: {("loss", i): stopping_loss(specs[i], b, m)}))

    # -- rounds -------------------------------------------------------------------------------------------------

    def round(self, models: Sequence[int]) -> None:
        """One more tree for every listed model."""
        if max((len(self.trees[i]) - self.stored[i] for i in models), default=0) >= self.keep:
            self._store()
        grown = {i: Tree() for i in models}
        columns = {i: self._columns(i, len(self.trees[i])) for i in models}
        frontier, leaves, above = {i: [(0, None, None)] for i in models}, dict.fromkeys(models, 1), None
        while frontier:
            above, known = self._level(frontier, {i: grown[i].packed() for i in frontier}, columns, above)
            frontier = {i: new for i in frontier if (new := self._split(
                i, grown[i], columns[i], [n for pair in frontier[i] for n in pair[:2] if n is not None], known, leaves))}
        if above is not None:
            above.unpersist()
        for i in models:
            self.trees[i].append(grown[i])

    def _columns(self, i: int, turn: int) -> np.ndarray:
        s = self.specs[i]
        n = max(1, int(np.ceil(s.feature_share * self.width)))
        return np.sort(np.random.default_rng([s.seed, turn]).choice(self.width, n, replace=False)) if n < self.width else np.arange(self.width)

    def _portions(self, frontier: dict[int, list[int]], columns: dict[int, np.ndarray]) -> Iterator[dict[int, list[int]]]:
        """Open nodes in portions whose sums stay below ``SUM_BYTES``."""
        part, size = {}, 0
        for i, node in ((i, node) for i, nodes in frontier.items() for node in nodes):
            each = len(columns[i]) * self.bins * 24
            if part and size + each > SUM_BYTES:
                yield part
                part, size = {}, 0
            part.setdefault(i, []).append(node)
            size += each
        if part:
            yield part

    def _split(self, i: int, tree: Tree, used: np.ndarray, nodes: list[int], known: dict, leaves: dict[int, int]) -> list[tuple]:
        """Split the open nodes of largest gain while leaves remain.  What was split opens its children, as the smaller
        child, the larger one and the parent."""
        s, offers = self.specs[i], []
        for node in nodes:
            if (i, node) not in known:
                continue
            gain, _, _, total, _, _ = known[i, node]
            tree.value[node] = leaf_value(total, s)
            if gain > 1e-12:
                offers.append((-gain, node))
        new: list[tuple] = []
        for _, node in sorted(offers):
            if leaves[i] >= s.leaves:
                break
            _, f, cut, _, *sides = known[i, node]
            tree.feature[node], tree.cut[node], tree.left[node] = int(used[f]), cut, len(tree.feature)
            new.append((len(tree.feature) + (sides[0][2] > sides[1][2]), len(tree.feature) + (sides[0][2] <= sides[1][2]), node))
            for side in sides:
                tree.feature.append(-1)
                tree.cut.append(0)
                tree.left.append(0)
                tree.value.append(leaf_value(side, s))
            leaves[i] += 1
        tree.depth += bool(new)
        return new if tree.depth < s.depth and leaves[i] < s.leaves else []

    def fit_to(self, rounds: dict[int, int], patience: int) -> None:
        """Rounds until every listed model has its number of trees or has seen no lower loss for ``patience`` rounds."""
        while open_ := [i for i, n in rounds.items() if len(self.trees[i]) < n and not best_round(self.losses[i], patience)[1]]:
            self.round(open_)
        self._last_losses(list(rounds))

    def best(self, i: int, patience: int) -> int:
        """How many trees of a model had the lowest loss."""
        return best_round(self.losses[i], patience)[0] - 1 if self.losses[i] else 0

    def scored(self, upto: dict[int, int], measure: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
        """Sums of ``measure(model, margin, label, weight)`` over each model's scored rows, by its first trees."""
        specs = self.specs

        def work(i: int, b: dict, m: np.ndarray) -> dict:
            mine = (b["row"] >= specs[i].stop_to) & (b["row"] < specs[i].score_to)
            return {i: measure(i, m[mine], b["y"][mine], b["w"][mine])}

        return self._pass(list(upto), work, upto)

    def close(self) -> None:
        self.blocks.unpersist()


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the lowest error before ``patience`` rounds without a lower one, and whether so many were seen."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        if i - best >= patience:
            return best + 1, True
    return best + 1, False
