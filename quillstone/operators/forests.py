"""Forests and boosted trees that grow over cells: rows whose features fall into the same bins.

The trees are MLlib's: the same candidate splits (from the rows that it would draw), a Poisson bootstrap of each row
for each tree, Gini impurity or variance, a random choice of features per node, merged leaves, importances. MLlib keeps
a hundred counts and a hundred node numbers beside every row; here rows of equal bins and label are one entry with a count,
and nothing is kept beside it. Bootstraps and feature choices come from other random numbers than MLlib's.

Entries are files of ``FILE_ROWS`` at most. If the cells of all fit in one slice, a task grows whole trees. Otherwise
tasks add up histograms of a slice for some trees, level by level, and sums of a tree's nodes meet in one task.

Boosting draws nothing, so its trees are MLlib's. All rows of a cell have one margin. One task boosts where the cells fit
in a slice; beyond that MLlib's own does, on entries weighted by their counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import quoted
from ..functions.trees import BIN_BITS, IN_A_LONG, MAX_BINS, Bootstraps, Ensemble, Plan, Tree, boosted, entries, grown, one_key, packed, split_points, unpacked
from ..session import new_folder, open_path, release

SPLIT_ROWS = 10_000  # rows that MLlib looks at for candidate splits
FILE_ROWS, SLICE_CELLS = 1 << 20, 1 << 21
HELD_BYTES = 128 << 20  # bootstraps in a task
KNOWN_CELLS = 1 << 20  # predictions a task remembers
PART_BYTES, PARTS_BYTES = 256 << 10, 32 << 20

_NAMES = ["tree", "node", "feature", "cut", "gain", "sums", "open"]
_GROWN = "tree int, " + ", ".join(f"{n} binary" for n in _NAMES[1:])


# ---- bins and cells ----------------------------------------------------------------------------------


def _splits(train: DataFrame, features: Sequence[str], rows: int, seed: int) -> list[np.ndarray]:
    """Splits of every feature from all rows, or from the about 10 000 that MLlib would draw."""
    spark, asked = train.sparkSession, train.select(*[quoted(n) for n in features])
    share = min(1.0, SPLIT_ROWS / rows)
    if share < 1:
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        drawn = asked._jdf.javaRDD().sample(False, share, draw)
        asked = DataFrame(spark._jsparkSession.createDataFrame(drawn, asked._jdf.schema()), spark)
    table = asked.toArrow()
    return [split_points(table.column(j).to_numpy(), share * rows, min(MAX_BINS, rows) - 1) for j in range(len(features))]


def _cell_names(features: Sequence[str]) -> list[str]:
    return [f"_cell{i}" for i in range(math.ceil(len(features) / IN_A_LONG))]


def _with_cells(df: DataFrame, features: Sequence[str], splits: Sequence[np.ndarray]) -> DataFrame:
    """Rows and their cells."""
    names = _cell_names(features)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = packed([batch.column(n).to_numpy(zero_copy_only=False) for n in features], splits)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cells)], [*batch.schema.names, *names])

    return df.mapInArrow(binned, T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


def _entries(train: DataFrame, features: Sequence[str], splits: Sequence[np.ndarray]) -> tuple[DataFrame, list[str]]:
    """A staged table of (cell, label, n), each file sorted by cell, and its files."""
    spark, names = train.sparkSession, _cell_names(features)
    rows = _with_cells(train.select("label", *[quoted(n) for n in features]), features, splits)
    counted = rows.groupBy(*names, "label").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions(*names, "label")
    path = new_folder(spark, "cells")
    counted.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    table = spark.read.schema(counted.schema).parquet(path)
    table.staged_path = path
    store, root = open_path(path)
    found = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".parquet"))
    return table, [f"{path}/{name}" for name in found]


def _tasks(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, n)


def _sizes(spark: SparkSession, plan: Plan) -> list[int]:
    """Entries that a bootstrap keeps of each file."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for batch in batches for i in batch.column(0).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([len(entries(plan.files[i], plan)[3])], pa.int64())], ["file", "n"])

    return [n for _, n in sorted(tuple(r) for r in _tasks(spark, len(plan.files)).mapInArrow(counted, "file long, n long").collect())]


def _slices(sizes: Sequence[int], cells: int) -> list[list[int]]:
    """Files beside each other that hold ``cells`` together at most; a larger one is a slice of its own."""
    made, held = [[]], 0
    for i, n in enumerate(sizes):
        if made[-1] and held + n > cells:
            made.append([])
            held = 0
        made[-1].append(i)
        held += n
    return made


# ---- growing -----------------------------------------------------------------------------------------


def _row(tree: Tree, node: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tree.number], pa.int32()), *(pa.array([v], pa.binary()) for v in tree.known(node))], _NAMES)


def _blocks(spark: SparkSession, plan: Plan, slices: int, cells: int) -> list[range]:
    """Trees whose bootstraps a task holds: as few as keep all cores at work, and as fit."""
    wanted = max(1, math.ceil(spark.sparkContext.defaultParallelism / slices))
    step = max(1, min(math.ceil(plan.trees / wanted), HELD_BYTES // (8 * plan.kept * max(1, cells))))
    return [range(i, min(i + step, plan.trees)) for i in range(0, plan.trees, step)]


def _grow(table: DataFrame, plan: Plan, slice_cells: int) -> list[Tree]:
    spark = table.sparkSession
    cells = table.count() if plan.classes else table.drop("label", "n").distinct().count()
    slices = [list(range(len(plan.files)))]
    if cells > slice_cells:
        sizes = _sizes(spark, plan)
        slices = _slices(sizes, slice_cells)
        cells = max(sum(sizes[i] for i in s) for s in slices)
    blocks = _blocks(spark, plan, len(slices), cells)
    trees = [Tree(plan, i) for i in range(plan.trees)]
    if len(slices) > 1:
        for level in range(plan.depth):
            if any(len(t.active(level)) for t in trees):
                _grow_level(spark, plan, slices, blocks, trees, level)
        return trees

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for batch in batches for b in batch.column(0).to_pylist()):
            for tree in grown(plan, slices[0], blocks[b]):
                yield _row(tree)

    for number, *known in _tasks(spark, len(blocks)).mapInArrow(whole, _GROWN).collect():  # nodes of the model
        trees[number].learn(known)
    return trees


def _grow_level(spark: SparkSession, plan: Plan, slices: Sequence[Sequence[int]], blocks: Sequence[range], trees: Sequence[Tree], level: int) -> None:
    """Split the nodes of a level in all trees."""
    node_bytes = 8 * plan.chosen * plan.bins * plan.stats
    step = max(1, PART_BYTES // node_bytes)  # nodes in a part
    active = {t.number: len(t.active(level)) for t in trees}
    parts = math.ceil(sum(active.values()) * node_bytes * len(slices) / PARTS_BYTES)
    here = slice((1 << level) - 1, (2 << level) - 1)
    known = {t.number: (t.feature, t.cut, t.open, t.sums[here]) for t in trees if active[t.number]}

    def tree_of(number: int) -> Tree:
        tree = Tree(plan, number)
        tree.feature, tree.cut, tree.open = (v.copy() for v in known[number][:3])
        tree.sums[here] = known[number][3]
        return tree

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (b for batch in batches for b in batch.column(0).to_pylist()):
            numbers = [n for n in blocks[task % len(blocks)] if n in known]
            made = Bootstraps(plan, slices[task // len(blocks)], numbers)
            for number in numbers:
                tree, drawn = tree_of(number), made.take(number)
                sums = drawn.histogram(tree, level, drawn.routed(tree, level))
                first = range(0, len(sums), step)
                values = [sums[i : i + step].tobytes() for i in first]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(first), pa.int32()), pa.array(first, pa.int32()), pa.array(values, pa.binary())], ["tree", "first", "sums"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for number, first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                sums = np.frombuffer(raw.as_buffer()).reshape(-1, plan.chosen, plan.bins, plan.stats)
                totals[number, first] = totals[number, first] + sums if (number, first) in totals else sums.copy()
        for (number, first), sums in totals.items():
            tree = tree_of(number)
            at = tree.active(level)[first : first + len(sums)]
            tree.split(plan, level, at, sums)
            node = (1 << level) - 1 + at
            yield _row(tree, np.concatenate([node, 2 * node + 1, 2 * node + 2]))

    sums = _tasks(spark, len(slices) * len(blocks)).mapInArrow(added, "tree int, first int, sums binary")
    for number, *found in sums.repartition(max(1, parts), "tree", "first").mapInArrow(chosen, _GROWN).collect():
        trees[number].learn(found)


# ---- the fitted forest --------------------------------------------------------------------------------


class TreesModel:
    def __init__(self, features: Sequence[str], splits: Sequence[np.ndarray], trees: Ensemble):
        self.names, self.splits, self.trees, self.importances = list(features), splits, trees, trees.importances

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows with ``prediction``, of classes also with ``probability``. A cell is predicted once in a task."""
        names, splits, trees = self.names, self.splits, self.trees
        added = ["_shares", "prediction"] if trees.shares else ["prediction"]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, found = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                cells = packed([batch.column(n).to_numpy(zero_copy_only=False) for n in names], splits)
                cell, first, place = np.unique(one_key(cells), return_index=True, return_inverse=True)
                if known is None or len(known) + len(cell) > KNOWN_CELLS:
                    known, found = cell[:0], np.empty((0, trees.values.shape[2]))
                at = np.searchsorted(known, cell)
                new = at == len(known)
                new[~new] = known[at[~new]] != cell[~new]
                if new.any():
                    made = trees.of(unpacked([c[first[new]] for c in cells], len(names)))
                    known, found = np.insert(known, at[new], cell[new]), np.insert(found, at[new], made, axis=0)
                value = found[np.searchsorted(known, cell)][place.ravel()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *_predictions(trees, value)], [*batch.schema.names, *added])

        kinds = {"_shares": T.ArrayType(T.DoubleType()), "prediction": T.DoubleType()}
        out = df.mapInArrow(scored, T.StructType([*df.schema.fields, *(T.StructField(n, kinds[n]) for n in added)]))
        return out.select(*[quoted(c) for c in df.columns], array_to_vector("_shares").alias("probability"), "prediction") if trees.shares else out


def _predictions(trees: Ensemble, value: np.ndarray) -> list[pa.Array]:
    shares, prediction = trees.outcome(value)
    if shares is None:
        return [pa.array(prediction)]
    ends = np.arange(0, shares.size + 1, shares.shape[1], dtype=np.int32)
    return [pa.ListArray.from_arrays(ends, shares.ravel()), pa.array(prediction)]


def _bins(splits: Sequence[np.ndarray]) -> int:
    return max(2, 1 + max(map(len, splits)))


@dataclass(frozen=True)
class Forest:
    """A random forest of classes 0, 1, … or, without ``classes``, of numbers.

    Nodes look at as many features as the square root of their number says for classes, at all for numbers.
    """

    classes: bool
    trees: int
    depth: int
    seed: int
    slice_cells: int = SLICE_CELLS

    def fit(self, train: DataFrame, features: Sequence[str]) -> TreesModel:
        strange = F.isnan("label") | F.col("label").isin(float("inf"), float("-inf"))
        rows, top, bad = train.agg(F.count(F.lit(1)), F.max("label"), F.count(F.when(strange, 1))).first()
        if bad:
            raise ValueError("labels must not be NaN or infinite")
        splits = _splits(train, features, rows, self.seed)
        table, files = _entries(train, features, splits)
        plan = Plan(
            features=len(features), bins=_bins(splits), classes=max(2, int(top) + 1) if self.classes else 0,
            chosen=math.ceil(math.sqrt(len(features))) if self.classes else len(features),
            trees=self.trees, depth=self.depth, seed=self.seed, files=files,
        )
        trees = _grow(table, plan, self.slice_cells)
        release(table)
        return TreesModel(features, splits, Ensemble(plan, trees))


class BoostedModel:
    def __init__(self, model, features: Sequence[str], splits: Sequence[np.ndarray]):
        self.model, self.names, self.splits, self.importances = model, list(features), splits, model.featureImportances.toArray()

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(_bin_vectors(_with_cells(df, self.names, self.splits), self.names))
        return scored.drop(*_cell_names(self.names))


def _bin_vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Bins from 1 on as ``features``; MLlib counts zeros in a way of its own."""
    names = [f"_bin{j}" for j in range(len(features))]
    bins = [
        (F.shiftright(f"_cell{j // IN_A_LONG}", BIN_BITS * (j % IN_A_LONG)).bitwiseAND((1 << BIN_BITS) - 1) + 1).cast("double").alias(n)
        for j, n in enumerate(names)
    ]
    return VectorAssembler(inputCols=names, outputCol="features").transform(df.select("*", *bins)).drop(*names)


@dataclass(frozen=True)
class Boosted:
    """Gradient boosting of two classes."""

    rounds: int
    depth: int
    step: float
    seed: int
    slice_cells: int = SLICE_CELLS

    def fit(self, train: DataFrame, features: Sequence[str]) -> TreesModel | BoostedModel:
        splits = _splits(train, features, train.count(), self.seed)
        table, files = _entries(train, features, splits)
        if table.drop("label", "n").distinct().count() > self.slice_cells:
            model = self._by_rows(table, features, splits)
            release(table)
            return model
        plan = Plan(
            features=len(features), bins=_bins(splits), classes=0, chosen=len(features), trees=self.rounds, depth=self.depth, seed=self.seed, files=files,
        )
        trees, step = [Tree(plan, i) for i in range(self.rounds)], self.step

        def grown_in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in (i for batch in batches for i in batch.column(0)):
                yield from map(_row, boosted(plan, step))

        for number, *known in _tasks(train.sparkSession, 1).mapInArrow(grown_in_turn, _GROWN).collect():  # nodes of the model
            trees[number].learn(known)
        release(table)
        return TreesModel(features, splits, Ensemble(plan, trees, [1.0] + [step] * (self.rounds - 1)))

    def _by_rows(self, table: DataFrame, features: Sequence[str], splits: Sequence[np.ndarray]) -> BoostedModel:
        # So many bins that MLlib looks at all entries and keeps the bins they have.
        bins = max(2 * MAX_BINS, math.ceil(math.sqrt(table.count())))
        boosted = GBTClassifier(
            labelCol="label", featuresCol="features", weightCol="n", maxIter=self.rounds, maxDepth=self.depth, stepSize=self.step, seed=self.seed,
            maxMemoryInMB=1024, maxBins=bins,
        )
        return BoostedModel(boosted.fit(_bin_vectors(table, features)), features, splits)
