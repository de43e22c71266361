"""Boosted trees by second-order histograms: gradient and curvature are summed by (node, column, bin), a level at a time.

Features become bin codes once; the coded table is stored and serves all labels, folds and parameters. One aggregation a
level serves the open nodes of all models: each task sums its rows by node, column and bin, sums meet by (node, column), and
the best split of each is found where they meet. The driver sees one row a node and partition, never rows of the table.

Numbers split at a cut, and rows without a value go to the side that gains more; where a node saw none, to the larger
side. Texts split one value from the rest, null being a value. NaN counts as null. Gradients are summed as integers of 2**-26, so
the trees do not depend on how rows are partitioned, nor on a task's second run. Rows and columns are sampled by tree: rows
by a hash of the row's key, columns (of a text: its values) by the seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.quantiles import quantiles
from cairn.functions.stored import stored
from cairn.operators.clean import quoted

#: Gradients are integers of this part of one.
UNIT = 1 << 26
#: Sums of one pass (bytes a task); nodes beyond it wait for another pass over the stored table.
SUMS = 32 << 20
#: Margins are stored after so many trees, so that tasks apply at most these.
STORE = 16
_BEST = "slot long, col int, gain double, bin int, null_left boolean, gl long, hl long, nl long, g long, h long, n long"
_SUMS = "slot long, col int, sums binary"


@dataclass(frozen=True)
class Settings:
    """How a model grows. columns and subsample are shares by tree; bins bound a number's cuts and a text's values."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.08
    subsample: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    min_weight: float = 1.0
    min_rows: int = 1
    seed: int = 42


@dataclass(frozen=True)
class Bins:
    """Cuts of numbers (a value up to a cut is left of it) and values of texts; a text's other values share its last code but one."""

    columns: tuple[str, ...]
    cuts: Mapping[str, tuple[float, ...]]
    values: Mapping[str, tuple[str, ...]]

    @property
    def sizes(self) -> list[int]:
        """Codes of each column, without the one for null, which is the size itself."""
        return [len(self.cuts.get(c, self.values.get(c, ()))) + 1 for c in self.columns]

    @property
    def text(self) -> list[bool]:
        return [c in self.values for c in self.columns]

    def code(self, i: int, column: pa.Array) -> np.ndarray:
        name, size = self.columns[i], self.sizes[i]
        if name in self.values:
            found = pc.fill_null(pc.index_in(column, value_set=pa.array(self.values[name], pa.string())), size - 1).to_numpy()
            return np.where(column.is_null().to_numpy(zero_copy_only=False), size, found).astype(np.int16)
        v = pc.fill_null(column, float("nan")).to_numpy(zero_copy_only=False)
        return np.where(np.isnan(v), size, np.searchsorted(np.array(self.cuts[name]), v, side="left")).astype(np.int16)

    def apply(self, df: DataFrame, keep: Sequence[Column]) -> DataFrame:
        """keep and _codes, a short for each feature."""
        kinds = dict(df.dtypes)
        given = [quoted(c).cast("string" if c in self.values else "double").alias(f"_x{i}") if c in kinds else F.lit(None).cast("string" if c in self.values else "double").alias(f"_x{i}") for i, c in enumerate(self.columns)]
        rows = df.select(*keep, *given)
        kept = rows.columns[: len(rows.columns) - len(given)]
        width = len(given)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = np.stack([self.code(i, b.column(len(kept) + i)) for i in range(width)], axis=1)
                ends = pa.array(np.arange(0, codes.size + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], names=[*kept, "_codes"])

        schema = rows.select(*[quoted(c) for c in kept], F.lit(None).cast("array<smallint>").alias("_codes")).schema
        return rows.mapInArrow(run, schema)


def learn_bins(df: DataFrame, columns: Sequence[str], bins: int = 256) -> Bins:
    """Cuts at a number's values where they are at most bins, at its exact quantiles otherwise; a text's bins most frequent values.

    Looks at the data: by selection for numbers, by a count of values for texts, of which at most bins a column return.
    """
    kinds = dict(df.dtypes)
    text = [c for c in columns if kinds[c] == "string"]
    real = {c: F.when(~F.isnan(quoted(c).cast("double")), quoted(c).cast("double")) for c in columns if c not in text}
    cuts: dict[str, tuple[float, ...]] = {}
    if real:
        found = quantiles(df, real, [i / bins for i in range(bins + 1)], different=bins + 1)
        ends = {c: found[None, c].at for c in real}
        # At most bins values of a column return: of those that have no more.
        small = [c for c in real if 0 < found[None, c].different <= bins]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), real[c].alias("v")) for c in small])) if small else None
        exact = {r["c"]: r["v"] for r in df.select(pairs.alias("x")).select("x.*").where("v is not null").groupBy("c").agg(F.sort_array(F.collect_set("v")).alias("v")).collect()} if small else {}
        for c in real:
            each = exact.get(c) or sorted({v for v in ends[c].values() if v is not None})
            cuts[c] = tuple(float(v) for v in each[:-1])
    values: dict[str, tuple[str, ...]] = {c: () for c in text}
    if text:
        from pyspark.sql import Window

        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), quoted(c).alias("v")) for c in text]))
        counts = df.select(pairs.alias("x")).select("x.*").where("v is not null").groupBy("c", "v").count()
        top = counts.withColumn("_r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("count"), "v"))).where(F.col("_r") <= bins)
        for r in top.groupBy("c").agg(F.sort_array(F.collect_list("v")).alias("v")).collect():
            values[r["c"]] = tuple(r["v"])
    return Bins(tuple(columns), cuts, values)


@dataclass
class Tree:
    """Nodes as lists: column (-1: a leaf), bin, side of nulls, children, and the leaf's value."""

    col: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    null_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for name, v in (("col", -1), ("bin", 0), ("null_left", False), ("left", 0), ("right", 0), ("value", 0.0)):
            getattr(self, name).append(v)
        return len(self.col) - 1

    def nodes(self, codes: np.ndarray, sizes: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The leaf (or open node) of each row of codes."""
        col, at, null_left, left, right = (np.array(x) for x in (self.col, self.bin, self.null_left, self.left, self.right))
        node = np.zeros(len(codes), dtype=np.int64)
        moving = np.arange(len(codes)) if col[0] >= 0 else np.zeros(0, dtype=np.int64)
        while len(moving):
            here = node[moving]
            c = col[here]
            code = codes[moving, c]
            goes = np.where(text[c], code == at[here], np.where(code == sizes[c], null_left[here], code <= at[here]))
            node[moving] = np.where(goes, left[here], right[here])
            moving = moving[col[node[moving]] >= 0]
        return node

    def values(self, codes: np.ndarray, sizes: np.ndarray, text: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(codes, sizes, text)]


def _codes(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("_codes")).flatten().to_numpy().reshape(-1, width)


@dataclass
class Boosted:
    """A fitted model: margins are start plus the values of all trees."""

    bins: Bins
    start: float
    trees: list[Tree]

    def probability(self, frame: DataFrame, keep: Sequence[str]) -> DataFrame:
        """keep and the probability of 1; columns that frame lacks are null throughout."""
        names = [f"_k{i}" for i in range(len(keep))]
        coded = self.bins.apply(frame, [quoted(c).alias(n) for c, n in zip(keep, names)])
        width, sizes, text = len(self.bins.columns), np.array(self.bins.sizes), np.array(self.bins.text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = _codes(b, width)
                margin = np.full(len(codes), self.start)
                for t in self.trees:
                    margin += t.values(codes, sizes, text)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(_sigmoid(margin))], names=[*names, "probability"])

        schema = coded.select(*names, F.lit(0.0).alias("probability")).schema
        scored = coded.mapInArrow(run, schema)
        return scored.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "probability")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


@dataclass(frozen=True)
class Model:
    """What to fit: a 0/1 label, the fold that is left out of the fit (None: all rows count), and how."""

    label: str
    fold: int | None = None
    settings: Settings = Settings()


def _hash(key: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) of each key, another one for each seed."""
    x = key.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


@dataclass
class _Growing:
    """A model while it grows: trees since margins were stored, the tree that grows, and its open nodes with their sums."""

    what: Model
    label: int
    start: float
    recent: list[Tree] = field(default_factory=list)
    tree: Tree | None = None
    number: int = 0
    open: dict[int, tuple[int, int, int] | None] = field(default_factory=dict)
    allowed: list[np.ndarray] = field(default_factory=list)


def _allowed(sizes: Sequence[int], text: Sequence[bool], share: float, seed: int, tree: int) -> list[np.ndarray]:
    """By column, which of its bins may split in this tree: all or none of a number, a text's values one by one; at least one in all."""
    owners = [(c, k) for c, (n, t) in enumerate(zip(sizes, text)) for k in (range(n + 1) if t else [None])]
    take = max(1, round(share * len(owners)))
    order = np.argsort(_hash(np.arange(len(owners), dtype=np.int64) + (tree << 32), seed), kind="stable") if take < len(owners) else np.arange(len(owners))
    out = [np.zeros(n + 1, dtype=bool) for n in sizes]
    for i in order[:take]:
        c, k = owners[i]
        out[c][slice(None) if k is None else k] = True
    return out


def _best(sums: np.ndarray, text: bool, allowed: np.ndarray, s: Settings) -> tuple:
    """(gain, bin, null_left, gl, hl, nl, g, h, n) of a column's sums by bin, the last of which is null."""
    g, h, n = sums
    total = tuple(int(x.sum()) for x in sums)
    last = len(g) - 1
    if text:
        left = sums[None]
        ok = allowed[None]
    else:
        right_null = np.cumsum(sums[:, :last], axis=1)
        left_null = right_null + sums[:, last:]
        left = np.stack([right_null, left_null])
        ok = np.broadcast_to(allowed[:last], (2, last))
    gl, hl, nl = (left[:, i].astype(np.float64) / (1 if i == 2 else UNIT) for i in range(3))
    gt, ht, nt = total[0] / UNIT, total[1] / UNIT, total[2]
    gr, hr, nr = gt - gl, ht - hl, nt - nl

    def part(a, b):
        return np.divide(a * a, b + s.l2, out=np.zeros_like(a), where=b + s.l2 > 0)

    gain = (part(gl, hl) + part(gr, hr) - part(np.array([gt]), np.array([ht]))[0]) / 2
    least = max(1, s.min_rows)
    ok = ok & (nl >= least) & (nr >= least) & (hl >= s.min_weight) & (hr >= s.min_weight)
    gain = np.where(ok, gain, -math.inf)
    where = int(np.argmax(gain.T if not text else gain))
    side, at = (where % 2, where // 2) if not text else (0, where)
    chosen = left[side][:, at]
    null_left = bool(side) if n[last] else bool(chosen[2] * 2 >= total[2])
    return float(gain[side, at]), at, null_left, *(int(x) for x in chosen), *total


def _record(slots: list[int], cols: list[int], raw: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(cols, pa.int32()), pa.array(raw, pa.binary())], names=["slot", "col", "sums"])


def _level(table: DataFrame, models: Mapping[int, _Growing], nodes: Mapping[int, Sequence[int]], labels: Sequence[str], bins: Bins) -> list:
    """The best split of each node by partition (_BEST rows)."""
    sizes, text, width = np.array(bins.sizes), np.array(bins.text), len(bins.columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray | None]] = {}
        for b in batches:
            codes = _codes(b, width)
            key, fold = b.column("_key").to_numpy(), b.column("_fold").fill_null(-1).to_numpy()
            margins = b.column("_margins").flatten().to_numpy().reshape(len(codes), -1)
            y = [b.column(f"_y{i}").fill_null(-1).to_numpy() for i in range(len(labels))]
            for m, wanted in nodes.items():
                grow, s = models[m], models[m].what.settings
                use = y[grow.label] >= 0
                if grow.what.fold is not None:
                    use &= fold != grow.what.fold
                if s.subsample < 1:
                    use &= _hash(key, s.seed * 1_000_003 + grow.number) < s.subsample
                at = np.flatnonzero(use)
                if not len(at):
                    continue
                mine = codes[at]
                margin = margins[at, m]
                for t in grow.recent:
                    margin = margin + t.values(mine, sizes, text)
                place = np.full(len(grow.tree.col), -1, dtype=np.int64)
                place[list(wanted)] = np.arange(len(wanted))
                slot = place[grow.tree.nodes(mine, sizes, text)]
                here = slot >= 0
                slot, mine, p = slot[here], mine[here], _sigmoid(margin[here])
                each = (np.rint((p - y[grow.label][at][here]) * UNIT), np.rint(p * (1 - p) * UNIT), None)
                sums = held.setdefault(m, [np.zeros((len(wanted), 3, n + 1), dtype=np.int64) if a.any() else None for n, a in zip(sizes, grow.allowed)])
                for c in range(width):
                    if sums[c] is not None:
                        index = slot * (sizes[c] + 1) + mine[:, c]
                        for k, w in enumerate(each):
                            sums[c][:, k] += np.bincount(index, weights=w, minlength=len(wanted) * (sizes[c] + 1)).astype(np.int64).reshape(len(wanted), -1)
        slots, cols, raw, size = [], [], [], 0
        for m, sums in held.items():
            for c, found in enumerate(sums):
                if found is not None:
                    for i in np.flatnonzero(found[:, 2].any(axis=1)).tolist():
                        slots.append((m << 32) | nodes[m][i])
                        cols.append(c)
                        raw.append(found[i].tobytes())
                        size += len(raw[-1])
                if size > 4 << 20:
                    yield _record(slots, cols, raw)
                    slots, cols, raw, size = [], [], [], 0
        if slots:
            yield _record(slots, cols, raw)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for slot, c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                sums = np.frombuffer(raw.as_buffer(), dtype=np.int64).reshape(3, -1)
                held[slot, c] = held[slot, c] + sums if (slot, c) in held else sums.copy()
        best: dict[int, tuple] = {}
        for (slot, c), sums in sorted(held.items()):
            grow = models[slot >> 32]
            row = _best(sums, bool(text[c]), grow.allowed[c], grow.what.settings)
            if slot not in best or row[0] > best[slot][2]:
                best[slot] = (slot, c, *row)
        if best:
            names = [f.split()[0] for f in _BEST.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.bool_(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*best.values()), kinds)], names=names)

    return table.mapInArrow(count, _SUMS).repartition("slot", "col").mapInArrow(choose, _BEST).collect()


def _passes(models: Mapping[int, _Growing], cells: int) -> Iterator[dict[int, list[int]]]:
    """Open nodes in groups whose sums fit SUMS."""
    most, group, n = max(1, SUMS // (24 * cells)), {}, 0
    for m, grow in models.items():
        for node in grow.open:
            group.setdefault(m, []).append(node)
            n += 1
            if n == most:
                yield group
                group, n = {}, 0
    if group:
        yield group


def _grow(table: DataFrame, models: Mapping[int, _Growing], labels: Sequence[str], bins: Bins) -> None:
    """One more tree for each model, level by level, all in the same passes."""
    sizes, text = bins.sizes, bins.text
    for grow in models.values():
        s = grow.what.settings
        grow.tree, grow.open = Tree(), {0: None}
        grow.allowed = _allowed(sizes, text, s.columns, s.seed, grow.number)
    for level in range(max(1, max(g.what.settings.depth for g in models.values()))):
        best: dict[int, tuple] = {}
        for group in _passes(models, sum(sizes) + len(sizes)):
            for r in _level(table, models, group, labels, bins):
                if r["slot"] not in best or (-r["gain"], r["col"]) < (-best[r["slot"]]["gain"], best[r["slot"]]["col"]):
                    best[r["slot"]] = r
        for m, grow in models.items():
            s, t, following = grow.what.settings, grow.tree, {}
            leaf = lambda g, h, s=s: -s.rate * (g / UNIT) / (h / UNIT + s.l2) if h / UNIT + s.l2 > 0 else 0.0
            for node in grow.open:
                r = best.get((m << 32) | node)
                if r is None:
                    continue
                t.value[node] = leaf(r["g"], r["h"])
                if level < s.depth and r["gain"] > 1e-6:
                    t.col[node], t.bin[node], t.null_left[node] = r["col"], r["bin"], r["null_left"]
                    for side, g, h, n in (("left", r["gl"], r["hl"], r["nl"]), ("right", r["g"] - r["gl"], r["h"] - r["hl"], r["n"] - r["nl"])):
                        child = t.add()
                        getattr(t, side)[node] = child
                        t.value[child] = leaf(g, h)
                        # A side too small to be split again is a leaf without another look.
                        if level + 1 < s.depth and n >= 2 * max(1, s.min_rows) and h >= 2 * s.min_weight * UNIT:
                            following[child] = None
            grow.open = following
        if not any(g.open for g in models.values()):
            break
    for grow in models.values():
        grow.recent.append(grow.tree)
        grow.number += 1


def _moved(table: DataFrame, models: Sequence[_Growing], bins: Bins) -> DataFrame:
    """The table with the margins that recent trees give."""
    width, sizes, text = len(bins.columns), np.array(bins.sizes), np.array(bins.text)
    recent = [g.recent for g in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = _codes(b, width)
            i = b.schema.get_field_index("_margins")
            margins = b.column(i).flatten().to_numpy().reshape(len(codes), -1).copy()
            for m, trees in enumerate(recent):
                for t in trees:
                    margins[:, m] += t.values(codes, sizes, text)
            ends = pa.array(np.arange(0, margins.size + 1, margins.shape[1], dtype=np.int32))
            columns = list(b.columns)
            columns[i] = pa.ListArray.from_arrays(ends, pa.array(margins.ravel()))
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return table.mapInArrow(run, table.schema)


@dataclass
class Fitted:
    """Models in the order asked, and the coded table with each row's margins in _margins (after all trees, and by number of trees in snapshots)."""

    models: list[Boosted]
    table: DataFrame
    keep: list[str]
    what: list[Model]
    snapshots: dict[int, DataFrame]

    def _long(self, trees: int | None) -> DataFrame:
        table = self.table if trees is None else self.snapshots[trees]
        labels = list(dict.fromkeys(m.label for m in self.what))
        each = [F.struct(F.lit(i).alias("model"), F.col(f"_y{labels.index(m.label)}").alias("y"), (1 / (1 + F.exp(-F.col("_margins")[i]))).alias("probability"), (F.lit(False) if m.fold is None else F.coalesce(F.col("_fold") == m.fold, F.lit(False))).alias("left_out")) for i, m in enumerate(self.what)]
        return table.select(*[F.col(f"_k{i}") for i in range(len(self.keep))], "_fold", F.explode(F.array(*each)).alias("_x"))

    def _kept(self) -> list[Column]:
        return [F.col(f"_k{i}").alias(c) for i, c in enumerate(self.keep)]

    def probabilities(self, trees: int | None = None) -> DataFrame:
        """(keep columns, model, y, probability, left_out): a row for each row and model, by its place in the list; left_out: the model did not see the row's fold."""
        return self._long(trees).select(*self._kept(), "_x.*")

    def out_of_fold(self, trees: int | None = None) -> DataFrame:
        """(keep columns, fold, probability): of each row and model that left the row's fold out."""
        return self._long(trees).where("_x.left_out").select(*self._kept(), F.col("_fold").alias("fold"), F.col("_x.probability").alias("probability"))


def fit(frame: DataFrame, columns: Sequence[str], models: Sequence[Model], key: Sequence[str], fold: str | None = None, keep: Sequence[str] = (), bins: int = 256, known: Bins | None = None, snapshots: Sequence[int] = ()) -> Fitted:
    """Models over one coded table. key: columns that tell rows apart, for sampling them (equal keys are sampled together).

    Null labels take no part in their label's models, nor do rows of the fold that a model leaves out. A label of one
    class, or without rows, gives trees near zero and the share of its class. Shorter models are snapshots of longer ones: the margins
    after so many trees. bins: see learn_bins; known: bins learnt before. An empty table gives models without splits.
    """
    known = known or learn_bins(frame, columns, bins)
    labels = list(dict.fromkeys(m.label for m in models))
    y = [F.when(quoted(c).isNotNull(), (quoted(c) == 1).cast("int")).alias(f"_y{i}") for i, c in enumerate(labels)]
    kept = [quoted(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    base = known.apply(frame, [F.xxhash64(*[quoted(c) for c in key]).alias("_key"), (quoted(fold) if fold else F.lit(None)).cast("int").alias("_fold"), *y, *kept])
    base = stored(base, "coded")
    # A row of counts for each fold: starts are log-odds of the rows that a model sees.
    counts = {r["_fold"]: r for r in base.groupBy("_fold").agg(*[f(f"_y{i}").alias(f"{k}{i}") for i in range(len(labels)) for k, f in (("n", F.count), ("p", F.sum))]).collect()}
    growing = []
    for m in models:
        i = labels.index(m.label)
        seen = [r for f, r in counts.items() if m.fold is None or f != m.fold]
        n, p = sum(r[f"n{i}"] for r in seen), sum(r[f"p{i}"] or 0 for r in seen)
        share = min(max(p / n if n else 0.5, 1e-6), 1 - 1e-6)
        growing.append(_Growing(m, i, math.log(share / (1 - share))))
    table = base.withColumn("_margins", F.array(*[F.lit(g.start) for g in growing]))
    done: list[list[Tree]] = [[] for _ in models]
    kept_at: dict[int, DataFrame] = {}
    last = max((m.settings.trees for m in models), default=0)
    for number in range(1, last + 1):
        _grow(table, {i: g for i, g in enumerate(growing) if g.what.settings.trees >= number}, labels, known)
        if number % STORE == 0 or number == last or number in snapshots:
            table = stored(_moved(table, growing, known), "margins")
            for trees, g in zip(done, growing):
                trees.extend(g.recent)
                g.recent = []
        if number in snapshots:
            kept_at[number] = table
    return Fitted([Boosted(known, g.start, t) for g, t in zip(growing, done)], table, list(keep), list(models), kept_at)
