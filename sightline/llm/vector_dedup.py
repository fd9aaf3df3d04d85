"""Embedding near-duplicates: randomised-rotation binary codes, bounds, exact recomputation.

Equal vectors are one row with a weight.  The vectors of a label live in cells around pivots, which are a
bounded sample of its vectors; a vector is also sent to each cell whose border with its own is near enough for a
partner to lie beyond it.  Inside a cell a vector has a code: the signs of its rotated, normalised distance from
the pivot, and two stored numbers, the length of that distance and the correction factor (the product of the
normalised distance and its code).  Sign code and factor give an unbiased estimate of the inner product with
any other vector, and a bound that holds with the confidence asked for.  A pair whose upper bound is below the
threshold is dropped; every other pair is computed exactly, in double precision.

Cells with many vectors are compared in tiles.  A tile gives, per vector, a weighted number of links and the least
vector it is connected to, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.components import connected_components
from sightline.llm.salting import join_to_rows
from sightline.session import materialise

#: Pivots of all labels together, in expectation: what is broadcast does not grow beyond them.
MOST_PIVOTS = 1 << 16


@dataclass(frozen=True)
class Search:
    """Parameters of the search.

    ``cell`` vectors share a pivot, on average, until the pivots number ``MOST_PIVOTS``; then cells grow.
    ``spread`` is the number of standard deviations, of the part of a difference across a border, that the
    search covers; a value of the square root of the dimension or more loses no pair at all.  ``confidence`` is
    the same for estimates by codes.  ``tile`` vectors are compared with as many others at a time.
    """

    threshold: float = 0.93
    cell: int = 4096
    spread: float = 4.0
    confidence: float = 4.0
    tile: int = 8192
    seed: int = 12

    def margin(self, dims: int) -> float:
        """Largest distance from a border at which a vector is sent across."""
        chord = math.sqrt(max(0.0, 2 - 2 * self.threshold))
        return chord / 2 * min(1.0, self.spread / math.sqrt(dims)) + 1e-6


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors.astype(np.float64)
    scaled /= np.abs(scaled).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(units: np.ndarray, pivot: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, distance from the pivot, correction factor) of each vector."""
    dims = units.shape[1]
    apart = units - pivot
    radius = np.linalg.norm(apart, axis=1)
    turned = apart @ rotation(dims, seed).T
    factor = np.abs(turned).sum(axis=1) / math.sqrt(dims) / np.where(radius > 0, radius, 1)
    return np.packbits(turned > 0, axis=1), radius, np.where(radius > 0, factor, 1.0)


class Codes:
    """Stored codes, to be compared with vectors that are known in full."""

    def __init__(self, signs: np.ndarray, radius: np.ndarray, factor: np.ndarray, dims: int, confidence: float):
        self.signs = np.unpackbits(signs, axis=1, count=dims).astype(np.float32) * 2 - 1
        self.scale = radius / (factor * math.sqrt(dims))
        self.error = radius * np.sqrt(np.maximum(0, 1 - factor**2)) / factor * confidence / math.sqrt(max(1, dims - 1))

    def estimate(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated products with rotated vectors (one per row), and how far the truth may lie from them."""
        return (turned.astype(np.float32) @ self.signs.T) * self.scale, np.linalg.norm(turned, axis=1)[:, None] * self.error


def route(units: np.ndarray, pivots: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each vector, row and cell of each further sending): cells whose border is within ``margin``."""
    home = np.empty(len(units), np.int64)
    rows, cells = [], []
    step = max(1, (1 << 23) // len(pivots))
    for at in range(0, len(units), step):
        scores = units[at : at + step] @ pivots.T
        own = scores.argmax(axis=1)
        best = scores[np.arange(len(own)), own]
        home[at : at + step] = own
        row, cell = np.nonzero(best[:, None] - scores <= 2 * margin)  # two pivots are at most 2 apart
        other = own[row] != cell
        row, cell = row[other], cell[other]
        apart = np.linalg.norm(pivots[own[row]] - pivots[cell], axis=1)
        near = best[row] - scores[row, cell] <= margin * apart
        rows.append(row[near] + at)
        cells.append(cell[near])
    return home, np.concatenate(rows), np.concatenate(cells)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of ``a[k]`` and ``b[k]`` for all k; a class is named by its least place."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


@dataclass
class Tile:
    """Rows of two tiles of a cell (or of one, twice); homes come first."""

    units: np.ndarray
    homes: int
    second: np.ndarray  # whether a row is of the second tile
    codes: Codes
    pivot: np.ndarray
    met: np.ndarray  # home row * cells + cell, ascending: the further cells of the homes
    home_cell: np.ndarray
    cell: int
    cells: int

    def links(self, search: Search, two: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(home, other) rows of the pairs at the threshold, each pair of the cell once, in pieces."""
        seed, n, floor = search.seed, len(self.units), search.threshold
        turned = (self.units[: self.homes] - self.pivot) @ rotation(self.units.shape[1], seed).T
        along = self.units @ self.pivot
        rest = along - self.pivot @ self.pivot
        place = np.arange(n)
        for at in range(0, self.homes, 256):
            mine = place[at : min(at + 256, self.homes)]
            found, error = self.codes.estimate(turned[mine])
            open_ = found + error + along[mine, None] + rest >= floor - 1e-5
            if two:  # two homes meet once, seen from the first tile; a sent vector meets the homes of the other tile
                open_ &= (self.second[mine, None] != self.second) & ((place >= self.homes) | ~self.second[mine, None])
            else:
                open_ &= (place >= self.homes) | (place > mine[:, None])
            row, other = np.nonzero(open_)
            if len(row) * 8 > open_.size:
                exact = (self.units[mine] @ self.units.T)[row, other]
            else:
                exact = np.concatenate([
                    np.einsum("ij,ij->i", self.units[mine[row[k : k + 65536]]], self.units[other[k : k + 65536]])
                    for k in range(0, len(row), 65536)
                ] or [np.zeros(0)])
            close = exact >= floor
            row, other = mine[row[close]], other[close]
            # a pair of two cells that both were sent across counts in the lower one
            lower = (self.home_cell[other] < self.cell) & np.isin(row * self.cells + self.home_cell[other], self.met)
            yield row[~lower], other[~lower]


def _flat(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column as a matrix."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _is_vector(v: Column) -> Column:
    """Whether a list is neither null nor empty nor zero, and all its components are finite."""
    infinite = F.lit(float("inf"))
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists(v, lambda x: x != 0), F.lit(False))


def _pivots(distinct: DataFrame, search: Search) -> dict[tuple, np.ndarray]:
    """Pivots of each (label, dims) with more than one cell: a uniform sample of its vectors, by a hash of the key."""
    total = distinct.count()
    cell = max(search.cell, math.ceil(total / MOST_PIVOTS))
    sizes = distinct.groupBy("label", "dims").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    share = F.pmod(F.xxhash64(F.lit(search.seed), F.col("key")), F.lit(1 << 30)) / float(1 << 30)
    picked = distinct.join(sizes.select("label", "dims"), ["label", "dims"]).where(share < 1.0 / cell).select("label", "dims", "vec").toArrow()
    found: dict[tuple, list] = {}
    for row in picked.to_pylist():
        found.setdefault((row["label"], row["dims"]), []).append(row["vec"])
    return {key: unit(np.array(rows)) for key, rows in found.items() if len(rows) > 1}


def _placed(distinct: DataFrame, pivots, search: Search) -> DataFrame:
    """One row for each vector and cell that it lives in or is sent to, with its code there."""
    kinds = {f.name: f.dataType for f in distinct.schema}
    schema = T.StructType([
        T.StructField("label", kinds["label"]), T.StructField("dims", T.IntegerType()), T.StructField("cell", T.IntegerType()),
        T.StructField("key", T.LongType()), T.StructField("m", T.LongType()), T.StructField("home_cell", T.IntegerType()),
        T.StructField("sent_to", T.ArrayType(T.IntegerType())), T.StructField("vec", kinds["vec"]), T.StructField("signs", T.BinaryType()),
        T.StructField("radius", T.DoubleType()), T.StructField("factor", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("dims").to_pylist())):
                groups.setdefault(key, []).append(i)
            for (label, dims), places in groups.items():
                part = batch.take(pa.array(places))
                units = unit(_flat(part.column("vec"), dims))
                centres = pivots.value.get((label, dims), np.zeros((1, dims)))
                if len(centres) == 1:
                    home, row, cell = np.zeros(len(units), np.int64), *np.zeros((2, 0), np.int64)
                else:
                    home, row, cell = route(units, centres, search.margin(dims))
                offsets = np.concatenate([np.searchsorted(row, np.arange(len(units) + 1)), np.full(len(row), len(row))])
                sent = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cell, pa.int32()))
                row, cell = np.concatenate([np.arange(len(units)), row]), np.concatenate([home, cell])
                signs, radius, factor = encode(units[row], centres[cell], search.seed)
                all_rows = part.take(pa.array(row))
                columns = [
                    all_rows.column("label"), all_rows.column("dims"), pa.array(cell, pa.int32()), all_rows.column("key"), all_rows.column("m"),
                    pa.array(home[row], pa.int32()), sent, all_rows.column("vec"), pa.array([s.tobytes() for s in signs], pa.binary()),
                    pa.array(radius), pa.array(factor),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return distinct.mapInArrow(run, schema)


def _compared(placed: DataFrame, pivots, search: Search) -> DataFrame:
    """(key, links, root): for each vector and tile with links, their weighted number and the least key reached."""
    sizes = placed.groupBy("label", "dims", "cell").agg(F.count("*").alias("n"))
    tiles = F.ceil(F.col("n") / search.tile).cast("int")
    own = F.pmod(F.xxhash64(F.lit("tile"), F.col("key")), tiles).cast("int")
    dealt = placed.join(sizes, ["label", "dims", "cell"]).select(
        "*", own.alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
    )
    pairs = dealt.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other")).drop("n", "other")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        label, dims, cell, lo, hi = (rows.column(c)[0].as_py() for c in ("label", "dims", "cell", "lo", "hi"))
        numbers = {c: rows.column(c).to_numpy() for c in ("key", "m", "home_cell", "tile")}
        away = numbers["home_cell"] != cell
        order = np.lexsort([numbers["key"], away])
        rows, numbers = rows.take(pa.array(order)), {c: v[order] for c, v in numbers.items()}
        centres = pivots.value.get((label, dims), np.zeros((1, dims)))
        sent = rows.column("sent_to").combine_chunks()
        owner = np.repeat(np.arange(len(sent)), np.diff(sent.offsets.to_numpy()))
        signs = np.frombuffer(b"".join(rows.column("signs").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        codes = Codes(signs, rows.column("radius").to_numpy(), rows.column("factor").to_numpy(), dims, search.confidence)
        tile = Tile(
            units=unit(_flat(rows.column("vec"), dims)), homes=int((~away).sum()), second=numbers["tile"] == hi, codes=codes, pivot=centres[cell],
            met=owner * len(centres) + sent.flatten().to_numpy(), home_cell=numbers["home_cell"], cell=cell, cells=len(centres),
        )
        key, weight = numbers["key"], numbers["m"]
        count, group = np.zeros(len(key), np.int64), np.arange(len(key))
        for a, b in tile.links(search, two=lo != hi):
            np.add.at(count, a, weight[b])
            np.add.at(count, b, weight[a])
            group = merge(group, a, b)
        least = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(least, group, key)
        some = count > 0
        return pa.table([pa.array(key[some]), pa.array(count[some]), pa.array(least[group][some])], names=["key", "links", "root"])

    return pairs.groupBy("label", "dims", "cell", "lo", "hi").applyInArrow(compare, "key long, links long, root long")


def near_duplicate_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", search: Search = Search(),
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: near-duplicate vectors among those with one label.

    Two vectors link if their cosine, in double precision, is at least the threshold, their labels are equal and
    their lengths too.  ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is
    the smallest id reachable, the row's own included; ``kept`` says that it names its component.  Vectors that
    are null, empty, zero or hold null or non-finite components, and rows without label, link with nothing and
    are kept.  A null id never names a component unless all its ids are null; rows that share the smallest id are
    all kept.  Other columns are ignored.  Equal vectors are known by 128 bits of hash.

    Every link found is exact.  With the default ``spread`` and ``confidence`` a pair is missed with a
    probability below 0.0002 each, in labels of more than ``cell`` vectors for the first.
    """
    v = F.col(vector_column)
    valid = _is_vector(v) & F.col(label_column).isNotNull()
    rows = vectors.select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"), v.alias("vec"), valid.alias("valid"),
        F.xxhash64(F.col(label_column), v).alias("h1"), F.xxhash64(F.lit("second"), F.col(label_column), v).alias("h2"),
    )
    linkable = rows.where("valid")
    grouped = linkable.groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("id").alias("least"), F.count("*").alias("m")
    )
    numbered = grouped.withColumn("dims", F.size("vec")).withColumn("key", F.monotonically_increasing_id())
    distinct = materialise(numbered, "distinct_vectors")
    pivots = vectors.sparkSession.sparkContext.broadcast(_pivots(distinct, search))
    placed = materialise(_placed(distinct, pivots, search), "placed_vectors")
    compared = materialise(_compared(placed, pivots, search), "vector_links")
    counts = compared.groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected_components(compared.select(F.col("key").alias("a"), F.col("root").alias("b")))
    narrow = distinct.select("h1", "h2", "key", "least", "m")
    linked = narrow.join(roots, F.col("key") == F.col("node")).select("key", "root", "least")
    named = linked.groupBy("root").agg(F.min("least").alias("named"))
    component = linked.join(named, "root").select("key", "named")
    results = narrow.join(counts, "key", "left").join(component, "key", "left").select(
        "h1", "h2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("named", "least").alias("component_id")
    )
    found = join_to_rows(linkable.select("id", "h1", "h2"), materialise(results, "vector_results"), ["h1", "h2"], "id")
    alone = rows.where("NOT valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.select("id", "n_links", "component_id").union(alone).select(
        F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
