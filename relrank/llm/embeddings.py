"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors are normalised in double precision and quantised to one byte per component, x = scale * codes + rest. For two
unit vectors the product of the quantised ones is off by at most |rest_x| + |rest_y| * (1 + |rest_x|), so codes alone
decide nearly all pairs; the rest is computed again from the full vectors. Codes are multiplied as float32 matrices,
which is exact as long as the sums stay below 2 ** 24, and as float64 matrices beyond that.

Equal vectors of a label are one class. Classes are cut into tiles along a projection: pairs of tiles further apart
in it than two linked vectors can be are never multiplied. A tile pair returns one count and at most one link per
vector that is not connected by the others, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relrank.llm import words as W
from relrank.llm.graph import components
from relrank.session import materialize

THRESHOLD = 0.98
TILE = 512
AXIS_SEED = 11


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scale and length of the rest of each unit vector; the length is rounded up."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1))
    return codes, scale, rest * (1 + 1e-9) + 1e-12


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of a and b with a cosine of `threshold` or more, and how many pairs had to be computed in full.

    `same`: a and b are one tile, of which only pairs with the first row before the second are returned.
    """
    (codes_a, scale_a, rest_a), (codes_b, scale_b, rest_b) = quantise(a), quantise(b)
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = codes_a.astype(kind) @ codes_b.astype(kind).T
    near = product * (scale_a[:, None] * scale_b[None, :])
    bound = rest_a[:, None] + rest_b[None, :] * (1 + rest_a[:, None]) + 1e-12
    possible = near + bound >= threshold
    if same:
        possible = np.triu(possible, 1)
    x, y = np.nonzero(possible)
    sure = near[x, y] - bound[x, y] >= threshold
    unsure = np.flatnonzero(~sure)
    for part in np.array_split(unsure, max(1, len(unsure) // 100_000)):
        sure[part] = np.einsum("ij,ij->i", a[x[part]], b[y[part]]) >= threshold
    return x[sure], y[sure], len(unsure)


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as doubles with a digest, their place on the projection, and whether they can link at all."""
    axes: dict[int, np.ndarray] = {}
    for batch in batches:
        column = batch.column("embedding")
        blobs, digests, places = [], [], []
        for value in column:
            held = value.as_py()
            vector = None if held is None or None in held else np.array(held, np.float64)
            fine = vector is not None and len(vector) and np.isfinite(vector).all() and vector.any()
            if fine:
                vector = vector / np.abs(vector).max()  # squares neither overflow nor vanish
                if len(vector) not in axes:
                    axis = np.random.default_rng(AXIS_SEED).standard_normal(len(vector))
                    axes[len(vector)] = axis / np.sqrt(axis @ axis)
                unit = vector / np.sqrt(vector @ vector)
                places.append(float(unit @ axes[len(vector)]))
                unit = unit + 0.0  # -0.0 and 0.0 are one value
                blobs.append(unit.tobytes())
                numbers = unit.view(np.uint64) * W.powers(len(unit) + 1)[1 : len(unit) + 1]
                digests.append(int(W.mix(numbers.sum(keepdims=True) ^ np.uint64(len(unit)))[0].view(np.int64)))
            else:
                places.append(None)
                blobs.append(None)
                digests.append(None)
        yield pa.record_batch({
            "vec_id": batch.column("vec_id"), "label": batch.column("label"), "unit": pa.array(blobs, pa.binary()),
            "digest": pa.array(digests, pa.int64()), "place": pa.array(places, pa.float64()),
        })


def _tile_links(threshold: float):
    """Counts of links, and links that connect whatever the pairs of two tiles connect."""

    def vectors(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Nodes, members and unit vectors by dimension."""
        size = np.array([len(x.as_buffer()) // 8 for x in table.column("unit")])
        out = {}
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            taken = table.take(rows)
            whole = np.stack([np.frombuffer(x.as_buffer()) for x in taken.column("unit")])
            out[int(d)] = taken.column("node").to_numpy(), taken.column("members").to_numpy(), whole
        return out

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("node", "ascending")])
        side = table.column("side").to_numpy()
        same = bool((side == 0).all())
        first = vectors(table.filter(pa.array(side < 2)))
        second = first if same else vectors(table.filter(pa.array(side == 2)))
        node, count, a_out, b_out = [], [], [], []
        for d in first.keys() & second.keys():
            nodes_a, members_a, a = first[d]
            nodes_b, members_b, b = second[d]
            x, y, _ = linked_pairs(a, b, threshold, same)
            for nodes, members, mine, other in ((nodes_a, members_b, x, y), (nodes_b, members_a, y, x)):
                found = np.bincount(mine, members[other], len(nodes)).astype(np.int64)
                hit = np.flatnonzero(found)
                node.append(nodes[hit])
                count.append(found[hit])
            # A forest over the linked rows: repeated minimum of the neighbours' labels.
            names = np.concatenate([nodes_a, nodes_b]) if not same else nodes_a
            label = np.arange(len(names))
            p, q = x, y + (0 if same else len(nodes_a))
            while len(p):
                low = np.minimum(label[p], label[q])
                new = label.copy()
                np.minimum.at(new, label[p], low)
                np.minimum.at(new, label[q], low)
                new = new[new[label]]
                if (new == label).all():
                    break
                label = new
            moved = np.flatnonzero(label != np.arange(len(names)))
            a_out.append(names[moved])
            b_out.append(names[label[moved]])
        none = [np.zeros(0, np.int64)]
        links, pairs = np.concatenate(none + node), np.concatenate(none + a_out)
        return pa.table({
            "node": np.concatenate([links, pairs]),
            "count": np.concatenate([*none, *count, np.zeros(len(pairs), np.int64)]),
            "to": pa.array(np.concatenate([np.zeros(len(links), np.int64), *none, *b_out]), pa.int64(), mask=np.arange(len(links) + len(pairs)) < len(links)),
        })

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`, from its vec_id, embedding and label.

    Vectors of equal label link when their cosine is at least `threshold`. Rows with a null label, or a vector that is
    null, empty, zero, or holds null or non-finite components, link with nothing, as do vectors of unequal dimensions.
    Repeated rows link with each other. A row without vec_id takes part but names no component.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("string").alias("label"),
    ).mapInArrow(_class_rows, "vec_id long, label string, unit binary, digest long, place double")
    rows = materialize(rows, "unit_vectors")
    linkable = rows.where("label is not null and digest is not null").withColumn("node", F.xxhash64("label", "digest"))
    classes = linkable.groupBy("node").agg(
        F.count("*").alias("members"), F.min("label").alias("label"), F.min("unit").alias("unit"), F.min("place").alias("place")
    )
    classes = materialize(classes, "vector_classes")
    # Tiles along the projection: numbered by label and place, through ranges so that no label is sorted in one task.
    ranges = classes.withColumn("range", F.floor((F.col("place") + 1) * 2048).cast("int"))
    sizes = ranges.groupBy("label", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("label", "range").orderBy("place", "node")) - 1
    tiled = ranges.withColumn("own", own).join(sizes, ["label", "range"])
    tiled = tiled.withColumn("tile", F.floor((F.col("own") + F.col("before")) / TILE))
    tiled = materialize(tiled.select("node", "members", "label", "unit", "place", "tile"), "tiles")
    ends = tiled.groupBy("label", "tile").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    other = ends.select("label", F.col("tile").alias("tile2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    # Places of linked unit vectors differ by their distance at most.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    pairs = ends.join(other, "label").where((F.col("tile2") >= F.col("tile")) & (F.col("low2") <= F.col("high") + reach))
    pairs = materialize(pairs.select("label", "tile", "tile2"), "tile_pairs")
    pair = F.struct("label", F.col("tile").alias("t1"), F.col("tile2").alias("t2"))
    sides = pairs.select("label", "tile", pair.alias("pair"), F.when(F.col("tile") == F.col("tile2"), 0).otherwise(1).alias("side"))
    sides = sides.unionByName(
        pairs.where("tile <> tile2").select("label", F.col("tile2").alias("tile"), pair.alias("pair"), F.lit(2).alias("side"))
    )
    held = tiled.join(sides, ["label", "tile"]).select("pair", "side", "node", "members", "unit")
    found = held.groupBy("pair").applyInArrow(_tile_links(threshold), "node long, count long, to long")
    found = materialize(found, "tile_links")
    counts = found.where("to is null").groupBy("node").agg(F.sum("count").alias("others"))
    roots = components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    per_class = classes.select("node", "members").join(counts, "node", "left").join(roots, "node", "left")
    per_class = per_class.select(
        "node", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")
    )
    out = rows.withColumn("node", F.when(F.col("label").isNotNull() & F.col("digest").isNotNull(), F.xxhash64("label", "digest")))
    out = out.select("vec_id", "node").join(per_class, "node", "left")
    least = out.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = out.join(least, "root", "left")
    component = F.when(F.col("root").isNotNull(), F.col("least")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
