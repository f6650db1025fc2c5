"""Near-duplicate vectors by int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import connected_components, store

#: Vectors for each pivot, SAMPLE at least, that the pivots are fitted on, taken by the order of hashed ids; and pivots at most.
PER_PIVOT, SAMPLE = 4, 4096
PIVOTS = 4096
#: Rows on either side of a tile at most, in the mean.
TILE = 4096
#: Pivots closer than this are one: many are drawn from copies of a single vector.
APART = 1e-4


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length 1."""
    rows = rows.astype("f8")
    rows = rows / np.abs(rows).max(1, keepdims=True)  # no overflow, no underflow
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means centres of unit vectors, no two within APART; deterministic."""
    pivots = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(rounds):
        home = (sample @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, home, sample)
        norm = np.sqrt((sums**2).sum(1))
        pivots = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], pivots)
    pivots = np.unique(pivots, axis=0)
    chosen: list[int] = []
    for i in range(len(pivots)):
        if not chosen or distances(pivots[chosen], pivots[i]).min() >= APART:
            chosen.append(i)
    return pivots[chosen]


def distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The distance of each row, by differences: exact for near ones too."""
    return np.sqrt(((rows - to) ** 2).sum(1))


def spread(pivots: np.ndarray) -> np.ndarray:
    """The distances between all pivots."""
    return np.stack([distances(pivots, p) for p in pivots])


def places(unit: np.ndarray, pivots: np.ndarray, radius: float, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and a mask of the cells below it that may
    hold the home of a vector within `radius`: those whose bisector with the home
    pivot is no farther than that.

    The difference of the square distances to two pivots changes by 2 `apart` a
    step at most, and is 0 or less at the partner. It's compared without dividing:
    pivots that are all but equal are guests of each other by the last term, which
    covers rounding."""
    apart = spread(pivots) if apart is None else apart
    square = (pivots**2).sum(1) - 2 * unit @ pivots.T
    home = square.argmin(1)
    beyond = square - square[np.arange(len(unit)), home][:, None]
    return home, (beyond <= 2 * apart[home] * (radius + 1e-7) + 1e-9) & (np.arange(len(pivots)) < home[:, None])


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the exact length of each vector's quantisation error."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype("i1")
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1)) + 1e-9
    return codes, scale, error


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the unit vectors whose cosine reaches `threshold`.

    With x = s q + e, the product of two vectors differs from s s' q.q' by at
    most |e| + |e'| + 3 |e| |e'| (a code's length is at most 1 + |e|). The int8
    products are exact in float32 up to 1,040 dimensions and in float64 beyond.
    Only pairs whose bound reaches the threshold are computed in double precision.
    """
    kind = "f4" if left.shape[1] <= 1040 else "f8"
    (ql, sl, el), (qr, sr, er) = quantise(left), quantise(right)
    turned = np.ascontiguousarray(qr.T.astype(kind))
    found_i, found_j = [], []
    least = (threshold - el - er.max() * (1 + 3 * el)) / sl
    least = np.where(least > 0, least / sr.max(), least / sr.min()) - 0.5
    for at in range(0, len(left), 512):
        product = ql[at : at + 512].astype(kind) @ turned
        i, j = np.nonzero(product >= least[at : at + 512, None].astype(kind))
        bound = product[i, j].astype("f8") * sl[i + at] * sr[j] + el[i + at] + er[j] + 3 * el[i + at] * er[j]
        ok = bound >= threshold
        i, j = i[ok] + at, j[ok]
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 50_000):
            a, b = i[k : k + 50_000], j[k : k + 50_000]
            linked = np.einsum("ij,ij->i", left[a], right[b]) >= threshold
            found_i.append(a[linked])
            found_j.append(b[linked])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int), np.zeros(0, int))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable by links, for each of n."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", per_cell: int = 4000) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Pivots from a bounded sample (PER_PIVOT rows for each, SAMPLE at least) split
    the unit sphere into cells of about `per_cell` vectors, PIVOTS cells at most. A vector is a guest of every lower cell
    that a partner could be at home in; the bisector bound makes that exact, so
    no pair within reach is lost whatever the pivots are. Home and guest rows of
    a cell fall into blocks of at most `TILE` rows or so, and each pair of blocks
    is one group: a cell of any size, a hot one too, becomes many tiles of
    bounded memory. A tile returns, for each of its vectors, the number of links
    found and the smallest tile member that it is linked to by links: never the
    pairs. Components are joined by distributed star rounds.

    Null, empty, zero or non-finite vectors, and rows without an id, link with
    nothing (component_id is the own id). Vectors of different lengths aren't
    compared. Repeated rows come out each; n_links counts the linked rows under
    other ids, over all rows of the own id. An empty table gives no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    # Floats stay floats, where they are compact; everything else is taken in double precision.
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    code = "f4" if kind == "float" else "f8"
    parts = F.transform(F.col(vector_col), lambda x: x.cast(kind))
    sound = F.coalesce(F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(parts, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, parts).alias("v"))
    usable = rows.where("v is not null and id is not null").withColumn("dim", F.size("v"))
    counts = {r.dim: r.n for r in usable.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pivots: dict[int, np.ndarray] = {}
    for dim, n in counts.items():
        k = int(min(PIVOTS, n // per_cell))
        if k > 1:
            sample = usable.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, PER_PIVOT * k)).select("v").toArrow()
            pivots[dim] = fit_pivots(_unit(np.stack(sample.column(0).to_numpy())), k)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {dim: spread(p) for dim, p in pivots.items()}
        for batch in (x.slice(at, 1000) for x in batches for at in range(0, x.num_rows, 1000)):
            for dim in set(batch.column(2).to_pylist()):
                own = batch.filter(pc.equal(batch.column(2), dim))
                data = np.stack(own.column(1).to_numpy(zero_copy_only=False)).astype(code)
                ids = own.column(0).to_numpy(zero_copy_only=False)
                if dim in pivots:
                    home, near = places(_unit(data), pivots[dim], radius, apart[dim])
                    guest, cell = np.nonzero(near)
                else:
                    home, guest, cell = np.zeros(len(ids), int), np.zeros(0, int), np.zeros(0, int)
                at = np.r_[np.arange(len(ids)), guest]
                blobs = [x.tobytes() for x in data]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, "i4")), pa.array(np.r_[home, cell].astype("i4")), pa.array(np.r_[np.ones(len(ids), bool), np.zeros(len(guest), bool)]), pa.array(ids[at]), pa.array([blobs[i] for i in at], pa.binary())], names=["dim", "cell", "home", "id", "v"])

    dealt = store(usable.select("id", "v", "dim").mapInArrow(deal, "dim int, cell int, home boolean, id long, v binary"), "vectors")
    sizes = dealt.groupBy("dim", "cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / TILE).cast("int").alias("nh"), F.ceil(F.sum((~F.col("home")).cast("int")) / TILE).cast("int").alias("ng"))
    # One row for each cell, of which there are PIVOTS for a vector length at most.
    blocked = dealt.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("block", F.when(F.col("home"), F.pmod(F.xxhash64("id"), F.col("nh"))).otherwise(F.pmod(F.xxhash64("id"), F.col("ng"))).cast("int"))
    # A home block meets the home blocks from itself on, and every guest block.
    tiles = F.when(
        F.col("home"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("a"), F.greatest(b, F.col("block")).alias("b"))),
            F.when(F.col("ng") > 0, F.transform(F.sequence(F.lit(0), F.col("ng") - 1), lambda b: F.struct(F.col("block").alias("a"), (F.col("nh") + b).alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>")),
        ),
    ).otherwise(F.when(F.col("nh") > 0, F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda a: F.struct(a.alias("a"), (F.col("nh") + F.col("block")).alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>")))
    own = F.when(F.col("home"), F.col("block")).otherwise(F.col("nh") + F.col("block"))
    grouped = blocked.select("dim", "cell", "id", "v", own.alias("own"), F.explode(tiles).alias("tile")).select("dim", "cell", "tile.a", "tile.b", "own", "id", "v")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        dim, _, a, b = key
        first = group.own.to_numpy() == a
        ids = group.id.to_numpy()
        unit = _unit(np.frombuffer(b"".join(group.v), code).reshape(-1, dim))
        if a == b:
            i, j = tile_links(unit, unit, True, threshold)
        else:
            at, to = np.flatnonzero(first), np.flatnonzero(~first)
            if not len(at) or not len(to):
                return pd.DataFrame({"id": ids[:0], "n": ids[:0], "root": ids[:0]})
            i, j = tile_links(unit[at], unit[to], False, threshold)
            i, j = at[i], to[j]
        other = ids[i] != ids[j]
        i, j = i[other], j[other]
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), int)
        rank[order] = np.arange(len(ids))
        label = roots(len(ids), rank[i], rank[j])
        n = np.bincount(np.r_[i, j], minlength=len(ids))
        hit = np.flatnonzero(n)
        return pd.DataFrame({"id": ids[hit], "n": n[hit].astype("i8"), "root": ids[order[label[rank[hit]]]]})

    links = store(grouped.groupBy("dim", "cell", "a", "b").applyInPandas(compare, "id long, n long, root long"), "vector-links")
    found = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    totals = links.groupBy("id").agg(F.sum("n").alias("n_links")).join(found, "id", "left")
    component = F.coalesce("component", "id")
    return (
        rows.select("id")
        .join(totals, "id", "left")
        .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
    )
