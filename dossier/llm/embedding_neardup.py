"""Embedding near-duplicates: an exact metric range join.

Unit vectors are at most `sqrt(2 - 2 * cosine)` apart when their cosine is large enough. A few
pivots partition the vectors into cells of the nearest pivot. By the triangle inequality a vector
of cell p can have a partner in cell q only if it is near the plane between p and q; it is sent
there as a visitor, and every cell is then joined by itself, in tiles of bounded size. Equal vectors
are joined once and counted with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import components
from dossier.session import materialize

MIN_COSINE = 0.98
#: Pivots, chosen by hash from all vectors. More pivots make smaller cells and more visitors.
PIVOTS = 16
#: Vectors in one side of a tile.
TILE_ROWS = 1024
#: The most frequent vector sizes get pivots; vectors of any other size make one cell per size and label.
SIZES_WITH_PIVOTS = 16


def _unit(vectors: pd.Series | list) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(pivots: dict[int, np.ndarray], radius: float):
    """Rows (rep, label, n, vector) to one row per cell: the own cell first, then the visited ones."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sizes = rows["vector"].map(len)
            for size, part in rows.groupby(sizes):
                if size not in pivots:
                    yield part.assign(cell=0, own=True)[["rep", "label", "n", "vector", "cell", "own"]]
                    continue
                centre = pivots[size]
                apart = np.sqrt(np.maximum(0, 2 - 2 * centre @ centre.T))
                near = _unit(part["vector"]) @ centre.T
                own = near.argmax(axis=1)
                ahead = near[np.arange(len(near)), own][:, None] - near
                visits = ahead <= radius * apart[own] + 1e-9
                visits[np.arange(len(near)), own] = True
                row, cell = np.nonzero(visits)
                out = part.iloc[row].copy()
                out["cell"], out["own"] = cell, cell == own[row]
                yield out[["rep", "label", "n", "vector", "cell", "own"]]

    return assign


def _join_tile(min_cosine: float):
    def join(tile: pd.DataFrame) -> pd.DataFrame:
        left, right = tile[tile["left"]], tile[~tile["left"]]
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
        linked = (_unit(left["vector"]) @ _unit(right["vector"]).T >= min_cosine) & (a[:, None] != b[None, :])
        links = linked @ right["n"].to_numpy()
        some, other = linked.any(axis=1), linked.any(axis=0)
        a, b, linked, links = a[some], b[other], linked[some][:, other], links[some]
        if not len(a):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        from_b, big = b.copy(), np.iinfo(np.int64).max
        while True:
            from_a = np.minimum(a, np.where(linked, from_b[None, :], big).min(axis=1))
            new = np.minimum(from_b, np.where(linked, from_a[:, None], big).min(axis=0))
            if (new == from_b).all():
                break
            from_b = new
        return pd.DataFrame({
            "id": np.concatenate([a, b]), "links": np.concatenate([links, np.zeros(len(b), np.int64)]),
            "root": np.concatenate([from_a, from_b]),
        })

    return join


def near_duplicates(
    vectors: DataFrame, min_cosine: float = MIN_COSINE, pivots: int = PIVOTS, tile_rows: int = TILE_ROWS,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows link when their labels are equal and not null, their vectors have the same size and the cosine in double
    precision reaches `min_cosine`. A vector that is null, empty, zero, or holds a null or a number that is not finite links
    with nothing: no links, its own component, kept. Repeated rows count as vectors of their own. An
    empty table gives an empty result. Extra columns are ignored.
    """
    value = F.col("vector")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = rows.where(F.col("label").isNotNull() & value.isNotNull() & finite & F.exists(value, lambda x: x != 0))
    # -0.0 and 0.0 are one value
    valid = valid.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast("float")).cast("array<double>"))
    classes = materialize(valid.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    common = classes.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(SIZES_WITH_PIVOTS)
    sizes = [r["size"] for r in common.collect()]
    sampled = {
        s: [r[0] for r in classes.where(F.size("vector") == s).orderBy(F.xxhash64("rep")).limit(pivots).select("vector").collect()]
        for s in sizes
    }
    radius = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    cells = classes.mapInPandas(
        _cells({s: _unit(v) for s, v in sampled.items()}, radius),
        "rep long, label long, n long, vector array<double>, cell int, own boolean",
    )
    cells = materialize(cells.withColumn("dim", F.size("vector")))
    home = ["label", "dim", "cell"]
    counts = cells.groupBy(*home).agg(F.sum(F.col("own").cast("int")).alias("n_own"), F.count(F.lit(1)).alias("n_all"))
    blocks = counts.where("n_all > 1 and n_own > 0").select(
        *home, F.ceil(F.col("n_own") / tile_rows).cast("int").alias("lefts"), F.ceil(F.col("n_all") / tile_rows).cast("int").alias("rights"),
    )
    dealt = cells.join(blocks, home)
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("long")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    lefts = dealt.where("own").select("*", at("lefts").alias("x"), F.explode(upto("rights")).alias("y"), F.lit(True).alias("left"))
    rights = dealt.select("*", F.explode(upto("lefts")).alias("x"), at("rights").alias("y"), F.lit(False).alias("left"))
    tiles = lefts.unionByName(rights).select(*home, "x", "y", "left", "rep", "n", "vector")
    found = materialize(tiles.groupBy(*home, "x", "y").applyInPandas(_join_tile(min_cosine), "id long, links long, root long"))
    reached = components(found, "id", "root").toDF("rep", "component")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(reached, "rep", "left")
    same = valid.select("vec_id", F.col("label").alias("vl"), "vector").join(
        known.select(F.col("label").alias("vl"), "vector", "rep", "n", "links", "component"), ["vl", "vector"],
    ).select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where(~F.coalesce(
        F.col("label").isNotNull() & value.isNotNull() & finite & F.exists(value, lambda x: x != 0), F.lit(False),
    )).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return same.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
