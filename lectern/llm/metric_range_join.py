"""Near-duplicate vectors: an exact metric range join over pivot cells.

Vectors are normalised in double precision; cosine >= c means a distance of at
most r = sqrt(2 - 2c) on the unit sphere.  Pivots are vectors of the table.  A
vector's home is the cell of its nearest pivot; by the triangle inequality a
partner y of x at home in cell p has d(x, p) <= d(x, nearest pivot) + 2r and
d(x, p) <= (radius of the cell) + r, so x is replicated to just the cells that
meet both, and whose half-space (against every other pivot) is no farther than
r.  Vectors without structure meet all of this for most cells, whatever the
pivots, so cells are few and large rather than many.  Cells then join independently, each pair in the home cell of its
first member, and again by the triangle inequality only where the distances to
the cell's pivot differ by r at most.

Copies of one vector are one row with a count.  A cell of any size is cut into
tiles of bounded blocks; a tile returns counts and a spanning forest of its
links, never all pairs.  Pivots are a bounded number of rows (MAX_PIVOTS); they
only steer the partition and never change the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Forest, connected_components, groups, table, trimmed

#: Vectors per pivot aimed at, the bound on pivots, and the rows of a block.
CELL_ROWS, MAX_PIVOTS, BLOCK_ROWS = 5000, 1024, 20_000
#: Slack of distances in double precision; it can only add candidates.
EPS = 1e-9


def _unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """vec_id, embedding -> vec_id, v: the unit vector as bytes of float64, null if it links with nothing."""
    for batch in batches:
        out: list[bytes | None] = []
        for e in batch["embedding"]:
            v = None if e is None else np.asarray([np.nan if x is None else x for x in e] if getattr(e, "dtype", None) == object else e, dtype=np.float64)
            if v is None or not len(v) or not np.isfinite(v).all():
                out.append(None)
                continue
            top = np.abs(v).max()
            if top == 0:
                out.append(None)
                continue
            v = v / top
            out.append((v / math.sqrt(float(np.dot(v, v)))).tobytes())
        yield pd.DataFrame({"vec_id": batch["vec_id"], "v": out})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def _homes(by_size: dict[int, np.ndarray]):
    """id, v -> id, v, dim, home, d: the nearest pivot among those of the same length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["v"].map(len) // 8
            for dim, part in batch.groupby(dims):
                d = _distances(_matrix(part["v"]), by_size[dim])
                home = d.argmin(axis=1)
                yield pd.DataFrame(
                    {"id": part["id"], "n": part["n"], "v": part["v"], "dim": np.int32(dim), "home": home.astype(np.int32), "d": d[np.arange(len(home)), home]}
                )

    return run


def _places(by_size: dict[int, np.ndarray], radii: dict[tuple[int, int], float], reach: float):
    """One row per cell that may hold a partner: id, dim, cell, d to its pivot, and whether it is home.

    Distances and radii prune first; only what they leave is held against the
    half-spaces of all pivots.
    """
    apart = {k: _distances(p, p) for k, p in by_size.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                pivots = by_size[dim]
                radius = np.array([radii.get((dim, p), -10.0) for p in range(len(pivots))])
                step = max(1, 2_000_000 // len(pivots))
                for lo in range(0, len(part), 2048):
                    own = part.iloc[lo : lo + 2048]
                    cos = _matrix(own["v"]) @ pivots.T
                    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))
                    near = own["d"].to_numpy()[:, None]
                    home = own["home"].to_numpy()
                    inside = (d <= near + 2 * reach + EPS) & (d <= radius[None, :] + reach + EPS)
                    inside[np.arange(len(home)), home] = True
                    row, cell = np.nonzero(inside)
                    stays = np.ones(len(row), dtype=bool)
                    for f in range(0, len(row), step):
                        r, c = row[f : f + step], cell[f : f + step]
                        stays[f : f + step] = (cos[r] - cos[r, c][:, None] <= reach * apart[dim][c] + EPS).all(axis=1)
                    stays |= home[row] == cell
                    row, cell = row[stays], cell[stays]
                    yield pd.DataFrame(
                        {"id": own["id"].to_numpy()[row], "dim": np.int32(dim), "cell": cell.astype(np.int32), "pd": d[row, cell], "home": home[row] == cell}
                    )

    return run


def _join_tiles(cosine: float, reach: float):
    """Sorted tiles -> id, links found, and edges of a spanning forest (to is null for counts).

    A tile (i, j) compares its home rows of block i with all rows of block j.
    A pair of two home rows is met from either side, a pair of different cells
    once in each; every vector thus counts a partner in its own home only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["dim", "cell", "i", "j"]):
            own = g[g["left"]].sort_values(["pd", "id"])
            other = g[~g["left"]].sort_values(["pd", "id"])
            if not len(own) or not len(other):
                continue
            x, y = _matrix(own["v"]), _matrix(other["v"])
            a, b = own["id"].to_numpy(), other["id"].to_numpy()
            n, dx, dy = other["n"].to_numpy(), own["pd"].to_numpy(), other["pd"].to_numpy()
            counts = np.zeros(len(a), dtype=np.int64)
            names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            forest, edges = Forest(len(names)), []
            for lo in range(0, len(x), 256):
                hi = min(lo + 256, len(x))
                f = int(np.searchsorted(dy, dx[lo] - reach - EPS))
                t = int(np.searchsorted(dy, dx[hi - 1] + reach + EPS, side="right"))
                if f >= t:
                    continue
                hit = (x[lo:hi] @ y[f:t].T >= cosine) & (a[lo:hi, None] != b[None, f:t])
                counts[lo:hi] += hit @ n[f:t]
                for p, q in zip(*np.nonzero(hit), strict=True):
                    if forest.join(at[lo + p], at[len(a) + f + q]):
                        edges.append((a[lo + p], b[f + q]))
            some = counts > 0
            yield pd.DataFrame({"id": a[some], "links": counts[some], "to": pd.array([None] * int(some.sum()), dtype="Int64")})
            if edges:
                e = np.array(edges)
                yield pd.DataFrame({"id": e[:, 0], "links": np.zeros(len(e), np.int64), "to": pd.array(e[:, 1], dtype="Int64")})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    n_links counts the other vectors with a cosine of at least ``cosine``,
    copies included; component_id is the smallest vec_id reachable over links;
    kept marks vec_id = component_id.  Vectors that are null, empty or zero or
    hold a null or non-finite component link with nothing, as do vectors of
    different lengths among each other.  Rows that repeat a vec_id are vectors of
    their own, which only their cosine links.  Rows without a vec_id link with
    nothing: component_id is null, kept is true.  An empty table gives an empty
    result; further columns are ignored.
    """
    reach = math.sqrt(2 - 2 * cosine)
    units = table(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(trimmed(_unit), "vec_id long, v binary"),
        "units",
    )
    classes = table(
        units.where("vec_id is not null and v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    sizes = {r[0]: r[1] for r in classes.groupBy((F.length("v") / 8).cast("int")).count().collect()}
    by_size = {}
    for dim, rows in sizes.items():
        want = min(MAX_PIVOTS, max(1, round(rows / CELL_ROWS)))
        found = classes.where(F.length("v") == 8 * dim).orderBy(F.xxhash64("v"), "v").limit(want).select("v").collect()
        by_size[dim] = np.stack([np.frombuffer(r[0], dtype=np.float64) for r in found])
    homes = table(classes.mapInPandas(trimmed(_homes(by_size)), "id long, n long, v binary, dim int, home int, d double"), "homes")
    cells = homes.groupBy("dim", "home").agg(F.max("d").alias("r")).collect()  # a row per pivot
    radii = {(r["dim"], r["home"]): r["r"] for r in cells}
    # placed once and without the vectors, to be counted before they are dealt
    placed = table(homes.mapInPandas(trimmed(_places(by_size, radii, reach)), "id long, dim int, cell int, pd double, home boolean"), "placed")
    size = lambda n: F.ceil(n / F.lit(BLOCK_ROWS)).cast("int")
    blocks = table(
        placed.groupBy("dim", "cell").agg(size(F.count("*")).alias("rights"), size(F.count_if("home")).alias("lefts")).where("lefts > 0"), "blocks"
    )  # a row per pivot with a home row
    blocked = placed.join(F.broadcast(blocks), ["dim", "cell"]).join(homes.select("id", "n", "v"), "id")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = blocked.where("home").select("*", block("lefts").alias("i"), every("rights").alias("j"), F.lit(True).alias("left"))
    right = blocked.select("*", every("lefts").alias("i"), block("rights").alias("j"), F.lit(False).alias("left"))
    met = table(
        left.unionByName(right)
        .select("dim", "cell", "i", "j", "left", "id", "n", "v", "pd")
        .repartition("dim", "cell", "i", "j")
        .sortWithinPartitions("dim", "cell", "i", "j")
        .mapInPandas(trimmed(_join_tiles(cosine, reach)), "id long, links long, to long"),
        "met",
    )
    counts = met.where("to is null").groupBy("id").agg(F.sum("links").alias("links"))
    component = table(connected_components(met.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b"))), "components")
    smallest = component.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"))
    named = component.join(smallest, "component").select("id", "component_id")
    found = classes.join(counts, "id", "left").join(named, "id", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    linked = units.where("vec_id is not null").join(found, "v", "left")
    out = linked.unionByName(units.where("vec_id is null"), allowMissingColumns=True)
    component_id = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component_id.alias("component_id"),
        F.coalesce(component_id == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


ORACLE = """
with recursive u as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
), pairs as (
  select a.vec_id as a, b.vec_id as b from u a, u b
  where a.vec_id <> b.vec_id
    and list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
), reach(id, c) as (
  select vec_id, vec_id from u
  union
  select p.b, r.c from reach r join pairs p on p.a = r.id
)
select u.vec_id, (select count(*) from pairs p where p.a = u.vec_id)::bigint as n_links,
  r.c as component_id, u.vec_id = r.c as kept
from u join (select id, min(c) as c from reach group by id) r on r.id = u.vec_id
"""
