"""Node tables with positions and ids, and graphs of them."""

from __future__ import annotations

import sys
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import geometry as G
from geoweft.functions.crs import is_geographic
from geoweft.functions.projection import transformed


# Messages that callers match.
NOT_UNIQUE = "ID column must contain unique values"
SEVERAL = "Multi-index is not supported"
#: Nodes whose ids may be broadcast to edges: edges are many more.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class GeoFrame:
    """A table of nodes.

    Geometry is either columns ``x`` and ``y``, or ``geometry`` holding a point
    struct, a line (points), a polygon (rings) or several polygons; a node stands
    at its centroid. ``node_pos`` is the name of a row's number and can't be a
    column's. ``order`` gives the columns whose order numbers the
    rows (a table has no order of its own); ``index`` names the columns that
    ``id_col="index"`` refers to.
    """

    df: DataFrame
    geometry: str = "geometry"
    order: tuple[str, ...] = ()
    index: tuple[str, ...] = ()
    crs: object | None = None

    @property
    def shape(self) -> str:
        """point, line, polygon or polygons."""
        if self.geometry not in self.df.columns:
            return "point"
        depth, t = 0, self.df.schema[self.geometry].dataType
        while t.typeName() == "array":
            depth, t = depth + 1, t.elementType
        if t.typeName() != "struct" or not {"x", "y"} <= set(t.fieldNames()) or depth > 3:
            raise ValueError("geometry must be a struct of x and y, or arrays of such as lines, polygons or several polygons")
        return G.SHAPES[depth]

    @property
    def polygons(self) -> bool:
        return self.shape != "point"

    @property
    def geometry_columns(self) -> list[str]:
        return [self.geometry] if self.geometry in self.df.columns else ["x", "y"]

    def position(self) -> tuple[Column, Column]:
        """The point of each node; a line's or polygon's is its centroid."""
        if self.geometry in self.df.columns:
            p = G.centre(F.col(self.geometry), self.shape)
            return p["x"].cast("double"), p["y"].cast("double")
        return F.col("x").cast("double"), F.col("y").cast("double")


@dataclass(frozen=True)
class GeoGraph:
    """nodes: node_pos, node_id, x, y and attributes; edges: source, target, length, source_pos, target_pos with source_pos < target_pos."""

    nodes: DataFrame
    edges: DataFrame
    meta: dict = field(default_factory=dict)
    #: The node table that holds all ends of the edges, if it is known to; not for users.
    nodes_of_ends: DataFrame | None = field(default=None, repr=False, compare=False)

    def with_edges(self, edges: DataFrame) -> GeoGraph:
        return replace(self, edges=edges, nodes_of_ends=None)


def warn_crs(crs: object | None) -> None:
    if crs is None:
        warnings.warn("The node table has no CRS; distances are taken as planar.", UserWarning, stacklevel=3)
    elif is_geographic(crs):
        warnings.warn("The CRS is geographic; distances in degrees are no lengths. Project the nodes first.", UserWarning, stacklevel=3)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the rank of each row from 0. Rows are sorted in parallel; only row counts of partitions reach the driver."""
    spark = df.sparkSession
    part, row, shift = unused(df, "part", "row", "shift")
    held = df.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()).persist()
    counts = {r[0]: (r[1], r[2]) for r in held.groupBy(part).agg(F.count("*"), F.min(row)).collect()}
    base, at = {}, 0
    for p in sorted(counts):
        base[p] = at - counts[p][1]
        at += counts[p][0]
    if not base:
        return held.withColumn(name, F.lit(0).cast("long")).drop(part, row)
    shifts = spark.createDataFrame(list(base.items()), f"`{part}` int, `{shift}` long")
    return held.join(F.broadcast(shifts), part).withColumn(name, F.col(row) + F.col(shift)).drop(part, row, shift)


def id_name(frame: GeoFrame, id_col: str | None) -> str | None:
    """The column that ids come from; None for positions."""
    if id_col is None:
        return None
    if id_col == "index":
        if len(frame.index) > 1:
            raise ValueError(SEVERAL)
        if not frame.index:
            return None
        return frame.index[0]
    if id_col not in frame.df.columns:
        raise KeyError(id_col)
    return id_col


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    """The ids that several rows have."""
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def attributes(frame: GeoFrame, id_col: str | None, wanted: bool | str | list[str] | None) -> list[str]:
    """The columns that nodes keep: all, none or those named; never the id again."""
    if wanted is True:
        names = frame.df.columns
    elif not wanted:
        names = []
    else:
        names = [wanted] if isinstance(wanted, str) else list(wanted)
        for n in names:
            if n not in frame.df.columns:
                raise KeyError(n)
    return [n for n in names if n not in (id_col, "node_pos", "node_id", "x", "y")]


def as_nodes(frame: GeoFrame, id_col: str | None = None, checked: bool = True) -> DataFrame:
    """All columns with node_pos, node_id, x and y. Uniqueness of ids and the geometry of every row are checked."""
    name = id_name(frame, id_col)
    df = frame.df
    if checked and name is not None and not duplicate_ids(df, name).isEmpty():
        raise ValueError(NOT_UNIQUE)
    if "node_pos" in df.columns:
        raise ValueError("node_pos is the number that a node gets; rename that column")
    x, y = frame.position()
    u, v = unused(df, "px", "py")
    df = df.withColumns({u: x, v: y})
    df = df.withColumns({"x": F.col(u), "y": F.col(v)}).drop(u, v)
    if checked and not df.where(F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y")).isEmpty():
        raise ValueError("every node needs a point, a line or a polygon")
    order = frame.order or ((name,) if name else tuple(c for c in df.columns if c not in ("geometry",)))
    df = numbered(df, [F.col(c) for c in order], "node_pos")
    return df.withColumn("node_id", F.col(name) if name else F.col("node_pos"))


def total_bounds(frame: GeoFrame) -> tuple[float, float, float, float]:
    """The bounds of all geometries, of polygons those of their rings."""
    if frame.polygons:
        b = G.bounds(F.col(frame.geometry), frame.shape)
        x1, y1, x2, y2 = b["xmin"], b["ymin"], b["xmax"], b["ymax"]
    else:
        x1, y1 = x2, y2 = frame.position()
    r = frame.df.agg(F.min(x1), F.min(y1), F.max(x2), F.max(y2)).first()
    return tuple(r)


def exploded(frame: GeoFrame, part: str | None = None) -> GeoFrame:
    """A row for each polygon of a frame of several polygons a row, numbered within its row by a column ``part`` if that is named."""
    if frame.shape != "polygons":
        raise ValueError("only rows of several polygons can be exploded")
    others = [F.col(f"`{c}`") for c in frame.df.columns if c != frame.geometry]
    at, _ = unused(frame.df, part or "part", "x")
    df = frame.df.select(*others, F.posexplode(frame.geometry).alias(at, frame.geometry))
    return replace(frame, df=df if part else df.drop(at), order=(*frame.order, at) if part else frame.order)


def to_crs(frame: GeoFrame, crs: object) -> GeoFrame:
    """The frame with its points in another coordinate reference system, by expressions on its own columns."""
    if frame.crs is None:
        raise ValueError("The node table has no CRS to project from.")
    if frame.geometry in frame.df.columns:
        moved = G.each_point(F.col(f"`{frame.geometry}`"), frame.shape, lambda p: transformed(p, frame.crs, crs))
        return replace(frame, df=frame.df.withColumn(frame.geometry, moved), crs=crs)
    p = transformed(F.struct("x", "y"), frame.crs, crs)
    return replace(frame, df=frame.df.withColumns({"x": p["x"], "y": p["y"]}), crs=crs)


def report(graph: GeoGraph, verbose: bool, moved: int | None = None) -> GeoGraph:
    """With verbose, says on standard error what has been built: nodes, edges, mean degree, and how many edges were rewired."""
    if verbose:
        n, m = graph.nodes.count(), graph.edges.count()
        text = f"{n:,} nodes, {m:,} edges, mean degree {2 * m / max(1, n):.2f}"
        if moved is not None:
            text += f", {moved:,} edges rewired ({100 * moved / max(1, m):.2f} %)"
        print(f"geoweft: {text}", file=sys.stderr)
    return graph


def find_scaling_factor(frame: GeoFrame) -> float:
    """20 over the diagonal of the bounds."""
    x1, y1, x2, y2 = total_bounds(frame)
    if x1 is None:
        raise ValueError("no nodes to take a scaling factor from")
    diagonal = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
    if diagonal == 0:
        raise ValueError("all nodes are at one place; give a scaling_factor")
    return 20 / diagonal


def finished(frame: GeoFrame, nodes: DataFrame, edges: DataFrame, id_col: str | None, node_attributes: object, present: str = "all", n: int | None = None) -> GeoGraph:
    """The graph with ids on its edges and the wanted attributes on its nodes; present="edges" keeps only nodes with an edge.

    ``n`` is the number of nodes, if it is known.
    """
    name = id_name(frame, id_col)
    if name is None and id_col == "index":
        name = None
    keep = attributes(frame, name, node_attributes)
    ids = nodes.select("node_pos", "node_id")
    if n is not None and n <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    e = edges.select(F.least("i", "j").alias("source_pos"), F.greatest("i", "j").alias("target_pos"), "length")
    e = e.join(ids.select(F.col("node_pos").alias("source_pos"), F.col("node_id").alias("source")), "source_pos")
    e = e.join(ids.select(F.col("node_pos").alias("target_pos"), F.col("node_id").alias("target")), "target_pos")
    e = e.select("source", "target", "length", "source_pos", "target_pos")
    kept = nodes.select("node_pos", "node_id", "x", "y", *keep)
    if present == "edges":
        used = edges.select(F.col("i").alias("node_pos")).union(edges.select("j")).distinct()
        kept = kept.join(used, "node_pos", "left_semi")
    meta = {"crs": frame.crs, "id_col": id_col, "geometry": frame.geometry if frame.geometry in frame.df.columns else None}
    if id_col == "index":
        meta["index_name"] = frame.index[0] if frame.index else None
    return GeoGraph(kept, e, meta, nodes_of_ends=kept)


def warn_if_empty(edges: DataFrame) -> None:
    if edges.isEmpty():
        warnings.warn("No edges were created. Try other parameters.", UserWarning, stacklevel=3)
