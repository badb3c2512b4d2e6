"""Structural invariants of graphs, and decisions held against sequential models."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

import geoweft as gw
from geoweft.operators import analytics, resolve, shared
from geoweft.operators.frame import GeoFrame

CRS = "EPSG:3857"


@pytest.fixture(scope="module")
def grid(spark):
    rng = random.Random(5)
    rows = [(10 * x + y, float(x), float(y), rng.choice("ABC"), rng.randint(1, 9)) for x in range(10) for y in range(10)]
    df = spark.createDataFrame(rows, "id long, x double, y double, group string, expected_degree long").coalesce(2).persist()
    return GeoFrame(df, order=("id",), index=("id",), crs=CRS)


@pytest.fixture(scope="module")
def squares(spark):
    ring = lambda a: [[(a, a), (a + 2.0, a), (a + 2.0, a + 2.0), (a, a + 2.0), (a, a)]]
    rows = [(i, "ABC"[i], ring(3.0 * i)) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, group string, geometry array<array<struct<x:double,y:double>>>")
    return GeoFrame(df, order=("id",), crs=CRS)


def pairs(graph):
    return {(r[0], r[1]) for r in graph.edges.select("source_pos", "target_pos").collect()}


def sound(graph, cap):
    return tuple(analytics.invariants(graph, cap).first()) == (0, 0, 0, 0)


def test_er_is_repeatable_and_capped(grid):
    a = gw.geo_erdos_renyi_network(grid, a=2, max_degree=4, id_col="id", random_state=3)
    b = gw.geo_erdos_renyi_network(grid, a=2, max_degree=4, id_col="id", random_state=3)
    assert pairs(a) == pairs(b) and a.nodes.count() == 100 and sound(a, 4)
    lengths = a.edges.join(a.nodes.select(F.col("node_id").alias("source"), "x", "y"), "source").join(a.nodes.select(F.col("node_id").alias("target"), F.col("x").alias("u"), F.col("y").alias("v")), "target")
    assert lengths.where("abs(length - sqrt((x-u)*(x-u)+(y-v)*(y-v))) > 1e-9").isEmpty()


def test_cap_is_that_of_admission_in_order(grid, spark, monkeypatch):
    monkeypatch.setattr(resolve, "WINDOW_ROWS", 60)
    every = gw.geo_erdos_renyi_network(grid, a=1, max_degree=1000, random_state=3)
    rng = random.Random(1)
    rows = [(i, j, 1.0, *((i, j) if rng.random() < 0.7 else (j, i))) for i, j in sorted(pairs(every))]
    edges = spark.createDataFrame(rows, "i long, j long, length double, p long, q long").repartition(3)
    for cap in (1, 7, 30, 60, 99):
        degree, want = [0] * 100, set()
        for i, j, _, p, q in sorted(rows, key=lambda r: r[3:]):
            if degree[i] < cap and degree[j] < cap:
                want.add((i, j))
                degree[i], degree[j] = degree[i] + 1, degree[j] + 1
        got = resolve.capped(edges, cap, 100).collect()
        assert {(r["i"], r["j"]) for r in got} == want and len(got) == len(want)


def nearest_first(points, k, cap, allowed=lambda i, j: True):
    """Picks in order, by loops: node -> [(neighbour, rank)]."""
    degree, picked = [0] * len(points), {}
    for i, (x, y) in enumerate(points):
        order = sorted((((x - u) * (x - u) + (y - v) * (y - v)) ** 0.5, j) for j, (u, v) in enumerate(points) if j != i and allowed(i, j))
        picked[i] = []
        for r, (_, j) in enumerate(order, 1):
            if len(picked[i]) < k[i] and i not in (p for p, _ in picked.get(j, ())) and degree[i] < cap and degree[j] + k[j] < cap:
                picked[i].append((j, r))
                degree[i], degree[j] = degree[i] + 1, degree[j] + 1
    return picked


@pytest.mark.parametrize(("k", "cap"), [(4, 150), (6, 8)])
def test_picks_over_many_windows_are_those_in_order(spark, monkeypatch, k, cap):
    """A lattice, whose decisions hang on each other in long chains, and points at random; a window holds a few nodes only."""
    monkeypatch.setattr(resolve, "WINDOW_ROWS", 60)
    rng = random.Random(k)
    for points in ([(float(x), float(y)) for x in range(6) for y in range(6)],) if k == 4 and cap > 5 else ([(rng.random(), rng.random()) for _ in range(40)],):
        df = spark.createDataFrame([(n, x, y) for n, (x, y) in enumerate(points)], "id long, x double, y double")
        f = GeoFrame(df, order=("id",), crs=CRS)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            got = pairs(gw.geo_watts_strogatz_network(f, k, 0, max_degree=cap, random_state=3))
        want = {(min(i, j), max(i, j)) for i, js in nearest_first(points, [min(k // 2, cap)] * len(points), cap).items() for j, _ in js}
        assert got == want


def test_picks_of_few_allowed_nodes(spark):
    """Twenty classes, one of them of a single node: each node finds its own kind, however far."""
    rng = random.Random(8)
    points = [(rng.random() * 100, rng.random() * 100) for _ in range(200)]
    kind = [0 if n == 0 else 1 + n % 20 for n in range(200)]
    weight = [rng.randrange(4) for _ in range(200)]
    df = spark.createDataFrame([(n, x, y, kind[n], weight[n]) for n, (x, y) in enumerate(points)], "id long, x double, y double, kind long, weight long")
    f = GeoFrame(df, order=("id",), crs=CRS)
    for rule, allowed in ((lambda u, v: (u.weight < v.weight) & (v["kind"] == u.kind), lambda i, j: weight[i] < weight[j] and kind[i] == kind[j]), (lambda u, v: u.weight + 3 == v.weight, lambda i, j: weight[i] + 3 == weight[j])):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            got = pairs(gw.geo_watts_strogatz_network(f, 4, 0, random_state=3, constraint=rule))
        assert got == {(min(i, j), max(i, j)) for i, js in nearest_first(points, [2] * 200, 150, allowed).items() for j, _ in js}


@pytest.mark.parametrize("cap", [150, 7])
def test_rewiring_over_many_windows_is_that_in_order(spark, monkeypatch, cap):
    monkeypatch.setattr(resolve, "WINDOW_ROWS", 12)
    rng = random.Random(cap)
    n = 40
    edges = sorted({(i, (i + s) % n) for i in range(n) for s in (1, 2)})
    rank = {(i, j): 1 + (j - i) % n for i, j in edges}
    events = [e for e in edges if rng.random() < 0.7]
    choices = {e: rng.sample([c for c in range(n) if c != e[0]], 3) if e[0] % 5 else [e[1]] for e in events}
    every = {e: rng.sample([c for c in range(n) if c != e[0]], n - 1) for e in events}

    def in_order(lists):
        tied = {(min(e), max(e)) for e in edges}
        degree = [sum(v in e for e in tied) for v in range(n)]
        out = {}
        for i, j in sorted(events, key=lambda e: (e[0], rank[e])):
            c = next((c for c in lists[i, j] if (min(i, c), max(i, c)) not in tied and degree[c] < cap), None)
            out[i, rank[i, j]] = c
            if c is not None:
                tied = tied - {(min(i, j), max(i, j))} | {(min(i, c), max(i, c))}
                degree[j] -= 1
                degree[c] += 1
        return out

    table = lambda lists, of: spark.createDataFrame([(i, rank[i, j], k, c) for (i, j) in of for k, c in enumerate(lists[i, j])], "i long, rank long, at long, c long")
    with shared.Tables(spark) as tables:
        wiring = resolve.Rewiring(spark.createDataFrame([(*e, rank[e]) for e in edges], "i long, j long, rank long"), cap, n, tables)
        got = {(r["i"], r["rank"]): r["c"] for r in wiring.run(spark.createDataFrame([(*e, rank[e]) for e in events], "i long, j long, rank long"), table(choices, events)).collect()}
        assert got == in_order(choices)
        short = [e for e in events if got[e[0], rank[e]] is None]
        assert short
        got = {(r["i"], r["rank"]): r["c"] for r in wiring.resume(table(every, short)).collect()}
        assert got == in_order({e: every[e] if e in short else choices[e] for e in events})


def test_er_without_room_has_no_nodes(grid):
    with pytest.warns(UserWarning, match="No edges were created"):
        g = gw.geo_erdos_renyi_network(grid, max_degree=0, random_state=1)
    assert g.nodes.count() == 0


def test_er_thinned_has_the_same_law(grid):
    """The mean number of edges of both methods, over seeds, within four deviations."""
    n = {m: [gw.geo_erdos_renyi_network(grid, a=3, max_degree=1000, random_state=s, method=m, scaling_factor=1.0).edges.count() for s in range(4)] for m in ("exact", "thinned")}
    a, b = (sum(v) / len(v) for v in n.values())
    assert abs(a - b) < 4 * (2 * a / 4) ** 0.5


def test_constraint_spellings_and_fallback(grid):
    native = gw.geo_erdos_renyi_network(grid, max_degree=99, random_state=1, constraint=lambda u, v: u.group != v["group"])
    spelt = gw.geo_erdos_renyi_network(grid, max_degree=99, random_state=1, constraint=lambda u, v: u.group != v.group and u["group"] != v.group)
    python = gw.geo_erdos_renyi_network(grid, max_degree=99, random_state=1, constraint=lambda u, v: len({u.group, v.group}) == 2)
    assert pairs(native) == pairs(spelt) == pairs(python)
    own = {r["node_pos"]: r["group"] for r in native.nodes.collect()}
    assert all(own[i] != own[j] for i, j in pairs(native))


LIMITS = {"A": 3, "B": 5}


def test_constraints_are_translated_from_their_source(spark):
    from geoweft.operators import constraint as C

    few = ("A", "B")
    names = ["group", "size", "name"]

    def spelt_out(u, v):
        """A function of its own."""
        return u.size < v.size if u.group in few else not (u.size == v.size or v["size"] > 7)

    same = [
        (lambda u, v: u.group == v.group and u.size < v.size, lambda u, v: (u.group == v.group) & (u.size < v.size)),
        (lambda u, v: not (u.group == v.group or u.size < v.size), lambda u, v: ~((u.group == v.group) | (u.size < v.size))),
        (lambda u, v: 1 < u.size <= v.size < LIMITS["B"], lambda u, v: (u.size > 1) & (u.size <= v.size) & (v.size < 5)),
        (lambda u, v: u.group in few and v.group not in {"C"}, lambda u, v: u.group.isin("A", "B") & ~v.group.isin("C")),
        (lambda u, v: u.name is None and abs(u.size - v.size) <= 2, lambda u, v: u.name.isNull() & (F.abs(u.size - v.size) <= 2)),
        (lambda u, v: u.name.startswith("x") and v.group.lower() != "a", lambda u, v: F.startswith(u.name, F.lit("x")) & (F.lower(v.group) != "a")),
        (spelt_out, lambda u, v: F.when(F.coalesce(u.group.isin("A", "B"), F.lit(False)), u.size < v.size).otherwise(~((u.size == v.size) | (v.size > 7)))),
    ]
    for written, meant in same:
        got, want = (C.resolve(c, names) for c in (written, meant))
        assert str(got[0]) == str(want[0]) and got[1] == want[1]
    for odd in (lambda u, v: u.size and v.size > 2, lambda u, v: u.group == None or v.size > 1, lambda u, v: u.group in v.name, lambda u, v: sum((u.size, v.size)) > 3 and True, lambda u, v: any(x > 1 for x in (u.size, v.size))):  # noqa: E711
        assert "resolve.<locals>.rows" in str(C.resolve(odd, names)[0]) or "rows(" in str(C.resolve(odd, names)[0])
    rows = [("A", 1, "x"), ("B", 4, None), ("C", 9, "y"), (None, 5, "xy"), ("B", 2, "x")]
    t = spark.createDataFrame(rows, "group string, size long, name string")
    pairs_ = t.select(*(F.col(c).alias(f"u_{c}") for c in names)).crossJoin(t.select(*(F.col(c).alias(f"v_{c}") for c in names)))
    for written, _ in same:
        kept = {(tuple(r[:3]), tuple(r[3:])) for r in pairs_.where(C.resolve(written, names)[0]).collect()}
        for x in rows:
            for y in rows:
                if None not in x + y:
                    assert ((x, y) in kept) == bool(written(C.Row(dict(zip(names, x))), C.Row(dict(zip(names, y)))))


def test_ws_mean_degree_is_k(grid):
    for p in (0.0, 0.5):
        g = gw.geo_watts_strogatz_network(grid, 2, p, id_col="id", random_state=4)
        assert analytics.summary(g).first()["mean_degree"] == 2 and sound(g, 150)


def test_ws_expected_degree_column_and_constraint(grid):
    g = gw.geo_watts_strogatz_network(grid, "expected_degree", 0.1, random_state=2, constraint=lambda u, v: u.group == v.group)
    own = {r["node_pos"]: r["group"] for r in g.nodes.collect()}
    assert sound(g, 150) and all(own[i] == own[j] for i, j in pairs(g))


def test_ws_rewiring_lengthens_edges_and_keeps_their_number(grid):
    a, b = (gw.geo_watts_strogatz_network(grid, 4, p, a=1, random_state=2).edges.agg(F.count("*"), F.max("length")).first() for p in (0, 1))
    assert a[0] == b[0] == 200 and b[1] > a[1]


def test_ws_cap(grid):
    assert sound(gw.geo_watts_strogatz_network(grid, 4, 0.3, max_degree=6, random_state=2), 6)


@pytest.mark.parametrize(("k", "p"), [(0, 0.1), (4, 1.5), (4, -0.1), (None, 0.1)])
def test_ws_rejects(grid, k, p):
    with pytest.raises(ValueError):
        gw.geo_watts_strogatz_network(grid, k, p)


def test_ba_orders_caps_and_groups(grid):
    g = gw.geo_barabasi_albert_network(grid, 2, max_degree=8, random_state=1, node_order=lambda f: gw.density_order(f, method="KNN", k=3))
    assert g.edges.count() == 1 + 2 * 98 and sound(g, 9)
    parts = gw.geo_barabasi_albert_network(grid, 2, random_state=1, group="group")
    own = {r["node_pos"]: r["group"] for r in parts.nodes.collect()}
    assert all(own[i] == own[j] for i, j in pairs(parts))
    with pytest.raises(ValueError, match=r"Number of nodes \(100\) must be at least m \(101\)"):
        gw.geo_barabasi_albert_network(grid, 101)
    with pytest.raises(ValueError, match="was not found"):
        gw.geo_barabasi_albert_network(grid, 2, node_order="nothing")
    with pytest.raises(ValueError, match="same length"):
        gw.geo_barabasi_albert_network(grid, 2, node_order=lambda f: gw.random_order(f, 1).limit(5))


def test_constraints_on_growth_as_arrays_and_one_by_one(grid):
    native = gw.geo_barabasi_albert_network(grid, 2, random_state=1, constraint=lambda u, v: u.group != v["group"])
    python = gw.geo_barabasi_albert_network(grid, 2, random_state=1, constraint=lambda u, v: u.group != v.group and True)
    assert pairs(native) == pairs(python) and native.edges.count() > 100


def test_ids(grid, spark):
    assert gw.geo_erdos_renyi_network(grid, id_col="index", random_state=1).meta["index_name"] == "id"
    with pytest.raises(ValueError, match="unique"):
        gw.geo_erdos_renyi_network(grid, id_col="group")
    with pytest.raises(ValueError, match="Multi-index"):
        gw.geo_erdos_renyi_network(GeoFrame(grid.df, index=("id", "group"), crs=CRS), id_col="index")
    with pytest.raises(KeyError):
        gw.geo_erdos_renyi_network(grid, id_col="nothing")


def test_crs_warnings(grid):
    for crs, text in ((None, "no CRS"), ("EPSG:4326", "geographic")):
        with pytest.warns(UserWarning, match=text):
            gw.geo_erdos_renyi_network(GeoFrame(grid.df, order=("id",), crs=crs), random_state=1)


def test_coordinate_systems():
    from geoweft.functions.crs import is_geographic

    for crs in (4326, "EPSG:4326", "epsg:4283", "EPSG:4490", "EPSG:4617", "EPSG:7844", "urn:ogc:def:crs:EPSG::4326", "OGC:CRS84", "+proj=longlat +datum=WGS84", 'GEOGCRS["WGS 84"]', {"type": "GeographicCRS"}, "urn:ogc:def:crs:OGC:1.3:CRS84"):
        assert is_geographic(crs), crs
    for crs in (3857, "EPSG:3857", "EPSG:32633", "EPSG:4087", "EPSG:4978", "ESRI:54009", "+proj=utm +zone=33", 'PROJCRS["x", BASEGEOGCRS["WGS 84"]]', '{"type": "ProjectedCRS"}'):
        assert not is_geographic(crs), crs
    for crs in ("garbage", "EPSG:", "EPSG:abc", "OGC:X", 'POINT(1 2)', "{", "+x=1", 1.5, ""):
        with pytest.raises(ValueError, match="coordinate reference system"):
            is_geographic(crs)


def test_columns_of_any_name(grid):
    names = ("_part", "_row", "_x", "_y", "_shift", "rank", "part", "row", "shift", "px", "pos", "t", "i", "j", "length", "k", "c0", "r", "graph")
    df = grid.df.withColumns({n: F.lit("own") for n in names})
    f = GeoFrame(df, order=("id",), crs=CRS)
    graphs = [
        gw.geo_erdos_renyi_network(f, id_col="id", random_state=1, constraint=lambda u, v: u["rank"] == v["_part"]),
        gw.geo_watts_strogatz_network(f, 4, 0.1, id_col="id", random_state=1, constraint=lambda u, v: u["k"] == v["i"]),
        gw.geo_barabasi_albert_network(f, 2, id_col="id", random_state=1, node_order="id", constraint=lambda u, v: u["rank"] == v["t"]),
    ]
    for g in graphs:
        assert g.edges.count() > 50 and set(names) <= set(g.nodes.columns) and {r["rank"] for r in g.nodes.collect()} == {"own"}
        nodes, _ = gw.graph_to_gdf(g)
        assert set(names) <= set(nodes.columns)
    with pytest.raises(ValueError, match="node_pos"):
        gw.random_order(GeoFrame(grid.df.withColumn("node_pos", F.lit(1)), crs=CRS))


def test_lines_and_several_polygons(spark):
    square = lambda a, s: [[(a, a), (a + s, a), (a + s, a + s), (a, a + s)]]
    point = "struct<x:double,y:double>"
    many = GeoFrame(spark.createDataFrame([(1, [square(0.0, 2.0), square(10.0, 4.0)]), (2, [square(4.0, 2.0)])], f"id long, geometry array<array<array<{point}>>>"), order=("id",), crs=CRS)
    g = gw.geo_erdos_renyi_network(many, id_col="id", scaling_factor=0.01, random_state=1)
    assert [(r["x"], r["y"]) for r in g.nodes.orderBy("node_pos").collect()] == [((4 * 1 + 16 * 12) / 20,) * 2, (5.0, 5.0)]
    assert gw.graph_to_gdf(g)[1].first()["x2"] == 5.0
    parts = gw.exploded(many, "part")
    assert parts.shape == "polygon" and [(r["id"], r["part"]) for r in parts.df.orderBy("id", "part").collect()] == [(1, 0), (1, 1), (2, 0)]
    lines = GeoFrame(spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]), (2, [(7.0, 7.0)])], f"id long, geometry array<{point}>"), order=("id",), crs=CRS)
    g = gw.geo_erdos_renyi_network(lines, id_col="id", scaling_factor=0.01, random_state=1)
    assert [(r["x"], r["y"]) for r in g.nodes.orderBy("node_pos").collect()] == [(3.0, 1.0), (7.0, 7.0)]
    from geoweft.operators.frame import find_scaling_factor

    assert find_scaling_factor(lines) == pytest.approx(20 / 98**0.5) and find_scaling_factor(many) == pytest.approx(20 / (2 * 14**2) ** 0.5)
    with pytest.raises(ValueError, match="geometry must be"):
        GeoFrame(spark.createDataFrame([(1, [1.0])], "id long, geometry array<double>")).shape


def test_verbose_and_missing_geometry(grid, capsys):
    g = gw.geo_watts_strogatz_network(grid, 4, 0.5, a=1, id_col="id", random_state=2, verbose=True)
    said = capsys.readouterr().err
    assert "100 nodes, 200 edges, mean degree 4.00" in said and "edges rewired" in said
    lost = gw.GeoGraph(g.nodes.withColumn("x", F.when(F.col("node_id") != 7, F.col("x"))), g.edges, g.meta)
    with pytest.raises(RuntimeError, match="Cannot reconstruct geometry for node 7"):
        gw.graph_to_gdf(lost)
    with pytest.raises(RuntimeError, match="edge endpoint 7"):
        gw.graph_to_gdf(lost, nodes=False)
    with pytest.warns(UserWarning, match="fewer neighbors than expected"):
        gw.geo_watts_strogatz_network(grid, 40, 0, max_degree=21, random_state=1)


def test_orders_of_close_values(spark):
    """Coordinates in units far below one: order isn't lost to rounding."""
    rows = [(k, 1e-12 * k * k, 0.0) for k in range(30)]
    f = GeoFrame(spark.createDataFrame(rows, "id long, x double, y double"), order=("id",), crs=CRS)
    assert [r["node_pos"] for r in gw.density_order_knn(f, 1).orderBy("rank").collect()] == list(range(30))


def test_nearest_points_of_crowds_and_outliers(spark):
    """One outlier and two crowds, one of them at a single place: as brute force has it, by ever finer grids."""
    from geoweft.operators.spatial import knn_join

    rng = random.Random(2)
    points = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(150)] + [(500.0, 500.0)] * 130 + [(1e6, 1e6)] + [(rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(20)]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "node_pos long, x double, y double")
    want = set()
    for i, (x, y) in enumerate(points):
        order = sorted((((x - u) * (x - u) + (y - v) * (y - v)) ** 0.5, j) for j, (u, v) in enumerate(points) if j != i)
        want |= {(i, j, r) for r, (_, j) in enumerate(order[:3], 1)}
    got = knn_join(df, 3).collect()
    assert {(r["node_pos"], r["nbr"], r["rank"]) for r in got} == want and len(got) == len(want)


def test_string_index(grid):
    f = GeoFrame(grid.df.withColumn("name", F.concat(F.lit("node_"), F.col("id"))), order=("id",), index=("name",), crs=CRS)
    g = gw.geo_watts_strogatz_network(f, 4, 0, id_col="index", random_state=1)
    assert g.meta["index_name"] == "name" and {r["node_id"] for r in g.nodes.collect()} == {f"node_{k}" for k in range(100)}


def test_growth_in_order_of_arrival(grid, spark, tmp_path):
    """Two files, the second with late events and a key that is no node's; nodes without events come last."""
    from geoweft.streaming.arrivals import arrival_order, arrived, first_arrivals

    schema = "who long, at timestamp"
    write = lambda rows: spark.createDataFrame(rows, "who long, s long").selectExpr("who", "timestamp_seconds(s) at").coalesce(1).write.mode("append").parquet(str(tmp_path))
    write([(5, 50), (7, 70), (5, 90), (None, 1)])
    write([(7, 20), (9, 60), (1000, 5), (3, None)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    table = arrived(spark, first_arrivals(stream, "who", "at"))
    order = [r["node_pos"] for r in arrival_order(grid, table, "id").orderBy("rank").collect()]
    assert order == [7, 5, 9, *(k for k in range(100) if k not in (5, 7, 9))]
    g = gw.geo_barabasi_albert_network(grid, 2, random_state=1, node_order=lambda f: arrival_order(f, table, "id"))
    assert (5, 7) in pairs(g)


def test_polygons_and_export(squares):
    g = gw.geo_erdos_renyi_network(squares, scaling_factor=0.01, id_col="id", random_state=1)
    nodes, edges = gw.graph_to_gdf(g)
    assert [(r["x"], r["y"]) for r in g.nodes.orderBy("node_pos").collect()] == [(1, 1), (4, 4), (7, 7)]
    assert nodes.columns == ["group", "geometry", "id"]
    row = edges.where("source = 0 and target = 1").first()
    assert (row["x1"], row["y1"], row["x2"], row["y2"]) == (1, 1, 4, 4)
    assert gw.graph_to_gdf(g, edges=False)[1] is None
    with pytest.raises(ValueError, match="At least one layer"):
        gw.graph_to_gdf(g, nodes=False, edges=False)


def test_orders(grid, spark):
    ranks = lambda df: [r["node_pos"] for r in df.orderBy("rank").collect()]
    assert sorted(ranks(gw.random_order(grid, 5))) == list(range(100)) and ranks(gw.random_order(grid, 5)) == ranks(gw.random_order(grid, 5))
    assert ranks(gw.attribute_order(grid, "id", ascending=False)) == list(range(99, -1, -1))
    five = GeoFrame(spark.createDataFrame([(5 * x + y, float(x), float(y)) for x in range(5) for y in range(5)], "id long, x double, y double"), order=("id",), crs=CRS)
    order = ranks(gw.density_order_kde(five))
    far = [((k // 5 - 2) ** 2 + (k % 5 - 2) ** 2) for k in order]
    assert order[0] == 12 and far == sorted(far)
    for bad in ({"k": 0}, {"k": 25}):
        with pytest.raises(ValueError):
            gw.density_order_knn(five, **bad)
    with pytest.raises(ValueError, match="Use 'knn' or 'kde'"):
        gw.density_order(five, method="invalid")
    with pytest.raises(KeyError):
        gw.attribute_order(five, "invalid")


def test_samples(spark):
    holed = [[(0, 0), (5, 0), (5, 5), (0, 5)], [(2, 2), (3, 2), (3, 3), (2, 3)]]
    got = gw.sample_points(200, polygon=holed, random_state=1, spark=spark).df
    assert got.count() == 200 and got.where("x > 2 and x < 3 and y > 2 and y < 3").isEmpty()
    two = gw.sample_points(50, polygon=[[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(2, 2), (3, 2), (3, 3), (2, 3)]]], random_state=1, spark=spark).df
    assert two.where("not ((x <= 1 and y <= 1) or (x >= 2 and y >= 2))").isEmpty()
    one = lambda: [tuple(r) for r in gw.sample_points(25, bbox=(0, 0, 1, 1), sampler=lambda g, k: g.normal(0.4, 0.4, (k, 2)), random_state=3, spark=spark).df.collect()]
    assert one() == one() and all(0 <= x <= 1 and 0 <= y <= 1 for _, x, y in one())


def inside(x, y, rings):
    sides = [(p, q) for r in rings for p, q in zip(r, [*r[1:], *r[:1]])]
    on = any((q[0] - p[0]) * (y - p[1]) == (q[1] - p[1]) * (x - p[0]) and min(p[0], q[0]) <= x <= max(p[0], q[0]) and min(p[1], q[1]) <= y <= max(p[1], q[1]) for p, q in sides)
    return on or sum((p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in sides) % 2 == 1


def test_covering_of_polygons_of_many_sides(spark):
    """Stars, combs with sides from bottom to top, a square with a hole, a point of its own; points on corners, twice, and outside."""
    from math import cos, pi, sin

    from geoweft.operators.coverage import covering

    star = [(10 * (1 + k % 2) * cos(pi * k / 150), 10 * (1 + k % 2) * sin(pi * k / 150)) for k in range(300)]
    comb = [(float(k), 0.0 if k % 2 else 16.0) for k in range(64)] + [(63.0, -1.0), (0.0, -1.0)]
    square = [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)], [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]]
    polygons = [(0, [star]), (1, [comb]), (2, square), (3, [[(1.0, 1.0)]])]
    rng = random.Random(3)
    points = [(k, rng.uniform(-20, 64), rng.uniform(-20, 20)) for k in range(400)] + [(1000 + k, *p) for k, p in enumerate([*star[:20], *comb[:20], (3.0, 3.0), (2.0, 3.0), (1.0, 1.0), (1.0, 1.0), (8.0, 4.0)])]
    a = spark.createDataFrame(points, "id long, x double, y double")
    b = spark.createDataFrame(polygons, "polygon long, rings array<array<struct<x:double,y:double>>>")
    got = sorted((r["id"], r["polygon"]) for r in covering(a, b, "polygon").collect())
    assert got == sorted((i, p) for i, x, y in points for p, rings in polygons if inside(x, y, rings))
    own = a.withColumn("polygon", F.col("id") % 3)
    got = sorted((r["id"], r["polygon"]) for r in covering(own, b, "polygon", own=True).collect())
    assert got == sorted((i, i % 3) for i, x, y in points if inside(x, y, polygons[i % 3][1]))


def test_samples_within_polygons_of_a_table(spark):
    from math import cos, pi, sin

    square = [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)], [(1.0, 1.0), (7.9, 1.0), (7.9, 7.9), (1.0, 7.9)]]
    round_ = [[(cos(pi * k / 60), sin(pi * k / 60)) for k in range(120)]]
    df = spark.createDataFrame([(0, square, 5000), (1, round_, 70), (2, square, 0)], "id long, geometry array<array<struct<x:double,y:double>>>, n long")
    f = GeoFrame(df, order=("id",), crs=CRS)
    got = gw.sample_within(f, "n", random_state=1).df.collect()
    shapes = {0: square, 1: round_}
    assert sorted((r["within"], r["i"]) for r in got) == [(0, i) for i in range(5000)] + [(1, i) for i in range(70)]
    assert all(inside(r["x"], r["y"], shapes[r["within"]]) for r in got) and len({(r["x"], r["y"]) for r in got}) == len(got)
    with pytest.raises(RuntimeError, match="Unable to sample"):
        gw.sample_within(f, "n", random_state=1, max_attempts=5001)
    with pytest.raises(ValueError, match="positive area"):
        gw.sample_within(GeoFrame(spark.createDataFrame([(0, [[(0.0, 0.0), (1.0, 1.0)]])], "id long, geometry array<array<struct<x:double,y:double>>>"), order=("id",)), 3)
    many = gw.sample_points(60, polygon=round_, random_state=1, spark=spark).df.collect()
    assert len(many) == 60 and all(inside(r["x"], r["y"], round_) for r in many)


@pytest.mark.parametrize(
    ("args", "error", "text"),
    [
        ({"n": 0, "bbox": (0, 0, 1, 1)}, ValueError, "n must be a positive integer"),
        ({"n": 1, "bbox": (0, 0, 1, 1), "crs": "nonsense"}, ValueError, "coordinate reference system"),
        ({"n": 1}, ValueError, "At least one of bbox or polygon must be provided"),
        ({"n": 1, "bbox": (0, 0, 1)}, ValueError, "bbox must be a sequence of 4 values"),
        ({"n": 1, "bbox": (1, 0, 0, 1)}, ValueError, "bbox ordering"),
        ({"n": 1, "bbox": ("a", 0, 0, 1)}, ValueError, "numeric"),
        ({"n": 1, "bbox": (float("nan"), 0, 0, 1)}, ValueError, "finite"),
        ({"n": 1, "polygon": "square"}, ValueError, "polygon must be"),
        ({"n": 1, "polygon": []}, ValueError, "non-empty"),
        ({"n": 1, "polygon": [[(0, 0), (1, 1), (2, 2)]]}, ValueError, "positive area"),
        ({"n": 1, "bbox": (0, 0, 1, 1), "max_attempts": 0}, ValueError, "max_attempts must be a positive integer"),
        ({"n": 1, "bbox": (0, 0, 1, 1), "sampler": 3}, ValueError, "sampler must be callable or None"),
        ({"n": 1, "bbox": (0, 0, 1, 1), "sampler": lambda g, k: [[1.0]]}, ValueError, "exact shape"),
        ({"n": 1, "bbox": (0, 0, 1, 1), "sampler": lambda g, k: g.random((k, 2)) + 9, "max_attempts": 99}, RuntimeError, "Unable to sample"),
    ],
)
def test_sample_errors(spark, args, error, text):
    with pytest.raises(error, match=text):
        gw.sample_points(args.pop("n"), spark=spark, random_state=0, **args)
