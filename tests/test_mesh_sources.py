import pytest
from pyspark.sql import functions as F

from tests.helpers import column, graph
from weftgraph.functions import numeric, strings
from weftgraph.operators.mesh import Mesh
from weftgraph.sources import text, vtu

FLAT = [(1, 0), (3, 0), (5, 0), (7, 0), (2, 1), (4, 1), (6, 1), (1, 2), (3, 2), (5, 2), (7, 2)]
TRIANGLES = [(1, 2, 5), (2, 3, 6), (7, 3, 4), (1, 5, 8), (5, 6, 2), (5, 8, 9), (5, 6, 9), (6, 9, 10), (10, 11, 7), (4, 11, 7)]
SOLID = [(1, 0, 0), (0, 1, 0), (1, 1, 0), (0.5, 0.5, 0.9), (-0.5, -0.5, -0.5)]


def mesh(spark, spots, cells, is_3d=False):
    p = spark.createDataFrame([(i, float(x[0]), float(x[1]), float(x[2]) if is_3d else 0.0) for i, x in enumerate(spots, 1)], "id long, x double, y double, z double")
    return Mesh(p, spark.createDataFrame([(i, list(c)) for i, c in enumerate(cells, 1)], "id long, point_ids array<long>"), is_3d)


def test_flat_mesh(spark):
    m = mesh(spark, FLAT, TRIANGLES)
    m.validate()
    dual = m.dual_graph()
    assert dual.vertices.count() == 10 and dual.edges.count() == 9
    ordered = column(m.oriented(), "id", "point_ids")
    for c, given in zip(ordered, TRIANGLES):
        (ax, ay), (bx, by), (cx, cy) = (FLAT[i - 1] for i in c)
        assert set(c) == set(given) and c[0] == min(given) and (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0
    asked = spark.createDataFrame([(1, [5]), (2, [5, 6]), (3, [1, 11]), (4, [])], "query int, point_ids array<long>")
    got = {(r.query, r.cell) for r in m.find_cells(asked).collect()}
    assert got == {(1, c) for c in (1, 4, 5, 6, 7)} | {(2, 5), (2, 7)}
    assert column(m.neighbours(), "id", "neighbours")[0] == [4, 5]


def test_cells_are_found_without_a_count_over_what_met(spark):
    m = mesh(spark, FLAT, [(1, 2, 5), (1, 4, 5), (2, 3, 5)])
    asked = spark.createDataFrame([(1, [5, 1]), (2, [2]), (2, [2]), (3, []), (4, [1, None]), (5, [None, 1]), (6, [1, 3]), (7, [5, 5, 2]), (8, [99])], "query int, point_ids array<long>")
    found = m.find_cells(asked)
    assert sorted(set(map(tuple, found.collect()))) == [(1, 1), (1, 2), (2, 1), (2, 3), (7, 1), (7, 3)]  # a query asked twice is answered too
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_solid_mesh(spark):
    m = mesh(spark, SOLID, [(1, 2, 3, 4), (1, 2, 3, 5), (1, 2, 4, 5)], True)
    m.validate()
    assert m.dual_edges().count() == 3


def test_bad_meshes(spark):
    for cells in ([(1, 2, 3)], [(1, 2, 5), (5, 2, 1)], [(1, 2, 99)], [(1, 1, 5)]):
        with pytest.raises(ValueError):
            mesh(spark, FLAT, cells).validate()


def test_vtu_graph(spark, tmp_path):
    g = graph(spark, [(1, 2), (1, 3), (1, 4), (4, 5)])
    v = g.vertices.select("id", *(F.lit(float(i) / 3).alias(c) * F.col("id") for i, c in enumerate("xyz", 1)))
    v = g.vertices.select("id", (F.col("id") / 3).alias("x"), (F.col("id") * 2.0).alias("y"), F.lit(0.5).alias("z"), (F.col("id") / 7).alias("radius"), (F.col("id") + 199).alias("vtype"), *(F.col("id").cast("double").alias(f"v{c}") for c in "xyz"))
    e = g.edges.withColumn("flow", F.col("eid") / 9).withColumn("ctype", F.col("eid"))
    fields = [vtu.FieldSpec("velocity", ("vx", "vy", "vz"), "Float32"), vtu.FieldSpec("radius", ("radius",)), vtu.FieldSpec("vtype", ("vtype",), "UInt8"), vtu.FieldSpec("ctype", ("ctype",), "UInt8", "cell"), vtu.FieldSpec("flow", ("flow",), "Float64", "cell")]
    path = f"{tmp_path}/out.vtu"
    vtu.write_graph(type(g)(v, e), path, fields=fields, time=123.45)
    back = vtu.read_graph(spark, path, [*fields, vtu.FieldSpec("missing", ("m",))])
    assert vtu.read_time(spark, path) == pytest.approx(123.45, rel=1e-6)
    assert column(back.vertices, "id", "x") == pytest.approx([i / 3 for i in range(1, 6)], rel=1e-6)
    assert column(back.vertices, "id", "radius") == [i / 7 for i in range(1, 6)]
    assert column(back.vertices, "id", "vtype") == [200, 201, 202, 203, 204]
    assert [tuple(r) for r in back.edges.orderBy("eid").select("src", "dst", "flow").collect()] == [(1, 2, 1 / 9), (1, 3, 2 / 9), (1, 4, 3 / 9), (4, 5, 4 / 9)]


def test_vtu_meshes(spark, tmp_path):
    for name, m in (("flat", mesh(spark, FLAT, TRIANGLES)), ("solid", mesh(spark, SOLID, [(1, 2, 3, 4), (1, 2, 3, 5)], True))):
        m = Mesh(m.points, m.cells.withColumn("c", F.col("id") * 2.0), m.is_3d)
        vtu.write_mesh(m, f"{tmp_path}/{name}", [vtu.FieldSpec("c", ("c",), "Float64", "cell")])
        back = vtu.read_mesh(spark, f"{tmp_path}/{name}.vtu", [vtu.FieldSpec("c", ("c",), "Float64", "cell")])
        assert back.is_3d == m.is_3d and column(back.cells, "id", "point_ids") == column(m.cells, "id", "point_ids") and column(back.cells, "id", "c") == column(m.cells, "id", "c")


FIXTURE = """# a graph
EXPECTED_MAXFLOW 2.0 7.0
SOURCES 1
VERTICES
0 0 0
1 0 0

EDGES
1 2 10
3 2 5

# another
DIRECTED
EDGES
1 2
"""


def test_text_sources(spark, tmp_path):
    (tmp_path / "g.txt").write_text(FIXTURE)
    one, two = text.read_fixtures(spark, f"{tmp_path}/g.txt")
    assert one.values["EXPECTED_MAXFLOW"] == [2, 7] and not one.directed and two.directed and two.edges == [(1, 2, 1.0)]
    g = one.graph(spark)
    assert g.vertices.count() == 3 and column(g.edges, "eid", "weight") == [10, 5]
    (tmp_path / "n.txt").write_text("3\n\n-4\nx\n")
    assert column(text.read_numbers(spark, f"{tmp_path}/n.txt"), "line", "value") == [3, -4, None]
    assert column(text.read_strings(spark, f"{tmp_path}/n.txt"), "line", "value") == ["3", "", "-4", "x"]
    (tmp_path / "p.txt").write_text("ab\ncd\n")
    assert [tuple(r) for r in text.read_pattern(spark, f"{tmp_path}/p.txt").orderBy("row", "column").collect()] == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "d")]
    (tmp_path / "q.txt").write_text("ab\nc\n")
    with pytest.raises(ValueError):
        text.read_pattern(spark, f"{tmp_path}/q.txt")


def test_functions(spark):
    row = spark.sql("select ' a  b c ' as s, 1.0 as x, 1.0 + 1e-12 as y, array(3, 1, 3) as l").select(
        strings.split_all(F.col("s"), " ").alias("all"), strings.split_nonempty(F.col("s"), " ").alias("some"), strings.to_int(F.lit("7")).alias("i"), strings.to_long(F.lit("q")).alias("q"),
        numeric.near(F.col("x"), F.col("y"), 1e-9).alias("near"), numeric.compared(F.col("x"), F.lit(2.0), 1e-9).alias("cmp"), numeric.unique_sorted(F.col("l")).alias("u"), numeric.count_matches(F.col("l"), F.array(F.lit(3), F.lit(2), F.lit(3))).alias("m"),
    ).first()
    assert (row["all"], row.some, row.i, row.q, row.near, row.cmp, row.u, row.m) == (["", "a", "", "b", "c", ""], ["a", "b", "c"], 7, None, True, -1, [1, 3], 2)


def test_graph_changes(spark):
    g = graph(spark, [(1, 2), (2, 3), (3, 1), (3, 4)], directed=True)
    g.validate()
    part, vmap, emap = g.copy("id > 1")
    assert column(part.vertices, "id", "id") == [1, 2, 3] and [tuple(r) for r in part.edges.orderBy("eid").select("src", "dst").collect()] == [(1, 2), (2, 3)]
    less = g.remove_vertices(spark.createDataFrame([(3,)], "id long"))
    assert less.edges.count() == 2 and less.remove_orphaned_edges()[1] == 1
    with pytest.raises(ValueError):
        less.validate()
    more = g.add_vertices(spark.createDataFrame([(9,)], "id long")).add_edges(spark.createDataFrame([(7, 9, 1)], "eid long, src long, dst long"))
    assert more.edges.count() == 5 and more.remove_edges(spark.createDataFrame([(7,)], "eid long")).edges.count() == 4
    assert graph(spark, [(1, 2), (1, 3)]).remove_vertices(spark.createDataFrame([(2,)], "id long")).edges.count() == 1
    with pytest.raises(ValueError):
        graph(spark, [(1, 2), (2, 1)]).validate()
    assert {(r.a, r.b): r.eid for r in g.find_edges(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long")).collect()} == {(1, 2): 1, (2, 1): None}


def test_lines_over_blocks(spark, tmp_path):
    """Numbers of lines hold over the blocks that tasks read, and over files in order of their paths."""
    lines = [f"{i} " + "é" * (i % 7) if i % 11 else "" for i in range(500)]
    (tmp_path / "one.txt").write_bytes("\r\n".join(lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = {r.line: r.value for r in text.read_strings(spark, str(tmp_path / "one.txt")).collect()}
        blocks = {r.block: r.lines for r in text.count_lines_block(spark, str(tmp_path / "one.txt")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(lines, 1)) and text.count_lines(spark, str(tmp_path / "one.txt")) == 500
    ends = [i for i, x in enumerate(lines) if not x]
    assert blocks == {k: b - a - 1 for k, (a, b) in enumerate(zip([-1, *ends], [*ends, 500]), 1)}
    (tmp_path / "two.txt").write_text("x\n\n")
    assert [r.value for r in text.read_strings(spark, str(tmp_path / "*.txt")).orderBy("line").collect()] == [*lines, "x", ""]
    (tmp_path / "empty").write_text("")
    assert text.read_strings(spark, str(tmp_path / "empty")).isEmpty() and [tuple(r) for r in text.count_lines_block(spark, str(tmp_path / "empty")).collect()] == [(1, 0)]
