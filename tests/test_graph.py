import pytest

from tileflow.errors import DuplicateKey, FormatError, NotFound, OutOfRange
from tileflow.operators.graph import Graph, graph
from tileflow.sources import sinks, text

SMALL = [(0, 1), (1, 2), (1, 3), (2, 3), (2, 0), (3, 0)]
TILES = {0: 0, 1: 0, 2: 1, 3: 1}


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def small(spark):
    return graph(spark, SMALL, TILES).check(2)


def test_tiles_and_mirrors(small):
    assert pairs(small.vertices, "id", "tile") == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert pairs(small.tile_edges(0), "src", "dst") == [(0, 1), (1, 2), (1, 3)]
    assert pairs(small.mirrors(), "tile", "vid", "master_tile", "acc_deg") == [(0, 2, 1, 1), (0, 3, 1, 1), (1, 0, 0, 2)]
    assert pairs(small.tile_counts(), "tile", "vertices", "edges", "mirrors") == [(0, 2, 3, 2), (1, 2, 3, 1)]


def test_degrees(small):
    assert pairs(small.out_degrees(), "id", "out_deg") == [(0, 1), (1, 2), (2, 2), (3, 1)]
    assert pairs(small.local_in_degrees(), "id", "in_deg") == [(0, 0), (1, 1), (2, 0), (3, 1)]
    assert pairs(small.in_degrees(), "id", "in_deg") == [(0, 2), (1, 1), (2, 1), (3, 2)]


def test_duplicate_vertex_and_lost_ends(spark, small):
    again = spark.createDataFrame([(0, 0)], "id long, tile int")
    with pytest.raises(DuplicateKey):
        small.add_vertices(again).check()
    with pytest.raises(NotFound):
        small.add_edges(spark.createDataFrame([(0, 9, 1)], "src long, dst long, weight long")).check()
    with pytest.raises(NotFound):
        graph(spark, [(0, 9)], TILES)
    lenient = Graph.from_partition(spark.createDataFrame([(0, 9, 1)], "src long, dst long, weight long"), spark.createDataFrame([(0, 1)], "vid long, tile int"), lenient=True)
    assert pairs(lenient.vertices, "id", "tile") == [(0, 1), (9, 0)]
    with pytest.raises(OutOfRange):
        graph(spark, [(0, 1)], {0: 0, 1: 2}).check()


def test_added_edge_is_found_and_sorted(spark, small):
    more = small.add_edges(spark.createDataFrame([(0, 0, 7)], "src long, dst long, weight long"))
    assert [tuple(r) for r in more.sorted_edges().limit(2).collect()] == [(0, 0, 7), (0, 1, 1)]
    assert small.edges.count() == 6


def test_padding_changes_no_minimum(small):
    from pyspark.sql import functions as F

    assert pairs(small.padded_degrees(), "id", "padded_deg") == [(0, 2), (1, 1), (2, 1), (3, 2)]
    padded = small.padded_edges().where("NOT is_dummy").groupBy("dst").agg(F.min("src").alias("m"))
    assert pairs(padded, "dst", "m") == pairs(small.edges.groupBy("dst").agg(F.min("src").alias("m")), "dst", "m")


def test_mirrors_are_padded_with_their_first_source(spark):
    from tileflow.plans import algorithms as alg
    from tileflow.plans.supersteps import run
    from dataclasses import replace

    from pyspark.sql import functions as F

    g = graph(spark, [(4, 1), (0, 1), (2, 1), (0, 3), (1, 0), (3, 5)], {0: 0, 2: 0, 4: 0, 1: 1, 3: 1, 5: 1})
    assert pairs(g.mirror_dummies(), "src", "dst", "weight", "tile", "slot") == [(0, 1, -1, 0, 4)]
    kernel = alg.sssp(0, 4)
    padded = replace(kernel, edges=lambda g: g.padded_edges(), valid=lambda step: ~F.col("is_dummy") & F.col("dist").isNotNull())
    assert sorted(map(repr, run(g, padded).select("id", "dist", "pred").collect())) == sorted(map(repr, run(g, kernel).select("id", "dist", "pred").collect()))
    assert pairs(g.merged_in_pairs(), "dst", "updates", "rounds") == [(0, 1, 0), (1, 3, 2), (3, 1, 0), (5, 1, 0)]
    assert pairs(g.traffic(8), "src_tile", "dst_tile", "phase", "rounds", "messages", "bytes") == [(0, 1, "gather", 1, 2, 16), (0, 1, "premerge", 2, 3, 24), (0, 1, "scatter", 1, 2, 16), (1, 0, "gather", 1, 1, 8), (1, 0, "premerge", 0, 0, 0), (1, 0, "scatter", 1, 1, 8)]


def test_tiles_by_expression_or_by_table_are_the_same(spark, small):
    from pyspark.sql import functions as F

    from tileflow.operators.graph import Graph

    by_id = Graph.from_edges(small.edges, F.floor(F.col("id") / 2))
    columns = ("src", "dst", "weight", "src_tile", "dst_tile")
    assert pairs(by_id.tiled_edges(), *columns) == pairs(small.tiled_edges(), *columns)
    assert by_id.tiled_edges()._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_a_finished_graph_takes_nothing_more(spark, small):
    from tileflow.errors import Frozen

    done = small.freeze()
    with pytest.raises(Frozen):
        done.add_edges(small.edges)
    with pytest.raises(Frozen):
        done.add_vertices(small.vertices)


def test_empty_graph(spark):
    g = graph(spark, []).check()
    assert g.out_degrees().count() == g.mirrors().count() == g.positions_by_degree().count() == 0


@pytest.fixture
def files(tmp_path):
    def write(name, content):
        (tmp_path / name).write_text(content)
        return str(tmp_path / name)

    return write


def test_edge_lists(spark, files):
    path = files("e", "# a comment\n0 1\n\n1\t2 5 ignored\n  2   0\n")
    assert pairs(text.read_edges(spark, path), "src", "dst", "weight") == [(0, 1, 1), (1, 2, 5), (2, 0, 1)]
    loop = files("l", "4 4\n")
    assert pairs(text.read_edges(spark, loop, default_weight=3, undirected=True), "src", "dst", "weight") == [(4, 4, 3), (4, 4, 3)]
    bad = files("b", "1 2\nx 3\n")
    with pytest.raises(FormatError):
        text.read_edges(spark, bad)
    assert text.read_edges(spark, bad, strict=False).count() == 1


def test_partitions(spark, files):
    path = files("p", "0 0\n1 1\n2 2\n3 3\n")
    assert pairs(text.read_partition(spark, path, 2, merge=2), "vid", "tile") == [(0, 0), (1, 0), (2, 1), (3, 1)]
    with pytest.raises(OutOfRange):
        text.read_partition(spark, path, 2)
    with pytest.raises(DuplicateKey):
        text.read_partition(spark, files("d", "0 0\n0 1\n"), 2)
    with pytest.raises(FormatError):
        text.read_partition(spark, files("f", "0\n"), 2)


def test_other_formats(spark, files):
    assert pairs(text.read_ratings(spark, files("r", "#c\n1\t100\t4.5\n")), "user", "movie", "rating") == [(1, 100, 4.5)]
    with pytest.raises(FormatError):
        text.read_ratings(spark, files("r2", "1\t100\n"))
    assert pairs(text.read_csv_edges(spark, files("c", "1,,2,9\n3,4\n")), "src", "dst") == [(1, 2), (3, 4)]
    log = files("m", "﻿::scatter 1.5\nnoise\n::scatter 2.5\n>>sent 7\n")
    assert pairs(text.read_metrics(spark, log), "tag", "value") == [("scatter", 1.5), ("scatter", 2.5)]
    assert pairs(text.read_metrics(spark, log, ">>"), "tag", "value") == [("sent", 7.0)]
    found = text.read_sections(spark, files("s", "head\n>>>> one\n| a | b |\n| 1 | 2 |\n>>>> two\nc|d\n")).orderBy("section", "position").collect()
    assert [(r.section, r.cells) for r in found] == [("one", ["a", "b"]), ("one", ["1", "2"]), ("two", ["c", "d"])]


def test_text_results(spark, tmp_path):
    from pyspark.sql import functions as F

    v = spark.createDataFrame([(0, 0, 0, None), (1, 1, 4, 0), (2, 1, None, None)], "id long, tile int, dist long, pred long")
    path = str(tmp_path / "out")
    sinks.write_results(v, sinks.path_text(F.col("dist"), F.col("pred")), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["0\tCan not reach <- none", "1\t4 \t<- 0", "2\tCan not reach <- none"]
    e = spark.createDataFrame([(1, 2, 3)], "src long, dst long, weight long")
    sinks.write_edges(e, str(tmp_path / "edges"))
    assert pairs(text.read_edges(spark, str(tmp_path / "edges")), "src", "dst", "weight") == [(1, 2, 3)]
    sinks.write_partition(spark.createDataFrame([(1, 0)], "vid long, tile int"), str(tmp_path / "part"))
    assert pairs(text.read_partition(spark, str(tmp_path / "part"), 1), "vid", "tile") == [(1, 0)]
    assert spark.range(1).select(sinks.vector_text(F.array(F.lit(1.5), F.lit(2.0)))).first()[0] == "1.5 2.0"
