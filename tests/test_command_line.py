import pytest

from tileflow.__main__ import main
from tileflow.sources import text


@pytest.fixture
def files(tmp_path):
    (tmp_path / "e").write_text("0 1\n1 2\n1 3\n2 3\n2 0\n3 0\n")
    (tmp_path / "p").write_text("0 0\n1 0\n2 1\n3 1\n")
    (tmp_path / "c.csv").write_text("1,2,x\n3,4\n")
    (tmp_path / "log").write_text("::Gather 2\n::Gather 4\n")
    return tmp_path


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(str(path)).collect())


def test_algorithms(spark, files):
    assert main(["sssp", f"{files}/e", "--partition", f"{files}/p", "--tiles", "2", "--iterations", "3", "--out", f"{files}/o"], spark) == 0
    assert lines(spark, files / "o" / "tile=1") == ["2\t2 \t<- 1", "3\t2 \t<- 1"]
    assert main(["pagerank", f"{files}/e", "--iterations", "1", "--out", f"{files}/r"], spark) == 0
    assert lines(spark, files / "r")[1] == "1\t1.0"
    assert main(["cc", f"{files}/e", "--iterations", "9", "--until-converged"], spark) == 0
    assert main(["als", f"{files}/e", "--boundary", "2", "--rank", "2", "--iterations", "2", "--out", f"{files}/f"], spark) == 0
    assert all(len(x.split("\t")[1].split(" ")) == 2 for x in lines(spark, files / "f"))


def test_what_is_refused(spark, files, capsys):
    assert main(["bfs", f"{files}/e", "--tiles", "2"], spark) == 1
    assert main(["pagerank", f"{files}/e", "--beta", "2"], spark) == 1
    assert "partition file" in capsys.readouterr().err


def test_tools(spark, files, capsys):
    assert main(["synthesise", f"{files}/e", "--parties", "2", "--scale", "1", "--degree", "1", "--out", f"{files}/s"], spark) == 0
    assert text.read_partition(spark, f"{files}/s/partition", 2).count() == 8
    assert main(["partition", f"{files}/e", "--parties", "2", "--out", f"{files}/q"], spark) == 0
    assert text.read_partition(spark, f"{files}/q", 2).count() == 4
    assert main(["format", f"{files}/c.csv", "--out", f"{files}/t"], spark) == 0
    assert lines(spark, files / "t") == ["1 2", "3 4"]
    assert main(["metrics", f"{files}/log", "--double", "Gather"], spark) == 0
    assert "6.0" in capsys.readouterr().out
