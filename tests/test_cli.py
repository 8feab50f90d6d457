import pytest

from tessera import cli
from tessera.sources import writers
from tests.golden import T1, graph


@pytest.mark.parametrize("command", [["bfs", "-u", "5", "-v", "-a"], ["sssp", "-g", "5", "-d", "16", "-v", "-a"], ["cc", "-u", "5", "-k", "1", "-v", "-a"], ["cc_sv", "-u", "4", "-v"], ["pr", "-g", "5", "-i", "60", "-v", "-a"], ["bc", "-u", "5", "-i", "2", "-v", "-a"], ["tc", "-u", "5", "-v", "-a"]])
def test_kernels(spark, command, capsys):
    report = cli.run(spark, cli.parser().parse_args([*command, "-n", "2" if command[0] == "bfs" else "1"]))
    assert report.verified and all(report.verified)
    assert "Average Time" in capsys.readouterr().out


def test_files(spark, tmp_path):
    writers.write_graph(graph(spark, T1), f"{tmp_path}/a.wel")
    cli.run(spark, cli.parser().parse_args(["convert", "-f", f"{tmp_path}/a.wel", "-s", "-w", "-b", f"{tmp_path}/b.wsg", "-e", f"{tmp_path}/c.wel"]))
    cli.run(spark, cli.parser().parse_args(["bfs", "-f", f"{tmp_path}/b.wsg", "-r", "0", "-n", "1", "-v", "-o", f"{tmp_path}/out"]))
    assert writers.read_results(spark, f"{tmp_path}/out", 0).count() == 10


def test_refusals(spark, tmp_path):
    with pytest.raises(SystemExit):
        cli.run(spark, cli.parser().parse_args(["bfs"]))
    writers.write_graph(graph(spark, T1), f"{tmp_path}/a.wel")
    with pytest.raises(SystemExit):
        cli.run(spark, cli.parser().parse_args(["tc", "-f", f"{tmp_path}/a.wel"]))


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 200
