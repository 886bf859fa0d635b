import json

import pytest

from waymill.cli import COMMANDS, main
from waymill.streaming import replication

LINES = "n1 v1 dV c1 t2020-01-01T00:00:00Z i1 ua T x1 y1\nn2 v1 dV c1 t2020-01-01T00:00:00Z i1 ua Tname=b x2 y2\nw3 v1 dV c1 t2020-01-01T00:00:00Z i1 ua Troad=yes Nn1,n2\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in.opl").write_text(LINES)
    return tmp_path


def lines(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_there_are_all_commands():
    assert len(COMMANDS) == 24


def test_filters(spark, folder):
    source, out = str(folder / "in.opl"), folder / "out.opl"
    assert main(["tags-filter", source, "w/road", "-o", str(out)]) == 0
    assert lines(out) == LINES.splitlines()
    assert main(["tags-filter", source, "w/road", "-o", str(out)]) == 1  # there is one already
    assert main(["tags-filter", source, "w/road", "-R", "-O", "-o", str(out)]) == 0
    assert [x[:2] for x in lines(out)] == ["w3"]
    assert main(["getid", source, "n2", "w9", "-O", "-o", str(out)]) == 1  # one is missing
    assert [x[:2] for x in lines(out)] == ["n2"]
    assert main(["removeid", source, "n1,n2", "-O", "-o", str(out)]) == 0
    assert [x[:2] for x in lines(out)] == ["w3"]


def test_reports(spark, folder, capsys):
    source = str(folder / "in.opl")
    assert main(["tags-count", source]) == 0
    assert capsys.readouterr().out.splitlines() == ['1\t"name"', '1\t"road"']
    assert main(["check-refs", source]) == 0
    assert "missing_nodes_in_ways: 0" in capsys.readouterr().out
    assert main(["fileinfo", source, "-e"]) == 0
    info = json.loads(capsys.readouterr().out)
    assert info["data"]["count"] == {"nodes": 2, "ways": 1, "relations": 0} and info["data"]["objects_ordered"] is True
    assert main(["show", source, "-f", "opl", "-t", "way"]) == 0
    assert capsys.readouterr().out.startswith("w3 v1")
    assert main(["diff", source, source, "-c"]) == 0
    assert main(["no-such-command"]) == 2
    assert main(["time-filter", source, "yesterday", "-o", str(folder / "x.opl")]) == 2


def test_outputs(spark, folder):
    source = str(folder / "in.opl")
    assert main(["export", source, "-o", str(folder / "a.geojson")]) == 0
    collection = json.loads("\n".join(lines(folder / "a.geojson")))
    assert sorted(f["geometry"]["type"] for f in collection["features"]) == ["LineString", "Point"]
    assert main(["extract", source, "-b", "0.5,0.5,1.5,1.5", "-s", "simple", "-o", str(folder / "e.opl")]) == 0
    assert [x[:2] for x in lines(folder / "e.opl")] == ["n1", "w3"]
    assert main(["sort", source, source, "-o", str(folder / "s.opl")]) == 0 and len(lines(folder / "s.opl")) == 6
    assert main(["create-locations-index", source, "-i", str(folder / "index")]) == 0
    assert main(["query-locations-index", "2", "-i", str(folder / "index")]) == 0
    assert main(["query-locations-index", "7", "-i", str(folder / "index")]) == 1
    assert main(["renumber", source, "-s", "10", "-o", str(folder / "r.opl")]) == 0
    assert [x.split()[0] for x in lines(folder / "r.opl")] == ["n10", "n11", "w10"]


def test_one_file(spark, folder):
    source, out = str(folder / "in.opl"), folder / "one.osm.pbf"
    assert main(["cat", source, "--join", "-o", str(out)]) == 0 and out.is_file()
    assert main(["cat", source, "--join", "-o", str(out)]) == 1
    assert main(["cat", str(out), "-t", "way", "--join", "-o", str(folder / "w.opl")]) == 0
    assert (folder / "w.opl").read_text().splitlines() == [LINES.splitlines()[2]]


def test_map_of_ids_goes_on(spark, folder):
    first, second, index = str(folder / "in.opl"), folder / "more.opl", str(folder / "map")
    second.write_text("n7 v1 dV x1 y1\nn2 v2 dV x1 y1\n")
    assert main(["renumber", first, "-i", index, "-o", str(folder / "a.opl")]) == 0
    assert main(["renumber", str(second), "-i", index, "-o", str(folder / "b.opl")]) == 0
    assert [x.split()[0] for x in lines(folder / "b.opl")] == ["n3", "n2"]


def test_data_and_history_dont_mix(spark, folder):
    source, change = str(folder / "in.opl"), folder / "c.opl"
    change.write_text("n1 v2 dV c1 t2020-01-02T00:00:00Z i1 ua T x5 y5\n")
    assert main(["apply-changes", source, str(change), "-o", str(folder / "x.osh")]) == 2
    assert main(["apply-changes", source, str(change), "-H", "--locations-on-ways", "-o", str(folder / "x.opl")]) == 2
    assert main(["apply-changes", source, str(change), "-H", "-o", str(folder / "h.opl")]) == 0
    assert [x[:5] for x in lines(folder / "h.opl")] == ["n1 v1", "n1 v2", "n2 v1", "w3 v1"]


def test_changes_as_a_stream(spark, objects, folder, ids):
    path, root = str(folder / "changes"), str(folder / "root")
    objects("n1 v2 dV T x5 y5\nn2 v2 dD T").coalesce(1).write.parquet(path)
    query = replication.follow(replication.change_stream(spark, path, 1), root, objects(LINES), available_now=True)
    query.awaitTermination()
    objects("n9 v1 dV T x5 y5\nn1 v3 dD T").coalesce(1).write.mode("append").parquet(path)
    replication.follow(replication.change_stream(spark, path, 1), root, available_now=True).awaitTermination()
    assert ids(replication.state(spark, root, 1), version=True) == ["n1v2", "w3v1"]
    assert ids(replication.state(spark, root, 2), version=True) == ["n9v1", "w3v1"]


def test_pager(monkeypatch, tmp_path, capsys):
    """On a terminal what is shown goes through PAGER; else, or if it isn't wanted, straight out."""
    import sys

    from waymill import cli

    monkeypatch.setenv("PAGER", f"tee {tmp_path / 'seen'}")
    for terminal, wanted in ((True, True), (False, True), (True, False)):
        monkeypatch.setattr(sys.stdout, "isatty", lambda t=terminal: t, raising=False)
        with cli._pager(wanted):
            print(f"row {terminal} {wanted}")
    assert (tmp_path / "seen").read_text() == "row True True\n"
    assert capsys.readouterr().out == "row False True\nrow True False\n"
