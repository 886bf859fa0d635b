import os

import pytest

from waymill import scratch


class Elsewhere:
    """A session of a cluster whose shared folder isn't set."""

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Elsewhere())


def test_discard(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_WRITTEN", {})
    kept = [scratch.materialise(spark.range(n), "some") for n in (3, 5)]
    assert [df.count() for df in kept] == [3, 5]
    paths = [p for p in scratch._WRITTEN[spark.sparkContext.applicationId]]
    assert len(paths) == 2 and all(os.path.isdir(p.removeprefix("file:")) for p in paths)
    assert scratch.discard(spark) == 2 and scratch.discard(spark) == 0
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)
