"""Reports move to the archives by the file system, with or without a session."""

import pytest
from pyspark.sql import SparkSession

from pelorus.plans import console
from pelorus.sources import files


def rotate(tmp_path):
    report, archives = f"{tmp_path}/report", f"{tmp_path}/kept/archives"
    assert console.archive(report, archives, "s0") is None and console.archived(archives) == []
    for k in range(1, 5):
        files.write(f"{report}/table/part-{k}", b"x" * k)
        files.write(f"{report}/report.json", str(k).encode())
        assert console.archive(report, archives, f"s{k}", keep=2) == f"{archives}/s{k}"
        assert files.names(report) == files.folders(report) == [] and console.archive(report, archives, "none") is None
    assert console.archived(archives) == ["s3", "s4"]
    assert files.read(f"{archives}/s3/report.json") == b"3" and files.names(f"{archives}/s4/table") == ["part-4"]
    files.write(f"{report}/report.json", b"again")
    with pytest.raises(FileExistsError):
        console.archive(report, archives, "s4")
    assert files.read(f"{report}/report.json") == b"again" and files.read(f"{archives}/s4/report.json") == b"4"
    files.write(f"{archives}/s2.zip", b"an older kind")
    assert console.archived(archives) == ["s2", "s3", "s4"]
    console.archive(report, archives, "s5", keep=3)
    assert console.archived(archives) == ["s3", "s4", "s5"]


def test_with_a_session(spark, tmp_path):
    rotate(tmp_path)


def test_without_a_session(tmp_path, monkeypatch):
    monkeypatch.setattr(SparkSession, "getActiveSession", classmethod(lambda cls: None))
    rotate(tmp_path)
