"""The page archive: numbers, fetches by id and number, and what they read."""

import pytest
from pyspark.errors import AnalysisException

from chronotext.sources import archive

SCHEMA = "page_id long, title string, number_ string"


def archived(spark, path, rows, **options):
    archive.write_archive(spark.createDataFrame(rows, SCHEMA).repartition(5), path, **options)
    return path


def test_numbers_follow_ids(spark, tmp_path):
    ids = [(7919 * i) % 1009 + 2**53 for i in range(1009)]
    path = archived(spark, str(tmp_path / "a"), [(i, f"t{i}", None) for i in ids], block_pages=50)
    got = archive.read_archive(spark, path).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1009)) and [r.page_id for r in got] == sorted(ids)
    assert got[0].asDict().keys() == {"page_id", "title", "number_", "number"}


def test_a_fetch_reads_one_file(spark, tmp_path):
    path = archived(spark, str(tmp_path / "a"), [(3 * i, f"t{i}", "x") for i in range(1000)], block_pages=50)
    assert len(archive.read_archive(spark, path).inputFiles()) >= 20
    for found, title in ((archive.archived_page(spark, path, 999), "t333"), (archive.page_at(spark, path, 500), "t500")):
        files = [name for name in found.inputFiles() if "/pages/" in name]
        assert [r.title for r in found.collect()] == [title] and len(files) == 1
    assert archive.archived_page(spark, path, 1000).collect() == []
    assert archive.archived_page(spark, path, -1).collect() == []
    assert archive.page_at(spark, path, 1000).collect() == [] and archive.page_at(spark, path, -1).collect() == []


def test_repeated_and_missing_ids(spark, tmp_path):
    rows = [(5, f"t{i}", None) for i in range(200)] + [(None, "lost", None)] * 3 + [(1, "a", None), (9, "z", "q"), (9, "z", "q")]
    path = archived(spark, str(tmp_path / "a"), rows, block_pages=10)
    assert sorted(r.title for r in archive.archived_page(spark, path, 5).collect()) == sorted(f"t{i}" for i in range(200))
    assert [tuple(r) for r in archive.archived_page(spark, path, 9).collect()] == [(9, "z", "q")] * 2
    assert [r.title for r in archive.archived_page(spark, path, 1).collect()] == ["a"]
    assert [archive.page_at(spark, path, n).first().title for n in range(4)] == ["lost"] * 3 + ["a"]
    assert archive.read_archive(spark, path).count() == len(rows)


def test_empty_archive_and_existing_path(spark, tmp_path):
    path = archived(spark, str(tmp_path / "a"), [])
    assert archive.read_archive(spark, path).collect() == [] and archive.page_at(spark, path, 0).collect() == []
    with pytest.raises(AnalysisException):
        archived(spark, path, [(1, "a", None)])
