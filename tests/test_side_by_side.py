"""Files are written and read side by side."""

import threading

import pytest
from test_large_joins import small_tables

from lectern.plans import io_queries
from lectern.sources import readers


@pytest.fixture
def meet():
    """Returns only if `n` callers wait at the same time."""

    def make(n):
        barrier = threading.Barrier(n)
        return lambda: barrier.wait(timeout=20)

    return make


def test_files_of_a_folder_are_read_side_by_side(spark, tmp_path, monkeypatch, meet):
    for name in ("b.csv", "a.csv", "bad.csv"):
        (tmp_path / name).write_text("id\n1\n")
    wait, read = meet(3), readers.read_student_source

    def slow(spark, file, source=None):
        wait()
        if "bad" in file:
            raise ValueError("bad file")
        return read(spark, file, source)

    monkeypatch.setattr(readers, "read_student_source", slow)
    frames, errors = readers.read_directory(spark, str(tmp_path))
    assert list(frames) == ["a", "b"] and errors == {"bad.csv": "bad file"}
    assert [df.count() for df in frames.values()] == [1, 1]


def test_exports_are_written_side_by_side(spark, tmp_path, monkeypatch, meet):
    tables = small_tables(spark, tmp_path)
    wait, write = meet(6), io_queries._written

    def slow(df, folder, name, encoding="utf-8"):
        wait()
        return write(df, folder, name, encoding)

    monkeypatch.setattr(io_queries, "_written", slow)
    frames, errors = readers.read_directory(spark, io_queries._named_exports(tables), "*activity.csv")
    assert {k: df.count() for k, df in frames.items()} == {"program_activity": 2, "specialization_activity": 2, "video_clip_activity": 1}
    assert not errors
