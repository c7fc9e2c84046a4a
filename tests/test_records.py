"""Records over several lines against Python's csv module, however the file is split."""

import csv
import io

import numpy as np
import pytest

from lectern.sources import readers
from lectern.sources.records import ends_inside, read_records


@pytest.fixture
def tiny_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    yield lambda size: [spark.conf.set(k, str(size)) for k in keys]
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(rng, n):
    fields = ["a", "b,c", 'say "x"', "one\ntwo", "1\n\n2\n3", 'q"\n"', "", "long " * 30, "x\r\ny", '"', "\n" * 5, "é\nü"]
    return [[str(i), *rng.choice(fields, 2)] for i in range(n)]


def test_line_states():
    assert not ends_inside('a,b"c,d', False) and not ends_inside('"a""b",c', False) and not ends_inside("", False)
    assert ends_inside('a,"b', False) and ends_inside('"', False) and ends_inside('"a""', False) and ends_inside('"a",""",', False)
    assert ends_inside("a,b", True) and ends_inside('a""', True) and ends_inside('a","', True)
    assert not ends_inside('a"', True) and not ends_inside('a",b,"c"', True) and not ends_inside('"', True) and not ends_inside('x"y,5" pipe', True)


@pytest.mark.parametrize("size", [60, 400, 10**6])
def test_same_rows_as_one_reader(spark, tmp_path, tiny_splits, size):
    text = io.StringIO()
    rows = rows_of(np.random.default_rng(size), 60)
    csv.writer(text, lineterminator="\n").writerows([["id", "u", "v"], *rows])
    (tmp_path / "x.csv").write_text(text.getvalue(), newline="")
    tiny_splits(size)
    df = readers.read_csv_any_encoding(spark, str(tmp_path / "x.csv"))
    got = df.orderBy("_row_id").collect()
    assert [[r.id, r.u or "", r.v or ""] for r in got] == rows
    parts = read_records(spark, [str(tmp_path / "x.csv")])
    assert parts.count() == 61 and len({(r.start, r.at) for r in parts.collect()}) == 61
    if size < 100:
        assert parts.select("start").distinct().count() > 5


def test_files_encodings_and_stray_quotes(spark, tmp_path, tiny_splits):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes('id,v\n1,"é\nü"\n2,5" pipe\n\n3,x\n'.encode("latin-1"))
    (folder / "b.csv").write_bytes(b'id,v\r\n4,"a\r\nb"\r\n5,c\r\n')
    (folder / "c.csv").write_bytes(b'id,v\n6,"never\nclosed\n7,z\n')
    tiny_splits(8)
    got = readers.read_csv_any_encoding(spark, str(folder)).orderBy("_row_id").collect()
    assert [(r.id, r.v) for r in got[:5]] == [("1", "é\nü"), ("2", '5" pipe'), ("3", "x"), ("4", "a\r\nb"), ("5", "c")]
    assert len(got) == 6 and got[5].id == "6" and "never\nclosed" in got[5].v


def test_row_numbers_leave_room_for_many_files(spark, tmp_path, monkeypatch):
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for i in range(12):
        (folder / f"{i:02}.csv").write_text("v\n" + "".join(f"{i}-{j}\n" for j in range(3)))
    monkeypatch.setattr(readers, "BROADCAST_FILES", 3)
    got = readers.read_csv_any_encoding(spark, str(folder)).orderBy("_row_id").collect()
    assert [r.v for r in got] == [f"{i}-{j}" for i in range(12) for j in range(3)] and got[-1]["_row_id"] < 12 << 7
    monkeypatch.setattr(readers, "ROW_BITS", 8)
    with pytest.raises(ValueError, match="more places"):
        readers.read_csv_any_encoding(spark, str(folder))
