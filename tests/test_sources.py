"""Readers and writers on small files."""

import pytest

from lectern.functions.exprs import timestamp
from lectern.operators import cleaning
from lectern.session import scratch_folder
from lectern.sources import readers, writers

COURSE = "Email,Course,Overall Progress,Job Title\na@x.com,Python,50,Dev\nb@x.com,SQL,,Ops\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "My Course Export.csv").write_text(COURSE)
    (tmp_path / "My Course Export modified.csv").write_text(COURSE)
    (tmp_path / "clips.csv").write_text("Email,Course Name,Clip Name\na@x.com,Python,c1\n")
    (tmp_path / "bad program.csv").write_text("col1,col2\n1,a\n")
    return tmp_path


def test_headers_and_row_order(spark, folder):
    df = readers.read_export(spark, str(folder / "My Course Export.csv"), "course")
    assert {"Email", "Course Name", "Progress (%)", "Role", "_row_id"} <= set(df.columns)
    assert [r["Email"] for r in df.orderBy("_row_id").collect()] == ["a@x.com", "b@x.com"]


def test_errors(spark, folder):
    with pytest.raises(ValueError, match="missing required columns"):
        readers.read_export(spark, str(folder / "bad program.csv"), "course")
    with pytest.raises(FileNotFoundError):
        readers.read_export(spark, str(folder / "none.csv"), "course")
    (folder / "x.json").write_text("{}")
    with pytest.raises(ValueError, match="Unsupported format"):
        readers.read_export(spark, str(folder / "x.json"), "course")
    with pytest.raises(ValueError, match="Missing required columns"):
        readers.check_student_source(spark.range(1), "lms")
    assert readers.check_student_source(spark.range(1), "other")
    with pytest.raises(NotADirectoryError):
        readers.read_directory(spark, str(folder / "none"))


def test_detection(spark, folder):
    frames = readers.read_exports(spark, str(folder))
    assert set(frames) == {"course", "video"}
    log = {r["source_type"]: r for r in readers.load_log(frames).collect()}
    assert log["course"]["file"] == "My Course Export.csv" and log["course"]["rows"] == 2
    assert log["course"]["columns"] == 4


def test_directory_collects_errors(spark, folder):
    frames, errors = readers.read_directory(spark, str(folder), "*.csv", "lms")
    assert not frames and len(errors) == 4


def test_latin_1(spark, tmp_path):
    (tmp_path / "names.csv").write_bytes("name\nUniversité\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("name\nUniversité\n".encode())
    for name in ("names.csv", "utf.csv"):
        assert readers.read_csv_any_encoding(spark, str(tmp_path / name)).first()["name"] == "Université"


def test_writers(spark):
    folder = scratch_folder(spark)
    df = spark.createDataFrame([("a", ["x", "y"])], "k string, v array<string>")
    path = writers.export_table(df, folder, "t")
    assert readers.read_csv(spark, path).first()["v"] == '["x","y"]'
    with pytest.raises(KeyError):
        writers.export_named({"t": df}, "u", folder)
    with pytest.raises(ValueError):
        writers.export_table(df, folder, "t", "xlsx")


def test_records_over_lines_mixed_headers_and_row_order(spark, tmp_path):
    folder = tmp_path / "course.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("email,course\n" + '"a@x.com","one\ntwo"\n' + "b@x.com,three\n")
    (folder / "part-1.csv").write_text("course,email\n" + "".join(f"c{i},u{i}@x.com\n" for i in range(300)))
    (folder / "part-2.csv").write_text("email,course\nz@x.com,last,surplus\nlone@x.com\n")
    df = readers.read_student_source(spark, str(folder))
    rows = df.orderBy("_row_id").collect()
    assert [(r.email, r.course) for r in rows[:3]] == [("a@x.com", "one\ntwo"), ("b@x.com", "three"), ("u0@x.com", "c0")]
    assert [r.email for r in rows[2:302]] == [f"u{i}@x.com" for i in range(300)]
    assert [(r.email, r.course) for r in rows[302:]] == [("z@x.com", "last"), ("lone@x.com", None)]
    assert len({r["_row_id"] for r in rows}) == len(rows) == 304
    bad = readers.malformed_records(spark, str(folder)).collect()
    assert sorted((r.file, r.record) for r in bad) == [("part-2.csv", "lone@x.com"), ("part-2.csv", "z@x.com,last,surplus")]


def test_rows_of_several_blocks_keep_their_order(spark, tmp_path):
    (tmp_path / "x.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(20_000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "5000")
        df = readers.read_student_source(spark, str(tmp_path / "x.csv"))
        assert df.rdd.getNumPartitions() > 4
        assert [int(r.v) for r in df.orderBy("_row_id").collect()] == list(range(20_000))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_timestamps_survive_export(spark):
    folder = scratch_folder(spark)
    df = spark.sql("SELECT timestamp'2024-01-02 03:04:05.123456' AS t UNION ALL SELECT timestamp'2024-01-02 00:00:00'")
    back = readers.read_csv(spark, writers.export_table(df, folder, "times")).select(timestamp("t").alias("t"))
    assert sorted(back.collect()) == sorted(df.collect())


def test_clean_export_needs_no_options(spark, tmp_path):
    text = 'Email,Course Id,Overall Progress,Course,id,_v\n'
    text += "".join(f"u{i}@x.com,{9007199254740993 + 2 * (i % 3)},{i}.5,C,{i},{i % 4}\n" for i in range(40))
    text += "u0@x.com,9007199254740993,0.5,C,0,0\n" + "u0@x.com,9007199254740993,0.5,C,0,1\n"
    (tmp_path / "course.csv").write_text(text)
    out = cleaning.clean_export(readers.read_export(spark, str(tmp_path / "course.csv"), "course"))
    rows = out.collect()
    assert len(rows) == 41  # the copy goes, the row that differs in a column named _v stays
    assert {r["Course Id"] for r in rows} == {9007199254740993, 9007199254740995, 9007199254740997}
    assert {type(r["id"]) for r in rows} == {int} and {type(r["Progress (%)"]) for r in rows} == {float}
