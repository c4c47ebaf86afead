"""Sessions of a stream: late rows, batches that are run again, and what is appended."""

import glob
import os

import pytest

from tidemark.sources import tables
from tidemark.streaming import windows

SCHEMA = "user string, at timestamp, n int"


def _add(spark, path, rows):
    spark.createDataFrame(rows, "user string, at string, n int").selectExpr("user", "cast(at as timestamp) as at", "n").coalesce(1).write.mode("append").parquet(path)


def test_a_batch_that_is_run_again_leaves_no_row_twice_and_late_rows_count_no_more(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    like = spark.createDataFrame([], SCHEMA)

    def run():
        stream = windows.read_stream(spark, source, like)
        windows.run_to_path(windows.sessions(stream, "at", "user", "30 minutes", "2 hours"), out, checkpoint, "append")

    def rows():
        shape = windows.sessions(like, "at", "user", "30 minutes")
        return sorted((r["key"], str(r["session_start"]), str(r["session_end"]), r["n"]) for r in windows.read_batches(spark, out, shape).collect())

    _add(spark, source, [("a", "2024-03-01 08:00:00", 1), ("a", "2024-03-01 08:20:00", 1), ("a", "2024-03-01 09:30:00", 1), ("b", "2024-03-01 08:05:00", 1)])
    run()
    assert rows() == []  # nothing is settled before the watermark has passed it
    _add(spark, source, [("a", "2024-03-01 20:00:00", 1), ("b", "2024-03-01 20:00:00", 1)])
    run()
    want = [("a", "2024-03-01 08:00:00", "2024-03-01 08:50:00", 2), ("a", "2024-03-01 09:30:00", "2024-03-01 10:00:00", 1), ("b", "2024-03-01 08:05:00", "2024-03-01 08:35:00", 1)]
    assert rows() == want
    last = max(int(os.path.basename(f)) for f in glob.glob(f"{checkpoint}/commits/[0-9]*"))
    for f in glob.glob(f"{checkpoint}/commits/{last}") + glob.glob(f"{checkpoint}/commits/.{last}.crc"):
        os.remove(f)  # as if the driver was lost after the sink wrote and before the batch was noted as done
    run()
    assert rows() == want
    _add(spark, source, [("a", "2024-03-01 08:25:00", 1), ("c", "2024-03-02 20:00:00", 1)])  # the first is twelve hours late
    run()
    assert rows() == sorted([*want, ("a", "2024-03-01 20:00:00", "2024-03-01 20:30:00", 1), ("b", "2024-03-01 20:00:00", "2024-03-01 20:30:00", 1)])


def test_sessions_of_a_table_and_of_a_stream_agree(spark, tmp_path):
    source = str(tmp_path / "in")
    _add(spark, source, [(u, f"2024-03-01 {h:02d}:{m:02d}:00", 1) for u in "ab" for h in (1, 2, 5) for m in (0, 25, 50)])
    like = spark.read.parquet(source)
    windows.run_to_path(windows.sessions(windows.read_stream(spark, source, like), "at", "user", "26 minutes"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    made, want = (sorted(tuple(r) for r in df.collect()) for df in (spark.read.parquet(str(tmp_path / "out")), windows.sessions(like, "at", "user", "26 minutes")))
    assert made == want and [r[3] for r in want] == [6, 3, 6, 3]


def test_workbooks_of_a_folder_are_one_table(spark, tmp_path):
    from tidemark.plans.queries import _xlsx

    (tmp_path / "a.xlsx").write_bytes(_xlsx([("Name", "Count"), ("x & y", 1), ("z", 2)]))
    (tmp_path / "b.xlsx").write_bytes(_xlsx([("Count", "Share", "Name"), (3, 0.5, "w"), (None, None, None), (4, 0.25, None)]))
    (tmp_path / "note.txt").write_text("no workbook")
    df = tables.read_workbooks(spark, str(tmp_path))
    assert dict(df.dtypes) == {"Name": "string", "Count": "bigint", "Share": "double"}
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted([("x & y", 1, None), ("z", 2, None), ("w", 3, 0.5), (None, 4, 0.25)], key=str)
    many = _xlsx([("k",), *((i,) for i in range(12_001))])
    (tmp_path / "big").mkdir()
    (tmp_path / "big/c.xlsx").write_bytes(many)
    assert tables.row_count(spark, str(tmp_path / "big/c.xlsx")) == 12_001 and tables.read_xlsx(spark, str(tmp_path / "big/c.xlsx")).agg({"k": "sum"}).first()[0] == sum(range(12_001))
    with pytest.raises(FileNotFoundError):
        tables.read_xlsx(spark, str(tmp_path / "gone.xlsx"))
    os.makedirs(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        tables.read_workbooks(spark, str(tmp_path / "none"))
