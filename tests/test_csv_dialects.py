"""CSV files as they are found: dialect vote, splitting at bytes, kinds of columns."""

import csv as plain_csv
import datetime
import io
import random

import pytest

from landspan.plans.load import CSVSource, Destination, load
from landspan.sources import csv, csv_dialect, csv_records, files


def odd_rows(seed, n=120, width=4):
    rng = random.Random(seed)
    parts = ["a", " ", '"', '""', "'", "\n", "\r\n", ",", ";", "\t", "|", "é", '",', '"\n', "x" * 30, ""]
    return [["".join(rng.choices(parts, k=rng.randrange(6))) for _ in range(width)] for _ in range(n)]


def written(rows, separator=",", quote='"', end="\n", always=False):
    out = io.StringIO(newline="")
    plain_csv.writer(out, delimiter=separator, quotechar=quote, lineterminator=end,
                     quoting=plain_csv.QUOTE_ALL if always else plain_csv.QUOTE_MINIMAL).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("range_bytes, separator, quote, end, always", [
    (2, ",", '"', "\n", False), (30, ";", "'", "\r\n", True), (500, ",", '"', "\n", False),
    (1 << 20, ";", "'", "\r\n", True)])
def test_records_do_not_depend_on_ranges(spark, tmp_path, monkeypatch, range_bytes, separator, quote, end, always):
    monkeypatch.setattr(csv_records, "AHEAD_BYTES", 5)
    monkeypatch.setattr(files, "MAX_TASKS", 4)
    rows = [["1", "2", "3", "4"]] + odd_rows(range_bytes)
    text = written(rows, separator, quote, end, always)
    (tmp_path / "a.csv").write_text(text, newline="", encoding="utf-8")
    (tmp_path / "b.csv").write_text(text.rstrip("\r\n"), newline="", encoding="utf-8")
    found = csv_records.split(spark, str(tmp_path), separator, quote, range_bytes=range_bytes)
    for name in "ab":
        some = [r.record for r in found.where(f"path LIKE '%{name}.csv'").orderBy("offset").collect()]
        got = [next(plain_csv.reader(io.StringIO(r, newline=""), delimiter=separator, quotechar=quote)) for r in some]
        assert got == [r for r in rows if r != [""]]


def test_a_quote_within_a_field_opens_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_TASKS", 4)
    text = 'id,size\n1,5" pipe\n2,"a\n""b"""\n3,6" pipe\n' * 40
    (tmp_path / "a.csv").write_text(text)
    found = csv_records.split(spark, str(tmp_path), ",", '"', range_bytes=16)
    assert [r.record for r in found.orderBy("offset").collect()] == [
        "id,size", '1,5" pipe', '2,"a\n""b"""', '3,6" pipe'] * 40


def test_ranges_are_read_by_tasks_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note\n" + '1,"two\nlines"\n' * 2000)
    found = csv_records.split(spark, str(tmp_path), ",", '"', range_bytes=4096)
    assert found.count() == 2001
    # About one task a range.
    assert found.rdd.getNumPartitions() >= 6


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note\n" + '1,"two\nlines"\n' * 2000)
    found = csv_records.split(spark, str(tmp_path), ",", '"', range_bytes=64)
    # Several tasks a core, not one for each of some 400 ranges.
    cores = spark.sparkContext.defaultParallelism
    assert cores < found.rdd.getNumPartitions() <= files.TASKS_PER_CORE * cores
    assert found.count() == 2001


@pytest.mark.parametrize("text, separator, quote, names", [
    ("id;note\n1;a,b\n2;c,d\n", ";", '"', ("id", "note")),
    ("id\tnote\n1\tx\n2\ty z\n", "\t", '"', ("id", "note")),
    ("1|x\n2|y\n", "|", '"', None),
    ("id,name\n1,'a,b'\n2,'c'\n", ",", "'", ("id", "name")),
    ('a,b\n"x;y;z",1\n"p;q;r",2\n', ",", '"', ("a", "b")),
    ("2024-01-02,5\n2024-01-03,6\n", ",", '"', None),
    ("name\nx\ny\n", ",", '"', ("name",)),
    ("city,kind\nOslo,town\nRome,town\n", ",", '"', ("city", "kind")),
    ("Oslo,town\nRome,town\n", ",", '"', None),
    ("a,a\n1,2\n", ",", '"', None),
])
def test_vote(text, separator, quote, names):
    best = csv_dialect.candidates([(text, True)])[0]
    assert (best.separator, best.quote, best.names) == (separator, quote, names)


def test_kinds_and_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "id;;day;seen;share;ok;note;none\n1;x;2024-01-02;2024-01-02 03:04:05;1.5;true;a;\n"
        "2;;2024-01-03;2024-01-03T00:00:00;-2e3;FALSE;7;\n")
    rows = csv.read_csv_as_found(spark, str(tmp_path / "a.csv"))
    assert [(f.name, f.dataType.simpleString()) for f in rows.schema.fields] == [
        ("id", "bigint"), ("column1", "string"), ("day", "date"), ("seen", "timestamp_ntz"), ("share", "double"),
        ("ok", "boolean"), ("note", "string"), ("none", "string")]
    assert rows.orderBy("id").collect()[1][:6] == (
        2, None, datetime.date(2024, 1, 3), datetime.datetime(2024, 1, 3), -2000.0, False)
    fixed = csv.read_csv_as_found(spark, str(tmp_path / "a.csv"), "a int, b string, c string, d string, e string,"
                                  " f string, g int, h string").orderBy("a").collect()
    assert [tuple(r)[:1] + (r.g,) for r in fixed] == [(1, None), (2, 7)]


def test_what_refutes_a_dialect(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note\n" + "1,x\n" * 40000 + "2\n")
    with pytest.raises(ValueError, match="does not have 2 fields"):
        csv.read_csv_as_found(spark, str(tmp_path / "a.csv"))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("id,note\n1,x\n")
    (tmp_path / "two" / "b.csv").write_text("note,id\nx,1\n")
    with pytest.raises(ValueError, match="2 different headers"):
        csv.read_csv_as_found(spark, str(tmp_path / "two"))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.csv").write_text("")
    with pytest.raises(FileNotFoundError):
        csv.read_csv_as_found(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="utf-16"):
        csv.read_csv_as_found(spark, str(tmp_path / "two" / "a.csv"), encoding="utf-16")


def test_the_next_dialect_is_tried(spark, tmp_path):
    # The sample has as many commas as semicolons; only semicolons hold on the whole file.
    lines = ["id;x"] + [f"{i},5;{i},7" for i in range(9000)] + ["1;2"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    rows = csv.read_csv_as_found(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["id", "x"] and rows.count() == 9001


def test_load_of_a_csv_as_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Id;note\n1;"two\nlines"\n2;é\n', encoding="utf-8")
    spark.sql("CREATE SCHEMA IF NOT EXISTS found")
    table = load(spark, CSVSource(str(tmp_path / "a.csv"), pk="Id"), Destination("found.notes"))
    assert sorted(tuple(r) for r in table.collect()) == [(1, "two\nlines"), (2, "é")]
    (tmp_path / "b.csv").write_text("1;é\n", encoding="latin-1")
    table = load(spark, CSVSource(str(tmp_path / "b.csv"), encoding="latin-1", header=False), Destination("found.b"))
    assert [tuple(r) for r in table.collect()] == [(1, "é")] and table.columns == ["column0", "column1"]
