"""CSV text with line breaks inside quotes, in files that are split in the middle of them."""

import csv
import io
import random

import pytest

from assayer.sources import quoted, readers


def rows_of(n, seed=1):
    draw = random.Random(seed)
    texts = ["plain", "two\nlines", 'a "quoted" word', "a,b", "\n\nthree", "", 'ends in "', "x" * 300 + "\n" + "y" * 300, "\r\n inside", 'five "" marks "']
    return [(f"k{seed}-{i}", draw.choice(texts), str(i), draw.choice(texts)) for i in range(n)]


def write(path, rows, header=("id", "note", "n", "more"), end="\r\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerows([header, *rows])
    path.write_bytes(out.getvalue().encode())


def normal(rows):
    return sorted(tuple(v or None for v in r) for r in rows)


@pytest.mark.parametrize("size", [64, 1000, 100_000])
@pytest.mark.parametrize("end", ["\r\n", "\n"])
def test_records_in_splits_of_any_size(spark, tmp_path, size, end):
    rows = {s: rows_of(60, s) for s in (1, 2)}
    for s, listed in rows.items():
        write(tmp_path / f"part{s}.csv", listed, end=end)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = quoted.read(spark, str(tmp_path))
        if size == 64:
            assert quoted.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 20
        assert got.columns == ["id", "note", "n", "more"]
        assert normal(map(tuple, got.collect())) == normal(rows[1] + rows[2])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_whole_lines_take_the_plain_scan(spark, tmp_path):
    write(tmp_path / "plain.csv", [("1", "a,b", "2", 'say "hi"'), ("2", "", "3", "x")])
    assert not quoted.has_open_lines(spark, str(tmp_path / "plain.csv"))
    write(tmp_path / "open.csv", [("1", "a\nb", "2", "c")])
    assert quoted.has_open_lines(spark, str(tmp_path / "open.csv"))


def test_load_types_records_with_line_breaks(spark, tmp_path):
    write(tmp_path / "notes.csv", [("1", "first\nline", "2.5", "true"), ("2", "n/a", "", "false")], ("id", "note", "price", "paid"))
    got = readers.load_dataset(spark, str(tmp_path / "notes.csv"))
    assert got.dtypes == [("id", "bigint"), ("note", "string"), ("price", "double"), ("paid", "boolean")]
    assert sorted(map(tuple, got.collect())) == [(1, "first\nline", 2.5, True), (2, None, None, False)]
    given = readers.load_dataset(spark, str(tmp_path / "notes.csv"), "id int, note string, price float, paid string")
    assert given.dtypes[0] == ("id", "int") and given.count() == 2


def test_stray_quotes_do_not_open(spark, tmp_path):
    (tmp_path / "stray.csv").write_text('id,note\n1,5" pipe\n2,"a\nb"\n3,x"y"z\n\n4,last\n')
    got = quoted.read(spark, str(tmp_path / "stray.csv"))
    assert sorted(map(tuple, got.collect())) == [("1", '5" pipe'), ("2", "a\nb"), ("3", 'x"y"z'), ("4", "last")]
