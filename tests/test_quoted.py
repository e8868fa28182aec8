"""Splittable reading of quoted CSV against Spark's own reader of whole files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ripplegraph.sources import quoted, readers

SCHEMA = "id int, body string, tail string"


@pytest.fixture
def small_splits(spark):
    """Splits of a few dozen bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def whole(spark, path):
    return sorted(map(tuple, spark.read.options(**quoted.OPTIONS, header=True, multiLine=True).schema(SCHEMA).csv(path).collect()), key=repr)


def split(spark, path):
    return sorted(map(tuple, quoted.quoted_csv(spark, path, SCHEMA).collect()), key=repr)


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([("id", "body", "tail"), *rows])
    return out.getvalue()


@pytest.mark.parametrize("seed", range(4))
def test_rows_equal_the_whole_file_reader(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    for k in range(3):
        texts = ["".join(rng.choice('ab ",\n\r\té') for _ in range(rng.choice((0, 3, 20, 200)))) for _ in range(2 * 25)]
        rows = [(i, a, b) for i, (a, b) in enumerate(zip(texts[::2], texts[1::2]))]
        (tmp_path / f"f{k}.csv").write_text(written(rows), newline="")
    found = split(spark, str(tmp_path))
    assert found == whole(spark, str(tmp_path)) and len(found) == 75


def test_one_file_is_read_by_several_tasks(spark, small_splits, tmp_path):
    rows = [(i, f'line {i}\n"quoted", and more\n\nend', "x" * (i % 50)) for i in range(60)]
    (tmp_path / "one.csv").write_text(written(rows), newline="")
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 5
    assert split(spark, str(tmp_path)) == whole(spark, str(tmp_path)) == sorted(((i, b, t or None) for i, b, t in rows), key=repr)


def test_a_record_over_many_splits(spark, small_splits, tmp_path):
    rows = [(1, "a\n" * 300 + '"', "t"), (2, "short", "u"), (3, '""\n' * 100, "v\n")]
    (tmp_path / "long.csv").write_text(written(rows), newline="")
    assert split(spark, str(tmp_path)) == sorted(rows, key=repr)


@pytest.mark.parametrize(
    "text",
    [
        "id,body,tail\n", "id,body,tail", 'id,"bo\ndy",tail\n1,a,b\n', "id,body,tail\n\n1,a,b\n\n\n2,c,d",
        'id,body,tail\n1,five" wide,b\n2,"x ""y"" z",\n3,a"b"c,"q\nr"\n', 'id,body,tail\r\n1,"a\r\nb",c\r\n2,d,e\r\n',
    ],
)
def test_odd_files(spark, small_splits, tmp_path, text):
    """No rows, no last line break, a broken header, blank lines, quotes inside unquoted fields, other line ends."""
    (tmp_path / "odd.csv").write_text(text, newline="")
    found = split(spark, str(tmp_path))
    if "\r\n" in text:
        assert found == [(1, "a\r\nb", "c"), (2, "d", "e")]
    else:
        assert found == whole(spark, str(tmp_path))


def test_a_row_that_does_not_fit_raises(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,body,tail\nnumber,a,b\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        split(spark, str(tmp_path))


@pytest.mark.parametrize(
    "line, inside, after",
    [
        ("a,b", False, False), ("a,b", True, True), ('"a,b', False, True), ('a,"b', False, True), ('a,"b""', False, True),
        ('a,"b"""', False, False), ('b",c', True, False), ('b",c,"d', True, True), ('""', True, True), ('"', True, False),
        ('five" wide', False, False), ('""', False, False), ("", True, True), ('x"",""y', True, True), ('a,"",b', False, False),
    ],
)
def test_where_a_line_ends(line, inside, after):
    assert quoted.ends_inside(line, inside) == after


def test_edges_and_users_are_read_in_splits(spark, small_splits, tmp_path):
    (tmp_path / "e.csv").write_text("source,target,timestamp\n" + "".join(f"s{i},t{i},2024-01-01 00:00:00\n" for i in range(50)))
    found = readers.read_edges(spark, str(tmp_path / "e.csv"))
    assert found.rdd.getNumPartitions() > 5 and found.count() == 50
    (tmp_path / "u.csv").write_text("user_id,followers\n" + "".join(f"{i},{i}\n" for i in range(50)))
    users = readers.read_users(spark, str(tmp_path / "u.csv"))
    assert users.rdd.getNumPartitions() > 2 and users.agg(F.sum("followers")).first()[0] == 1225
