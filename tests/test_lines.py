"""Line numbers of files that are read in several splits, and what strict readers say of bad lines."""

import gzip

import pytest
from colloquy.sources import readers


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def lines_of(n):
    return [f'{{"n": {i}, "pad": "{"x" * (i % 70)}"}}' if i % 9 else "" for i in range(1, n + 1)]


def write(tmp_path, lines):
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("\n".join(lines[:5]) + "\n")
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")


def test_numbers_over_splits(spark, tmp_path, small_splits):
    lines = lines_of(500)
    write(tmp_path, lines)
    found = readers.numbered_lines(spark, str(tmp_path))
    got = {}
    for r in found.collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line, r.value))
    for name, want in (("a.jsonl", lines), ("b.jsonl", lines[:5]), ("c.jsonl.gz", lines)):
        assert sorted(got[name]) == list(enumerate(want, 1))


def test_many_splits_are_read_side_by_side(spark, tmp_path, small_splits):
    write(tmp_path, lines_of(500))
    assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("name", ["a.jsonl", "c.jsonl.gz"])
@pytest.mark.parametrize("bad", ["not json", '{"n": "x"}', "[1", "7"])
def test_a_bad_line_is_named(spark, tmp_path, small_splits, name, bad):
    lines = lines_of(400)
    lines[321] = bad
    write(tmp_path, lines)
    with pytest.raises(Exception, match=rf"{name}:322: ".replace(".", r"\.")):
        readers.json_lines_strict(spark, str(tmp_path / name), "n int, pad string").collect()


def test_good_files_are_read_whole(spark, tmp_path, small_splits):
    lines = lines_of(300)
    write(tmp_path, lines)
    got = readers.json_lines_strict(spark, str(tmp_path / "[ab].jsonl"), "n int, pad string").collect()
    assert sorted(r.n for r in got) == sorted([*(i for i in range(1, 301) if i % 9), 1, 2, 3, 4, 5])
