"""Delimited files read range by range give the rows of the built-in multi-line reader."""

import pytest

from sitewright.sources.delimited import PIECES, _lines, piece_partitions, read_delimited
from sitewright.sources.tables import write_table

KINDS = "id long, text string, note string"


def built_in(spark, path, schema, sep=","):
    return spark.read.csv(path, schema=schema, sep=sep, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "97")
    spark.conf.set(names[1], "1")
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("sep", [",", ";"])
def test_breaks_quotes_and_separators_across_borders(spark, tmp_path, small_ranges, sep):
    texts = ["plain", 'say "x"', "two\nlines", f"a{sep}b\n\n\"q\"\n", "", None, '"', '""\n"', "é\n" * 40, "long " * 100 + '\n"end"', "\n"]
    data = [(i, texts[i % len(texts)], texts[(i * 7 + 3) % len(texts)]) for i in range(200)]
    df = spark.createDataFrame(data, KINDS).coalesce(1)
    path = write_table(df, str(tmp_path / "t"), sep)
    got = read_delimited(spark, path, df.schema, sep)
    assert rows(got) == rows(built_in(spark, path, df.schema, sep))
    assert len(rows(got)) == 200


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    body = "id,text,note\n" + "".join(f'{i},"line {i}\nmore, ""quoted""",x\n' for i in range(300))
    (tmp_path / "f.csv").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(body) // 64 + 1))
    path = str(tmp_path / "f.csv")
    assert _lines(spark, path).rdd.getNumPartitions() >= 60
    schema = spark.createDataFrame([], KINDS).schema
    got = rows(read_delimited(spark, path, schema))
    assert got == rows(built_in(spark, path, schema)) and len(got) == 300


def test_windows_breaks_blank_lines_header_only_and_bad_numbers(spark, tmp_path):
    schema = spark.createDataFrame([], KINDS).schema
    (tmp_path / "a.csv").write_bytes(b'id,text,note\r\n1,"x, y",z\r\n\r\nno,b,c\r\n3,,\r\n')
    got = rows(read_delimited(spark, str(tmp_path / "a.csv"), schema))
    assert got == sorted([(1, "x, y", "z"), (None, "b", "c"), (3, None, None)], key=repr)
    (tmp_path / "b.csv").write_text('"id","te\nxt","note"\n')
    assert rows(read_delimited(spark, str(tmp_path / "b.csv"), schema)) == []


def test_pieces_of_many_files_in_one_task(spark):
    import pyarrow as pa

    lines = [(1, 0, False, 'a,"b'), (1, 9, True, "c"), (1, 20, True, 'd"'), (1, 20, True, "e"), (2, 0, False, "h"), (2, 0, False, '"t')]
    columns = [pa.array(c) for c in zip(*lines, strict=True)]
    batches = [pa.RecordBatch.from_arrays([c.slice(i, 2) for c in columns], names=["file", "block", "odd", "value"]) for i in (0, 2, 4)]
    out = [tuple(r.values()) for b in piece_partitions(iter(batches)) for r in b.to_pylist()]
    assert out == [
        (1, 0, 3, True, 'a,"b'), (1, 9, 2, False, "c"), (1, 20, 1, False, 'd"'), (1, 20, 0, False, "e"),
        (2, 0, 0, True, "h"), (2, 0, 3, False, '"t'),
    ]
    assert PIECES.count(",") == 4


def test_a_large_batch_is_read_in_parts():
    import pyarrow as pa

    lines = [str(i) * 300 + ('"' if i % 5 == 0 else "") for i in range(6000)]
    n = len(lines)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * n), pa.array([0] * n), pa.array([False] * n), pa.array(lines)], names=["file", "block", "odd", "value"]
    )
    out = list(piece_partitions(iter([batch])))
    assert len(out) > 2 and max(b.nbytes for b in out) < 4_000_000
    whole = [tuple(r.values()) for b in piece_partitions(batch.slice(i, 1) for i in range(n)) for r in b.to_pylist()]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == whole
    assert "\n".join(r[4] for r in whole) == "\n".join(lines)


def test_workers_need_no_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import pickle, sys; pickle.load(sys.stdin.buffer)"
    done = subprocess.run([sys.executable, "-I", "-c", code], input=cloudpickle.dumps(piece_partitions), capture_output=True, cwd=tmp_path, timeout=100)
    assert done.returncode == 0, done.stderr.decode()
