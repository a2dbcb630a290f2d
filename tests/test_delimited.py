import math

import pytest

from quern.errors import LoadError
from quern.model import ColType
from quern.sources.delimited import infer, read_csv
from quern.sources.generate import sales, write_csv


@pytest.fixture
def load(spark, tmp_path):
    def run(text):
        path = tmp_path / "t.csv"
        path.write_bytes(text.encode())
        return read_csv(spark, str(path))

    return run


def rows(table):
    return [tuple(r) for r in table.df.collect()]


def errors(report):
    return sorted(tuple(r) for r in report.errors.collect())


@pytest.mark.parametrize(
    ("value", "kind"),
    [("1", "INT"), ("-7", "INT"), ("+7", "FLOAT"), ("9223372036854775808", "FLOAT"), ("1.", "FLOAT"), (".5", "FLOAT"), ("1e3", "FLOAT"),
     ("nan", "FLOAT"), ("-Inf", "FLOAT"), ("", "STR"), (" 1", "STR"), ("1d", "STR"), ("1\n", "STR"), ("2024-01-01", "STR"), ("true", "STR")],
)
def test_infer(value, kind):
    assert infer(value) is ColType[kind]


@pytest.mark.parametrize(
    ("text", "message"),
    [("", "Missing header line"), ("id,value", "No data rows"), ("id,value\n", "No data rows"), ("a,b\n1\n", "Header/data mismatch: 2 vs 1")],
)
def test_load_errors(load, text, message):
    with pytest.raises(LoadError, match=message):
        load(text)


def test_missing_file(spark, tmp_path):
    with pytest.raises(LoadError):
        read_csv(spark, f"{tmp_path}/nope.csv")


def test_three_columns(load):
    # fixed values of a fixture that the described behaviour names: three rows and their sum
    table, report = load("id,value\n1,10\n2,20\n3,30\n")
    assert table.df.dtypes == [("id", "bigint"), ("value", "bigint")]
    assert table.aggregate("value", "sum") == 60 and report.rows_processed == 3
    from quern.functions.predicates import greater_than

    assert sorted(r[0] for r in table.filter("value", greater_than(15)).collect()) == [1, 2]
    assert errors(report) == []


def test_group_average(load):
    table, _ = load("category,value\nA,10\nB,20\nA,30\n")
    assert table.query().group_by("category").aggregate("value", "avg").execute().value == {"A": 20.0, "B": 20.0}


@pytest.mark.parametrize(
    ("text", "want", "bad"),
    [
        ("a,b\n1,2\n\n3,4\n", [(1, 2), (3, 4)], []),
        ("a,b\n1,2\n3\n4,5,6\n7,8\n", [(1, 2), (7, 8)], [(3, "", "Expected 2 fields, got 1", None), (4, "", "Expected 2 fields, got 3", None)]),
        ("k,v\nA,1\nB,x\nC,3\n", [("A", 1), ("B", None), ("C", 3)], [(3, "v", "x", "not a bigint")]),
        ("k,v\n,1\nA,2\n", [("", 1), ("A", 2)], []),
        ("k,v\nA,\nB,2\n", [("A", ""), ("B", "2")], []),
        ('k,v\nx,1\n"a,b",2\n', [("x", 1)], [(3, "", "Expected 2 fields, got 3", None)]),
        ("a,b\n1,2\n3,4", [(1, 2), (3, 4)], []),
        ("a,b\r\n1,2\r\n", [(1, 2)], []),
        ("v\n1\n2.5\n", [(1,), (None,)], [(3, "v", "2.5", "not a bigint")]),
        ("v\n9223372036854775808\n", [(9223372036854775808.0,)], []),
        ("a,b\n\n1,2\n", [(1, 2)], []),
        ("v\n1\n 2\n", [(1,), (None,)], [(3, "v", " 2", "not a bigint")]),
        ("v\n1.5\n1d\n", [(1.5,), (None,)], [(3, "v", "1d", "not a double")]),
        ("v\n1\n+2\n\x7f3\n4\t\n-5\n007\n", [(1,), (None,), (None,), (None,), (-5,), (7,)], [(3, "v", "+2", "not a bigint"), (4, "v", "\x7f3", "not a bigint"), (5, "v", "4\t", "not a bigint")]),
        ("v\n.5\n2.\n+1e3\n0x1p3\n1f\n 7\n-inf\n", [(0.5,), (2.0,), (1000.0,), (None,), (None,), (None,), (-math.inf,)], [(5, "v", "0x1p3", "not a double"), (6, "v", "1f", "not a double"), (7, "v", " 7", "not a double")]),
        ("k,v\r\nx,1\r\n\r\ny,2\r\r\n", [("x", 1), ("y", None)], [(4, "v", "2\r", "not a bigint")]),
    ],
)
def test_edge_cases(load, text, want, bad):
    table, report = load(text)
    assert rows(table) == want and errors(report) == bad


def test_headers(load):
    assert load("﻿a,a,b c\n1,2,3\n")[0].columns == ["a", "a_1", "b c"]
    assert load("a,b\r\n1,2\r\n")[0].columns == ["a", "b"]


def test_nan_and_infinity(load):
    table, _ = load("v\n1.5\nnan\ninf\n")
    assert table.aggregate("v", "min") == 1.5 and table.aggregate("v", "max") == math.inf and math.isnan(table.aggregate("v", "sum"))
    from quern.functions.predicates import greater_than

    assert sorted(r[0] for r in table.filter("v", greater_than(1.0)).collect()) == [0, 2]


def test_positions_over_splits(spark, tmp_path):
    lines = ["k,v"] + [("" if k % 97 == 0 else "x" if k % 89 == 0 else f"k{k},{k}") for k in range(1, 30_001)]
    path = tmp_path / "big.csv"
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        table, report = read_csv(spark, str(path))
        assert table.df.rdd.getNumPartitions() > 3
        kept = [line for line in lines[1:] if "," in line]
        got = {r["row_index"]: r["k"] for r in table.indexed().collect()}
        assert [got[k] for k in range(len(kept))] == [line.split(",")[0] for line in kept]
        assert sorted(r["row"] for r in report.errors.collect()) == [k + 1 for k, line in enumerate(lines) if line == "x"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_data_row_equal_to_the_header(spark, tmp_path):
    """It is a row in a folder as it is in one file, wherever the file's lines are read."""
    parts = ["k,v\na,b\nk,v\nc,d\n", "k,v\n" + "x,y\n" * 5 + "k,v\nk,v\r\n", "k,v\r\ne,f\n", "k,v\n", "g,h\n"]
    want = []
    for k, part in enumerate(parts):
        (tmp_path / f"{k}.csv").write_bytes(part.encode())
        lines = part.replace("\r", "").splitlines()
        want += [tuple(line.split(",")) for line in (lines if lines[0] != "k,v" else lines[1:])]
    table, report = read_csv(spark, str(tmp_path))
    assert sorted(rows(table)) == sorted(want) and errors(report) == []
    assert sorted(r["row_index"] for r in table.indexed().collect()) == list(range(len(want)))
    (tmp_path / "1.csv").rename(tmp_path / "only")
    assert len(rows(read_csv(spark, str(tmp_path / "only"))[0])) == 7


def test_data_far_from_the_header(spark, tmp_path, load):
    assert rows(load("v\n" + "\n" * 200 + "7\n")[0]) == [(7,)]
    for k in range(100):
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / f"{k:03}.csv").write_text("v\n" if k else "v\n5\n")
    assert rows(read_csv(spark, str(tmp_path / "many"))[0]) == [(5,)]
    for file in (tmp_path / "many").iterdir():
        file.write_text("v\n\n")
    with pytest.raises(LoadError, match="No data rows"):
        read_csv(spark, str(tmp_path / "many"))


def test_folder_round_trip(spark, tmp_path):
    made = sales(spark, 2000)
    write_csv(made, f"{tmp_path}/out")
    table, report = read_csv(spark, f"{tmp_path}/out")
    assert sorted(rows(table)) == sorted(tuple(r) for r in made.collect()) and errors(report) == []
