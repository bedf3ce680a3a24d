"""Cells with line feeds in split files, and the stored inventory of files."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylens.constants import PAYMENT_COLUMN
from paylens.sources import manifest, quoted
from paylens.sources.csv_years import read_payment_file, read_payment_years, read_header
from tests.helpers import NEW, OLD, covered_row, write_csv

COLUMNS = ["remark", f"{NEW}First_Name", f"{NEW}Last_Name", "more", PAYMENT_COLUMN]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def messy_text(n, seed, end="\n", most=40):
    """CSV text with quoted cells of all kinds, stray quotes, blank lines."""
    rng = random.Random(seed)
    bits = ["a", " ", ",", '""', "\n", end, "\n\n", "é", '"",', "long " * 30]
    rows = []
    for i in range(n):
        cells = []
        for c in range(len(COLUMNS)):
            if c == len(COLUMNS) - 1:
                cells.append(str(i))
            elif rng.random() < 0.3:
                cells.append('"' + "".join(rng.choices(bits, k=rng.randint(0, most if rng.random() < 0.05 else 4))) + '"' + (rng.choice(["", "", "x", 'y"z']) if c in (0, 3) else ""))
            else:
                cells.append(rng.choice(["plain", "", '5" pipe', ' "not quoted', 'x"y"', "b"]))
        rows.append(",".join(cells))
        if rng.random() < 0.05:
            rows.append("")
    return end.join([",".join(COLUMNS), *rows]) + end


def python_rows(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return [tuple(r[1:3]) for r in rows[1:]]


@pytest.mark.parametrize("end,seed", [("\n", 1), ("\r\n", 2), ("\n", 3)])
def test_states_agree_with_a_csv_reader(spark, tmp_path, small_splits, end, seed):
    text = messy_text(900, seed, end)
    (tmp_path / "2015_rsh_payments.csv").write_bytes(text.encode())
    path = str(tmp_path / "2015_rsh_payments.csv")
    for how in (None, True):
        got = read_payment_file(spark, path, year=2015, multi_line=how)
        rows = {r.row_pos: (r.persons[0].first, r.persons[0].last, r.amount) for r in got.collect()}
        want = python_rows(text)
        assert len(rows) == len(want) == 900
        for i, (first, last) in enumerate(want):
            assert rows[i][2] == i
            assert (rows[i][0], rows[i][1]) == tuple("" if v in ("",) else v.strip() for v in (first, last))


def test_one_file_is_read_by_many_tasks_and_others_once(spark, tmp_path, small_splits):
    folder = tmp_path / "2016_rsh_payments.csv"
    folder.mkdir()
    write_csv(folder / "part-0.csv", [covered_row("An\nn" if i % 50 == 3 else f"N{i}", "Li\n" * (400 if i == 200 else 1) + "x", str(i)) for i in range(400)])
    write_csv(folder / "part-1.csv", [covered_row("Bo", "Ng", str(i), prefix=OLD) for i in range(300)])
    whole = quoted.records(spark, [str(folder / "part-0.csv")])
    assert whole.where(F.col("_kind") == quoted.WHOLE).select("_block").distinct().count() >= 5
    assert whole.where(F.col("_kind") == quoted.HEAD).count() >= 2  # a record over more than two splits
    got = {r.row_pos: (r.persons[0].first, r.amount) for r in read_payment_years(spark, str(tmp_path), [2016]).collect()}
    assert got == {**{i: ("An\nn" if i % 50 == 3 else f"N{i}", i) for i in range(400)}, **{400 + i: ("Bo", i) for i in range(300)}}


def test_unclosed_cell_ends_with_the_file(spark, tmp_path, small_splits):
    text = messy_text(60, 5) + 'x,Ann,"Li\n' + "more\n" * 900
    (tmp_path / "2015_rsh_payments.csv").write_text(text)
    got = read_payment_file(spark, str(tmp_path / "2015_rsh_payments.csv"), year=2015)
    last = got.orderBy(F.desc("row_pos")).first()
    assert last.row_pos == 60 and last.persons[0].last.startswith("Li\nmore") and last.persons[0].last.count("more") == 900


def test_states_compose():
    rng = np.random.default_rng(1)
    o, s = rng.random(200) < 0.5, rng.random(200) < 0.5
    for start in (False, True):
        state, want = start, []
        for a, b in zip(o, s, strict=True):
            state = bool(b if state else a)
            want.append(state)
        assert quoted.states_after(o, s, start).tolist() == want


def test_manifest_reads_headers_of_changed_files_only(spark, tmp_path):
    store = str(tmp_path / "store")
    folder = tmp_path / "2016_rsh_payments.csv"
    folder.mkdir()
    for i in range(5):
        write_csv(folder / f"part-{i}.csv", [covered_row("Ann", "Li", "1", prefix=OLD if i == 4 else NEW)] * (i + 1))
    (folder / "part-9.csv").write_text("")
    write_csv(tmp_path / "2017_rsh_payments.csv", [{"x": 1}])
    rows = {r.path.rsplit("/", 1)[1]: r for r in manifest.refresh(spark, store, [str(folder), str(tmp_path / "2017_rsh_payments.csv")]).collect()}
    assert sorted(rows) == ["2017_rsh_payments.csv", *[f"part-{i}.csv" for i in range(5)]]
    assert rows["part-4.csv"].layout == "older" and rows["part-0.csv"].layout == "newer" and not rows["part-0.csv"].lacks
    assert PAYMENT_COLUMN in rows["2017_rsh_payments.csv"].lacks and {r.version for r in rows.values()} == {1}
    assert read_payment_years(spark, str(tmp_path), [2016], manifest=store).count() == 15
    told = {r.path.rsplit("/", 1)[1]: r for r in manifest.read_manifest(spark, store).collect()}
    assert [told[f"part-{i}.csv"].records for i in range(5)] == [1, 2, 3, 4, 5] and told["2017_rsh_payments.csv"].records is None
    write_csv(folder / "part-1.csv", [covered_row("Ann", "Li", "1")] * 7)
    (folder / "part-0.csv").unlink()
    assert read_payment_years(spark, str(tmp_path), [2016], manifest=store).count() == 7 + 3 + 4 + 5
    told = {r.path.rsplit("/", 1)[1]: r for r in manifest.read_manifest(spark, store).collect()}
    assert "part-0.csv" not in told and told["part-1.csv"].records == 7
    assert told["part-1.csv"].version > 1 and all(r.version == 1 for n, r in told.items() if n != "part-1.csv")


def test_unchanged_files_are_not_opened(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    write_csv(tmp_path / "2016_rsh_payments.csv", [covered_row("Ann", "Li", "1")])
    read_payment_years(spark, str(tmp_path), [2016], manifest=store)

    def no(*_):
        raise AssertionError("a header was read")

    monkeypatch.setattr(manifest, "with_headers", no)
    assert read_payment_years(spark, str(tmp_path), [2016], manifest=store).count() == 1
    monkeypatch.undo()
    assert read_header(spark, str(tmp_path / "2016_rsh_payments.csv"))[0] == f"{NEW}First_Name"
