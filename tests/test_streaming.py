"""Incremental ingestion: two landings, appended store and index equal a batch run."""

from pyspark.sql import functions as F

from paylens.operators.appearances import appearance_index
from paylens.session import shared_dir
from paylens.sources.csv_years import read_payment_years
from paylens.streaming import read_index, start_ingest
from paylens.streaming.ingest import compact, read_store
from tests.helpers import covered_row, pi_row, write_csv


def test_stream_ingest_matches_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    base = shared_dir(spark, "stream-test")
    store, index, ckpt = f"{base}/store", f"{base}/index", f"{base}/ckpt"

    write_csv(landing / "2015_rsh_payments.csv",
              [covered_row("Ann", "Li", "5", npi="1"), covered_row("Ann", "Li", "N/A", npi="1")])
    q = start_ingest(spark, str(landing), store, index, ckpt, available_now=True)
    q.awaitTermination()
    write_csv(landing / "2016_rsh_payments.csv",
              [pi_row("Study", "Subject", "Ann", "Li", "7", pi_npi="1")])
    q = start_ingest(spark, str(landing), store, index, ckpt, available_now=True)
    q.awaitTermination()

    stored = spark.read.parquet(store)
    assert stored.count() == 3
    assert stored.where(F.col("amount").isNull()).count() == 1
    streamed = {(r.display_name, r.role, r.source_file): float(r.total_payment)
                for r in read_index(spark, index).collect()}
    batch = appearance_index(read_payment_years(spark, str(landing), [2015, 2016]))
    expected = {(r.display_name, r.role, r.source_file): float(r.total_payment)
                for r in batch.collect()}
    assert streamed == expected


def test_parquet_store_round_trip(spark, tmp_path):
    from paylens.operators import report
    from paylens.sources.store import read_canonical, write_canonical
    from tests.helpers import year_dir

    d = year_dir(tmp_path, {2015: [covered_row("Ann", "Li", "5", npi="1", middle="G")],
                            2016: [covered_row("Ann", "Li", "7", npi="1"),
                                   covered_row("Ann", "Li", "x")]})
    pay = read_payment_years(spark, d, [2015, 2016])
    path = write_canonical(pay, shared_dir(spark, "store") + "/canonical", mode="overwrite")
    stored = read_canonical(spark, path)
    want = report.physician_report(spark, pay, "Ann", "G", "Li", [2015, 2016]).collect()
    got = report.physician_report(spark, stored, "Ann", "G", "Li", [2015, 2016]).collect()
    assert got == want and stored.where(F.col("amount").isNull()).count() == 1


def test_republished_year_and_unlike_headers(spark, tmp_path):
    landing, base = tmp_path / "landing", shared_dir(spark, "stream-again")
    store, index, ckpt = f"{base}/store", f"{base}/index", f"{base}/ckpt"

    def land():
        q = start_ingest(spark, str(landing), store, index, ckpt, available_now=True)
        q.awaitTermination()

    first = landing / "june" / "2015_rsh_payments.csv"
    first.mkdir(parents=True)
    write_csv(first / "a.csv", [covered_row("Ann", "Li", "5", npi="1")])
    names = list(covered_row("a", "b", "1"))
    write_csv(first / "b.CSV", [covered_row("Bo", "Ng", "5", npi="2")], columns=names[::-1])
    land()
    assert {(r.first_name, r.last_name, float(r.total_payment)) for r in read_index(spark, index).collect()} == {
        ("Ann", "Li", 5.0), ("Bo", "Ng", 5.0)}
    second = landing / "july"
    second.mkdir()
    write_csv(second / "2015_rsh_payments.csv", [covered_row("Ann", "Li", "6", npi="1")])
    land()
    assert [(r.first_name, float(r.total_payment)) for r in read_index(spark, index).collect()] == [("Ann", 6.0)]
    assert read_store(spark, store).count() == 1

    third = landing / "august"
    third.mkdir()
    write_csv(third / "2015_rsh_payments.csv", [covered_row("Ann", "Li", "8", npi="1"), covered_row("Cy", "Ng", "1", npi="3")])
    write_csv(third / "2016_rsh_payments.csv", [covered_row("Ann", "Li", "2", npi="1")])
    land()
    want = sorted(map(str, read_index(spark, index).collect())), sorted(map(str, read_store(spark, store).collect()))
    assert spark.read.parquet(store).select("pub").distinct().count() == 4  # june, july, and two of august
    assert compact(spark, store, index) == 4 and compact(spark, store, index) == 0  # june and july, in both
    assert spark.read.parquet(store).count() == 3 and spark.read.parquet(index).count() == 3
    assert want == (sorted(map(str, read_index(spark, index).collect())), sorted(map(str, read_store(spark, store).collect())))


def test_part_files_of_several_batches_are_numbered_together(spark, tmp_path):
    landing, base = tmp_path / "landing", shared_dir(spark, "stream-parts")
    folder = landing / "2015_rsh_payments.csv"
    folder.mkdir(parents=True)
    for i in range(3):
        write_csv(folder / f"part-{i}.csv", [covered_row(f"N{i}-{j}", "Li", "5", npi="7" if j == 1 else "") for j in range(4)])
    q = start_ingest(spark, str(landing), f"{base}/store", f"{base}/index", f"{base}/ckpt", available_now=True, max_files=1)
    q.awaitTermination()
    assert spark.read.parquet(f"{base}/store").select("batch_id").distinct().count() == 3
    whole = {(r.row_pos, r.persons[0].first, r.identifier) for r in read_payment_years(spark, str(landing), [2015]).collect()}
    got = [(r.row_pos, r.persons[0].first, r.identifier) for r in read_store(spark, f"{base}/store").collect()]
    assert len(got) == 12 and set(got) == whole and (2, "N0-2", "UNKNOWN_2") in whole
