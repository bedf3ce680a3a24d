"""Stored results of searches: equal to a whole batch, scanning what is new only."""

from pyspark.sql import functions as F

from paylens.operators import batch
from paylens.operators.partials import PartialStore
from paylens.sources.csv_years import read_payment_years
from tests.helpers import covered_row, year_dir


def rows(df):
    return sorted(map(str, df.collect()))


def test_update_reads_missing_years_and_names_only(spark, tmp_path):
    folder = year_dir(tmp_path, {y: [covered_row("Ann", "Li", str(y - 2000), npi="1", middle="G"), covered_row("Ann", "Li", "2", npi=str(y)),
                                     covered_row("Bo", "Ng", "3", pi={1: ("Ann", "", "Li", "9")})] for y in (2015, 2016, 2017)})
    pay = read_payment_years(spark, folder, [2015, 2016, 2017])
    few = batch.accepted_names(batch.parse_names(batch.names_frame(spark, ["Ann G Li", "Nobody Here"])))
    more = batch.accepted_names(batch.parse_names(batch.names_frame(spark, ["Ann G Li", "Nobody Here", "Bo Ng", "ann LI"])))
    store = PartialStore(spark, str(tmp_path / "store"))
    assert store.update(pay, few, [2015, 2016]) == [2015, 2016]
    assert rows(store.detail(few, [2015, 2016])) == rows(batch.batch_detail(pay, few, [2015, 2016]))
    assert store.update(pay, few, [2015, 2016]) == []  # pairs without a match are held too

    assert store.update(pay.where("year = 2017"), few, [2015, 2016, 2017]) == [2017]
    years = [2015, 2016, 2017]
    assert rows(store.detail(few, years)) == rows(batch.batch_detail(pay, few, years))
    assert store.update(pay, more, years) == years  # a new name is searched in all years
    for merge in ("reference", "by_id"):
        assert rows(store.detail(more, years, merge)) == rows(batch.batch_detail(pay, more, years, merge=merge))
    assert rows(store.detail(few, [2016])) == rows(batch.batch_detail(pay, few, [2016]))


def test_a_year_published_again_replaces_what_was_there(spark, tmp_path):
    first = year_dir(tmp_path, {2015: [covered_row("Ann", "Li", "5", npi="1")], 2016: [covered_row("Ann", "Li", "6", npi="1")]})
    old = read_payment_years(spark, first, [2015, 2016])
    names = batch.accepted_names(batch.parse_names(batch.names_frame(spark, ["Ann Li"])))
    store = PartialStore(spark, str(tmp_path / "store"))
    store.update(old, names, [2015, 2016])
    new = old.withColumn("amount", F.when(F.col("year") == 2016, F.lit(60).cast("decimal(38,6)")).otherwise(F.col("amount")))
    assert store.update(new, names, [2015, 2016], again=[2016]) == [2016]
    (r,) = store.detail(names, [2015, 2016]).collect()
    assert (float(r.Payment_2015_USD), float(r.Payment_2016_USD)) == (5.0, 60.0)


def test_empty_store(spark, tmp_path):
    names = batch.accepted_names(batch.parse_names(batch.names_frame(spark, ["Ann Li"])))
    assert PartialStore(spark, str(tmp_path / "none")).detail(names, [2015]).count() == 0
