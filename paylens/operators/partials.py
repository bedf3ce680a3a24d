"""Stored results of searches, so that a new year or a new name scans no more than it
must (A1-A4, D3, D4).

A batch's costly part is the match of searches with payment rows. Its result per search,
year and identifier -- total, entries, the identity of the first row -- is additive over
years, so it is kept: ``parts`` holds those rows in folders by year, ``held`` says which
(search, year) pairs are there and in which version. An update takes the pairs that are
not held, scans the years that they name only, and writes a new version; the report is
an aggregation of the parts. A pair that matched nothing is held as well.

Parts count once a complete ``held`` names their version, so an update that fails leaves
the store as it was. A year that was published anew is told to ``update`` by ``again``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.operators import matching, report
from paylens.operators.matching import SPEC
from paylens.operators.report import unique_years
from paylens.plans.layouts import valid_payments
from paylens.session import staged
from paylens.sources.manifest import complete_versions

HELD = ("spec_hash long, q_kf string, q_kl string, q_km string, q_mid_prefix string, q_mid_initial boolean, "
        "year int, version int")
PAIR = ["spec_hash", *SPEC, "year"]


class PartialStore:
    """Searches of one kind (``case_sensitive`` or not) over one set of payments."""

    def __init__(self, spark: SparkSession, path: str, case_sensitive: bool = False):
        self.spark, self.path, self.case_sensitive = spark, path.rstrip("/"), case_sensitive

    def held(self) -> DataFrame:
        """The newest complete list of (search, year) pairs."""
        versions = complete_versions(self.spark, f"{self.path}/held")
        if not versions:
            return self.spark.createDataFrame([], HELD)
        return self.spark.read.schema(HELD).parquet(f"{self.path}/held/v={versions[-1]}")

    def _same(self, left: DataFrame, right: DataFrame, names: Sequence[str]) -> list[Column]:
        return [left[c].eqNullSafe(right[c]) for c in names]

    def update(self, payments: DataFrame, accepted: DataFrame, years: Sequence[int], again: Sequence[int] = ()) -> list[int]:
        """Search what is not held; ``payments`` are canonical rows, of which the years
        that lack a pair are read. Returns those years."""
        queries = accepted.select("query_id", "first_name", "middle_name", "last_name")
        specs = staged(matching.search_specs(matching.prepare_queries(queries, self.case_sensitive)), "partial-specs")
        held = self.held().where(~F.col("year").isin([int(y) for y in again])) if again else self.held()
        wanted = specs.withColumn("year", F.explode(F.array(*[F.lit(y) for y in unique_years(years)])))
        missing = staged(wanted.join(held, self._same(wanted, held, PAIR), "left_anti").select(*PAIR), "partial-missing")
        lacking = sorted(r[0] for r in missing.select("year").distinct().collect())  # requested years
        if not lacking:
            return []
        version = max(complete_versions(self.spark, f"{self.path}/held"), default=0) + 1
        asked = missing.select("spec_hash", *SPEC).distinct()
        scoped = valid_payments(payments).where(F.col("year").isin(lacking))
        matched = matching.match_specs(scoped, asked, case_sensitive=self.case_sensitive, spec_bytes=matching.table_bytes(asked))
        found = report.year_search(matched, ["spec_hash", *SPEC])
        new = found.join(missing, self._same(found, missing, PAIR), "left_semi")
        new.write.mode("overwrite").partitionBy("year").parquet(f"{self.path}/parts/version={version}")
        listed = held.unionByName(missing.withColumn("version", F.lit(version)))
        listed.coalesce(8).write.mode("overwrite").parquet(f"{self.path}/held/v={version}")
        return lacking

    def parts(self, years: Sequence[int]) -> DataFrame:
        """(search, year, identifier, total, entries, name, specialty) of held pairs."""
        schema = ("spec_hash long, q_kf string, q_kl string, q_km string, q_mid_prefix string, q_mid_initial boolean, identifier string, "
                  "total decimal(38,6), entries long, name string, specialty string, version int, year int")
        if not complete_versions(self.spark, f"{self.path}/held"):
            return self.spark.createDataFrame([], schema).drop("version")
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/parts").where(F.col("year").isin(unique_years(years)))
        held = self.held()
        return rows.join(held, self._same(rows, held, [*PAIR, "version"]), "left_semi").drop("version")

    def detail(self, accepted: DataFrame, years: Sequence[int], merge: str = "reference") -> DataFrame:
        """D3 for every accepted name whose searches are held: what ``batch_detail`` gives."""
        queries = accepted.select("query_id", "first_name", "middle_name", "last_name")
        prepared = matching.prepare_queries(queries, self.case_sensitive)
        per_year = matching.attach_queries(self.parts(years), prepared, matching.spec_size(matching.table_bytes(queries)))
        return report.combine_years(report.merge_modes(per_year, merge), unique_years(years))
