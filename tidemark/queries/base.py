"""Registration of queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.churn import subscription_view
from tidemark.plans.incidents import incident_view
from tidemark.plans.profit import order_profit_view
from tidemark.plans.rfm import clean_transactions, sales_of
from tidemark.queries.oracle import CTES
from tidemark.runtime import kept
from tidemark.sources.roles import SNAPSHOT, Tables


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


class Inputs(Tables):
    """Role views plus the cleaned views built on them."""

    @property
    def subs_v(self) -> DataFrame:
        return subscription_view(self.subs, SNAPSHOT)

    @property
    def lines(self) -> DataFrame:
        return kept(self.spark, f"{self.path}/lines",
                    lambda: order_profit_view(self.order_lines_raw, self.products, within=["order_id"]),
                    self._files("lineitem", "orders", "part"))

    @property
    def incidents(self) -> DataFrame:
        return incident_view(self.incidents_raw, ["tie_1", "tie_2", "tie_3", "tie_4"], self.vehicle_spellings)

    @property
    def tx(self) -> DataFrame:
        return kept(self.spark, f"{self.path}/tx",
                    lambda: clean_transactions(self.transactions_raw, self.country_names, within=["invoice_no"]),
                    self._files("lineitem", "orders", "customer", "nation", "part"))

    def _files(self, *tables: str) -> list[str]:
        """The tables that a stored view is made of."""
        return [f"{self.path}/{t}.parquet" for t in tables]

    @property
    def sales(self) -> DataFrame:
        return sales_of(self.tx)


def present(df: DataFrame) -> DataFrame:
    """Decimals as doubles at the boundary, where results are compared."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in wide}) if wide else df


def with_ctes(body: str, names: tuple[str, ...]) -> str:
    """Prefix a statement with the role views it reads, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    body = body.strip()
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in ordered)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(key: str, *ctes: str, sql: str | None = None):
    """Register a function of Inputs under a key, with its SQL check."""

    def register(build: Callable[[Inputs], DataFrame]):
        if key in CATALOGUE:
            raise ValueError(f"duplicate query {key}")
        CATALOGUE[key] = Query(
            run=lambda spark, path: present(build(Inputs(spark, path))),
            sql=None if sql is None else with_ctes(sql, ctes),
        )
        return build

    return register
