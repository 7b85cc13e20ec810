"""Variable catalogue: multi-line CSV and its control columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Population of each variable (NULL outside it) and build step of each group.
APPLIES_TO = {
    "aum_outflow": "has_investments",
    "salary_deposit_stopped_flag": "has_payroll_stream",
    "recurring_deposit_stopped_flag": "has_any_recurring_stream",
    "recurring_deposit_change_pct": "has_any_recurring_stream",
    "investment_redemption_pct": "has_investments",
    "aum_vs_baseline_pct": "has_investments & history_months>=6",
    "pension_deposit_stopped_flag": "has_pension_stream",
    "business_payroll_stopped_flag": "has_linked_business",
    "fixed_income_maturity_not_reinvested": "has_investments & had_maturities_90d",
    "cash_pct_of_portfolio_chg": "has_investments",
    "return_vs_benchmark": "has_advisory",
    "trustee_change_flag": "has_trust",
    "positions_liquidated_pct": "has_investments",
}
STEP_BY_GROUP = {
    "Balances & AUM": 1, "Recurring deposits & flows": 2, "Transfers": 3, "Investments": 4,
    "Relationship & closures": 5, "Banker": 6, "Complaints & voice of client": 7,
    "External & composite": 8,
}


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Quoted multi-line CSV keyed by id."""
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .csv(path).withColumn("id", F.col("id").cast("int")))


def _map(values: dict) -> "F.Column":
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def catalog_controls(catalog: DataFrame, built: list[str]) -> DataFrame:
    """Add population, build step and status."""
    return (catalog
            .withColumn("applies_to", F.coalesce(F.try_element_at(_map(APPLIES_TO),
                                                                  F.col("variable")), F.lit("all")))
            .withColumn("build_step", F.try_element_at(_map(STEP_BY_GROUP), F.col("group")))
            .withColumn("status", F.when(F.col("variable").isin(*built), "built")
                        .otherwise("pending")))


def check_catalog(catalog: DataFrame, expected: int) -> None:
    row = catalog.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d")).first()
    if row["n"] != expected or row["d"] != expected:
        raise ValueError(f"catalogue has {row['n']} rows and {row['d']} ids, expected {expected}")
