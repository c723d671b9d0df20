"""Queries on nested records and on quantities (problems 1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.nested import inventory, observed_edges, observed_table, record_elements, record_plans, table_elements
from folioforge.operators.units import Quantity, normalise_amounts, unit_solutions
from folioforge.plans.registry import Registry
from folioforge.session import table

registry = Registry()


def _paths(plan, path: str = "") -> list[str]:
    out = []
    for c in plan.children:
        at = f"{path}.{'.'.join(c.steps)}".strip(".")
        out += [at, *_paths(c, at)]
    return out


@registry.query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The links of the tables that the problem lists, out of the whole tables that the data have."""
    elements = record_elements(table(spark, sf, "doc_records"), observed=True)
    listed = [f"{source} {path}" for source, (_, plan) in record_plans().items() for path in [*_paths(plan), "unparseable"]]
    return elements.filter(F.concat_ws(" ", "source_column", "child_path").isin(listed)).select("id", "source_column", "child_path", "parent_key", "child_key")


@registry.query("p1_tables")
def p1_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The tables that the records shed, with their columns."""
    return inventory(record_elements(table(spark, sf, "doc_records"), with_root=True, observed=True))


# The other tables of the records: query -> (source, table, SQL types of columns that aren't strings).
TABLES = {
    "p1_line_items": ("extracted", "line_items", {"line_no": "int", "description": "string", "quantity": "bigint"}),
    "p1_anomalies": (
        "anomaly", "anomalies",
        {"code": "string", "severity": "string", "message": "string", "amount": "double", "confidence": "double", "subtotal": "double", "tax": "double", "discrepancy": "double", "text_length": "bigint"},
    ),
    "p1_extractions": ("extracted", "", {}),
    "p1_fields": ("extracted", "fields", {}),
    "p1_candidates": ("extracted", "fields.candidates", {}),
    "p1_skills": ("extracted", "fields.skills_list", {}),
    "p1_missing_fields": ("extracted", "missing_fields", {}),
    "p1_taxes": ("extracted", "line_items.taxes", {}),
    "p1_validations": ("validation", "", {}),
    "p1_passed_fields": ("validation", "passed_fields", {}),
    "p1_failed_fields": ("validation", "failed_fields", {}),
    "p1_field_errors": ("validation", "field_errors", {}),
    "p1_field_results": ("validation", "field_results", {}),
    "p1_checks": ("validation", "field_results.checks", {}),
    "p1_reports": ("anomaly", "", {}),
    "p1_matched_ids": ("anomaly", "anomalies.matched_ids", {}),
    "p1_evidence": ("anomaly", "anomalies.details.evidence", {}),
}


def _register(name: str, source: str, path: str, kinds: dict[str, str]) -> None:
    @registry.query(name)
    def flat(spark: SparkSession, sf: str) -> DataFrame:
        """A flat table of the records, with every column that occurs."""
        return observed_table(table_elements(table(spark, sf, "doc_records"), source, path), source, path, kinds)


for _name, _table in TABLES.items():
    _register(_name, *_table)


@registry.query("p1_schema_edges")
def p1_schema_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The nesting that occurs in the extractor's output."""
    keyed = ["extraction.fields", "extraction.flat_values"]
    return observed_edges(table(spark, sf, "doc_records"), "extracted_json", "extraction", keyed)


def _amounts(spark: SparkSession, sf: str) -> DataFrame:
    invoices = table(spark, sf, "doc_records").filter(F.col("document_type") == "Invoice")
    return normalise_amounts(
        invoices.select("id", "total_amount", "text_preview", "extracted_json"), table(spark, sf, "currency_rates")
    )


@registry.query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _amounts(spark, sf).filter("amount_stated AND amount_usd_cents IS NOT NULL").select("id", "amount_usd_cents")


@registry.query("p4_amounts")
def p4_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return _amounts(spark, sf).select(
        "id",
        "total_amount",
        F.col("amount_value").cast("double").alias("amount_value"),
        "amount_currency",
        "amount_power",
        F.bround("amount_residual", 6).alias("amount_residual"),
        "amount_stated",
        "amount_unique",
    )


@registry.query("p4_unstated")
def p4_unstated(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts whose currency is stated nowhere, or whose stated reading doesn't fit: what the residuals alone choose."""
    docs = table(spark, sf, "doc_records").filter("document_type = 'Invoice'").select("id", "total_amount", "text_preview", "extracted_json")
    df = normalise_amounts(docs, table(spark, sf, "currency_rates"), trust=0.5)
    return df.filter("amount_value IS NOT NULL AND (NOT amount_stated OR NOT amount_unique)").select(
        "id", "total_amount", F.col("amount_value").cast("double").alias("amount_value"), "amount_currency", "amount_power", F.bround("amount_residual", 6).alias("amount_residual"), "amount_unique", "amount_usd_cents"
    )


_PRICE_UNITS = {"dollar": 1.0, "cent": 0.01}
_COUNT_UNITS = {"piece": 1.0, "dozen": 12.0}


@registry.query(
    "p4_units",
    f"""WITH l AS (SELECT l_returnflag, l_extendedprice AS e, l_quantity AS q, p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 0 AND l_quantity > 0 AND p_retailprice > 0),
    u AS (SELECT * FROM (VALUES {", ".join(f"('{a}', CAST({x} AS DOUBLE))" for a, x in _PRICE_UNITS.items())}) a(eu, ef), (VALUES {", ".join(f"('{a}', CAST({x} AS DOUBLE))" for a, x in _COUNT_UNITS.items())}) b(qu, qf),
    (VALUES {", ".join(f"('{a}', CAST({x} AS DOUBLE))" for a, x in _PRICE_UNITS.items())}) c(pu, pf)),
    s AS (SELECT l_returnflag, eu, qu, pu, round(avg(abs(ln(e) - ln(q) - ln(p) + ln(ef) - ln(qf) - ln(pf))), 9) AS cost FROM l, u GROUP BY l_returnflag, eu, qu, pu),
    r AS (SELECT *, row_number() OVER w AS place, lead(cost) OVER w AS second FROM s WINDOW w AS (PARTITION BY l_returnflag ORDER BY cost, eu, qu, pu))
    SELECT l_returnflag, eu AS price_unit, qu AS quantity_unit, pu AS retail_unit, round(cost, 5) AS residual, round(second, 5) AS runner_up, cost <= 0.05 AND second - cost > 0.05 AS is_unique FROM r WHERE place = 1""",
)
def p4_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of prices and quantities of each kind of line, by price = quantity x retail price."""
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_extendedprice", "l_quantity").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    quantities = [Quantity("l_extendedprice", _PRICE_UNITS), Quantity("l_quantity", _COUNT_UNITS), Quantity("p_retailprice", _PRICE_UNITS)]
    found = unit_solutions(lines, "l_returnflag", quantities, [{"l_extendedprice": 1, "l_quantity": -1, "p_retailprice": -1}])
    return found.select(
        "l_returnflag", F.col("unit_l_extendedprice").alias("price_unit"), F.col("unit_l_quantity").alias("quantity_unit"), F.col("unit_p_retailprice").alias("retail_unit"),
        F.round("residual", 5).alias("residual"), F.round("runner_up", 5).alias("runner_up"), F.col("unique").alias("is_unique"),
    )
