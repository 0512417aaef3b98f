"""Sales written to files and read back."""

from __future__ import annotations

from tillwork.operators import sales
from tillwork.plans.dashboard_queries import FILTERED, filtered
from tillwork.plans.oracle import average, on_sales, rounded, total
from tillwork.plans.registry import query
from tillwork.plans.report_queries import MONTH
from tillwork.sources import sales_files
from tillwork.sources.scratch import new_path
from tillwork.sources.star import Star


@query("export_filtered_csv", on_sales(f"""
SELECT transaction_id, transaction_date, customer_id, product_category, product_name, region,
       sales_channel, quantity, {rounded('total_amount')} AS total_amount
FROM filtered""", FILTERED))
def export_filtered_csv(star: Star):
    path = new_path(star.spark, "export-csv")
    rows = filtered(star, "transaction_id", "customer_id", "product_name", "quantity", "total_amount")
    columns = [
        "transaction_id", "transaction_date", "customer_id", "product_category", "product_name",
        "region", "sales_channel", "quantity", "total_amount"]
    rows = rows.select(*columns)
    sales_files.export_csv(rows, path)
    return sales_files.read_sales(star.spark, path, "csv", schema=rows.schema)


@query("sales_table", on_sales(f"""
SELECT {MONTH} AS month, {total('total_amount')} AS monthly_revenue,
       COUNT(*) AS transaction_count, {average('total_amount')} AS avg_order_value
FROM sales
GROUP BY {MONTH}"""))
def sales_table(star: Star):
    """Write the whole view by month and report every month from what was written."""
    path = new_path(star.spark, "sales")
    sales_files.write_sales(star.sales(), path)
    return sales.monthly_revenue(star.spark.read.parquet(path))
