"""tillwork: retail analytics over one sales fact table, written as Spark jobs."""

from tillwork.sources.star import Star
from tillwork.sources.sales_files import read_sales, write_sales

__all__ = ["Star", "read_sales", "write_sales"]
