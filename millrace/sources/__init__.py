"""Reading the tables and writing results."""

from .bucketed import bucketed_tables, write_bucketed
from .results import run_batch, write_csv
from .tables import TABLES, Tables, forget, load_tables

__all__ = ["TABLES", "Tables", "bucketed_tables", "forget", "load_tables", "run_batch", "write_bucketed", "write_csv"]
