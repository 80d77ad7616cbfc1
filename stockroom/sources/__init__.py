from stockroom.sources.adapters import RetailTables, load_retail_from_star  # noqa: F401
from stockroom.sources.tables import read_retail_tables, write_retail_tables  # noqa: F401
