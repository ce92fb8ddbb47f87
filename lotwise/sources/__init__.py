from lotwise.sources.listings import (
    RAW_COLUMNS,
    listing_view,
    raw_schema,
    read_listing_csv,
    read_table_csv,
    write_table,
)
from lotwise.sources.metric_log import parse_metric_log, read_metric_log
from lotwise.sources.tables import table, nan_to_null

__all__ = [
    "RAW_COLUMNS",
    "listing_view",
    "nan_to_null",
    "parse_metric_log",
    "raw_schema",
    "read_listing_csv",
    "read_metric_log",
    "read_table_csv",
    "table",
    "write_table",
]
