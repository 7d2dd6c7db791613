"""Where the sixteen report tables come from."""

from boletim.sources.files import read_parquet
from boletim.sources.jdbc import jdbc_options, read_jdbc
from boletim.sources.trade import school_tables

__all__ = ["jdbc_options", "read_jdbc", "read_parquet", "school_tables"]
