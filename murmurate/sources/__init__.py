"""Where data comes from: directories of Parquet tables, env files, log folders."""

from .envfile import parse_env, read_env
from .tables import database_tables, parquet_tables, register_database

__all__ = ["database_tables", "parquet_tables", "parse_env", "read_env", "register_database"]
