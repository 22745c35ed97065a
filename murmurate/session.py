"""The engine: a guarded, session-scoped front to the catalog and SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import catalog, serverinfo, sql
from .sources import register_database


class NotConnectedError(RuntimeError):
    pass


class Engine:
    """Operators over one Spark session. The caller owns the session: ``disconnect`` drops what
    the engine registered and forgets the session, but does not stop it. The current database
    belongs to the session, and is not shared with other sessions."""

    def __init__(self, spark: SparkSession | None = None):
        self._spark = spark
        self._databases: list[str] = []
        self._before = "default"

    @staticmethod
    def start(master: str = "local[*]", name: str = "murmurate", **conf: str) -> Engine:
        """An engine over a new or the active session."""
        builder = SparkSession.builder.master(master).appName(name)
        for k, v in conf.items():
            builder = builder.config(k, v)
        return Engine(builder.getOrCreate())

    @staticmethod
    def session_exists() -> bool:
        return SparkSession.getActiveSession() is not None

    @property
    def connected(self) -> bool:
        return bool(self._databases) and self._spark is not None

    def _guarded(self) -> SparkSession:
        if not self.connected:
            raise NotConnectedError("connect to a data root first")
        return self._spark

    def connect(self, root: str, database: str) -> Engine:
        """Register the Parquet tables of ``root`` as ``database`` and make it current. Doing it
        again is harmless; a failure raises and leaves the engine as it was."""
        spark = self._spark or SparkSession.getActiveSession()
        if spark is None:
            raise NotConnectedError("there is no Spark session")
        register_database(spark, root, database)
        if not self._databases:
            self._before = spark.catalog.currentDatabase()
        self._spark = spark
        if database not in self._databases:
            self._databases.append(database)
        spark.catalog.setCurrentDatabase(database)
        return self

    def disconnect(self) -> None:
        """Drop the engine's databases from the catalog (files stay) and forget the session."""
        spark = self._guarded()
        spark.catalog.setCurrentDatabase(self._before)
        for name in self._databases:
            spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
        self._databases, self._spark = [], None

    def health(self) -> bool:
        """Whether the session answers a query."""
        spark = self._spark or SparkSession.getActiveSession()
        return spark is not None and spark.sql("SELECT 1").first()[0] == 1

    def databases(self) -> DataFrame:
        return catalog.list_databases(self._guarded())

    def tables(self, database: str | None = None) -> DataFrame:
        return catalog.list_tables(self._guarded(), database)

    def use(self, database: str) -> DataFrame:
        return catalog.use_database(self._guarded(), database)

    def current_database(self) -> str:
        return catalog.current_database(self._guarded())

    def server_information(self) -> DataFrame:
        return serverinfo.server_information(self._guarded())

    def query(self, text: str, params: Sequence | None = None) -> DataFrame:
        return sql.run_query(self._guarded(), text, params)

    def queries(self, texts: Sequence[str]) -> list[DataFrame]:
        return sql.run_queries(self._guarded(), texts)
