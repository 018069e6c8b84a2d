"""SQL over registered frames, by Spark's own parser and analyzer."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tarnbeck.errors import EngineError, suggest

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass
class SqlExecutor:
    """Registers frames under names and runs SELECT statements over them."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame) -> None:
        if not _NAME.fullmatch(name):
            raise EngineError("register", f"not a table name: {name!r}")
        df.createOrReplaceTempView(name)
        self.tables[name] = df

    def registered(self) -> list[str]:
        return sorted(self.tables)

    def clear(self) -> None:
        for name in self.tables:
            self.spark.catalog.dropTempView(name)
        self.tables.clear()

    def _plan(self, query: str, args: dict | None = None) -> DataFrame:
        if not re.match(r"\s*(--[^\n]*\n\s*)*(SELECT|WITH|VALUES|FROM|\()", query, re.IGNORECASE):
            raise EngineError("sql", "only queries are run")
        try:
            return self.spark.sql(query, args=args) if args else self.spark.sql(query)
        except ParseException as e:
            raise EngineError("sql", f"cannot be parsed: {e}") from e
        except AnalysisException as e:
            missing = re.search(r"table or view `?([A-Za-z0-9_]+)`?", str(e))
            near = suggest(missing[1], self.tables) if missing else []
            raise EngineError("sql", f"cannot be resolved: {e}", hint=f"did you mean {', '.join(near)}?" if near else None) from e

    def execute(self, query: str, args: dict | None = None) -> DataFrame:
        """The result, not yet computed; args fills in :name markers."""
        return self._plan(query, args)

    def validate(self, query: str) -> None:
        """Raises if the query cannot be parsed or resolved."""
        self._plan(query)

    def explain(self, query: str, mode: str = "formatted") -> str:
        return self._plan(query)._explain_string(extended=mode) if hasattr(DataFrame, "_explain_string") else self._plan(query)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def batch(self, queries: list[str]) -> list[DataFrame]:
        """Plans all queries; the first that fails names its place."""
        out = []
        for k, q in enumerate(queries):
            try:
                out.append(self._plan(q))
            except EngineError as e:
                raise EngineError("batch", f"query {k}: {e}") from e
        return out

    def prepare(self, query: str) -> PreparedQuery:
        """A query to run many times; one without markers is checked at once."""
        if not re.search(r":[A-Za-z_]", query):
            self.validate(query)
        return PreparedQuery(self, query)


@dataclass
class PreparedQuery:
    executor: SqlExecutor
    query: str

    def execute(self, **args) -> DataFrame:
        return self.executor.execute(self.query, args or None)
