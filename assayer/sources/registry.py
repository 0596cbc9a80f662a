"""Named tables and guarded, read-only SQL over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from assayer.functions.tokens import FORBIDDEN_SQL_WORDS
from assayer.operators import frames

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
# Text in which a forbidden word or a semicolon means nothing: literals, quoted names, comments.
QUOTED_OR_COMMENT = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)


def check_identifier(name: str) -> str:
    if not isinstance(name, str):
        raise TypeError("a table name must be a string")
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"invalid table name: {name}")
    return name


def validate_query(query: str) -> tuple[bool, str | None]:
    """``(True, None)`` for one read-only statement, else ``(False, reason)``.

    Words inside literals and comments do not count, and ``replace(`` is the
    string function; ``WITH ... INSERT`` is caught by the word check.
    """
    if not isinstance(query, str):
        return False, "the query must be a string"
    bare = QUOTED_OR_COMMENT.sub(lambda m: " " if m[0][:2] in ("--", "/*") else "''", query).strip().lower()
    bare = bare.removesuffix(";").strip()
    if not bare:
        return False, "the query is empty"
    if ";" in bare:
        return False, "only one statement is allowed"
    if not re.match(r"(select|with)\b", bare):
        return False, "only SELECT and WITH queries are allowed"
    for word in FORBIDDEN_SQL_WORDS:
        call = r"(?!\s*\()" if word == "replace" else ""
        if re.search(rf"\b{word}\b{call}", bare):
            return False, f"forbidden word: {word.upper()}"
    return True, None


def plan_commands(spark: SparkSession, query: str) -> list[str]:
    """Kinds of the nodes in a statement's parsed plan that do something besides reading: inserts, definitions, other commands."""
    kinds = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}") for name in ("Command", "ParsedStatement")]
    found, open_ = [], [spark._jsparkSession.sessionState().sqlParser().parsePlan(query)]
    while open_:
        node = open_.pop()
        if any(kind.isInstance(node) for kind in kinds):
            found.append(node.nodeName())
        for below in (node.children(), node.innerChildren()):  # the latter are the queries of WITH
            open_ += [below.apply(i) for i in range(below.size()) if hasattr(below.apply(i), "innerChildren")]
    return found


class TableRegistry:
    """Tables registered in a session as temporary views, queried read-only."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._names: set[str] = set()

    def register(self, df: DataFrame, name: str = "dataset") -> DataFrame:
        """Register or replace a table. Empty tables are refused."""
        check_identifier(name)
        if df.isEmpty():
            raise ValueError("an empty table cannot be registered")
        df.createOrReplaceTempView(name)
        self._names.add(name.lower())
        return df

    def is_registered(self, name: str) -> bool:
        return isinstance(name, str) and name.lower() in self._names

    def describe(self, name: str = "dataset") -> DataFrame:
        """``(column_name, column_type)`` in table order."""
        check_identifier(name)
        if not self.is_registered(name):
            raise ValueError(f"table {name} is not registered")
        return frames.local_rows(self.spark, self.spark.table(name).dtypes, "column_name string, column_type string")

    def columns(self, name: str = "dataset") -> list[str]:
        check_identifier(name)
        return self.spark.table(name).columns

    def query(self, sql: str) -> DataFrame:
        """Run one read-only statement, lazily. Its words are checked, then what it parses to."""
        ok, reason = validate_query(sql)
        if not ok:
            raise ValueError(f"query rejected: {reason}")
        statement = sql.strip().removesuffix(";")
        commands = plan_commands(self.spark, statement)
        if commands:
            raise ValueError(f"query rejected: {commands[0]} is not a read")
        return self.spark.sql(statement)

    def close(self) -> None:
        for name in self._names:
            self.spark.catalog.dropTempView(name)
        self._names.clear()
