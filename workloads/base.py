"""Registry of the queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def digest(ids: Column | str) -> Column:
    """One value that stands for a whole token array."""
    return F.md5(F.array_join(ids, " "))


def big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


# SQL fragments. `k` is the text of the row key.
def sql_word(text: str, start: int = 1) -> str:
    return f"('0x' || substr(md5({text}), {start}, 8))::BIGINT"


def sql_shard(n: int, key: str = "doc_id") -> str:
    return f"({sql_word(f'concat(42, {chr(39)}:shard:{chr(39)}, {key})')} % {n})"


def sql_order(key: str = "doc_id") -> str:
    return f"md5(concat('42:', {key}))"


def sql_points(text: str = "text") -> str:
    return f"list_transform(string_split({text}, ''), lambda c: unicode(c) + 4)"


def sql_digest(ids: str) -> str:
    return f"md5(array_to_string({ids}, ' '))"


def sql_words(text: str = "text") -> str:
    return f"list_filter(regexp_split_to_array({text}, '[ \\t\\r\\n]+'), lambda w: w <> '')"
