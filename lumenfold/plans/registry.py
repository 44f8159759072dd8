"""How a module of queries registers them."""

from __future__ import annotations

from ..sources.tables import table


def registrar(queries: dict, oracles: dict):
    """A decorator that registers a function (a reader of tables) -> DataFrame under its name, with its SQL."""

    def query(sql: str | None):
        def put(f):
            queries[f.__name__] = lambda spark, sf: f(lambda name: table(spark, sf, name))
            if sql:
                oracles[f.__name__] = sql
            return f

        return put

    return query
