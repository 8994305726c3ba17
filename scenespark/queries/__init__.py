"""Named queries: each applies an operator to the proxy scene tables, beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from scenespark.proxy import sql, views


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, uses: str, run: Callable[..., DataFrame], oracle: str | None = None) -> None:
        """run gets the views named in uses; oracle is SQL over the same views."""
        names = tuple(uses.split())
        self.queries[name] = lambda spark, sf_dir: run(*views(spark, sf_dir, *names))
        if oracle is not None:
            own = tuple(n for n in names if n.startswith("sc_"))
            self.oracles[name] = sql(oracle, *own) if own else oracle
