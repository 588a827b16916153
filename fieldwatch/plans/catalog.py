"""Registry of queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations


class Catalog:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def query(self, sql: str | None = None, name: str | None = None):
        def add(fn):
            key = name or fn.__name__
            assert key not in self.queries, key
            self.queries[key] = fn
            if sql is not None:
                self.sql[key] = sql
            return fn

        return add
