"""A query register shared by the plan modules."""

from __future__ import annotations


class Register:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn

        return add
