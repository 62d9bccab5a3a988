"""All registered queries and their SQL checks."""

from __future__ import annotations

from scenequarry.plans import evaluation, imagery, pixels, streams, workspace

MODULES = [evaluation, workspace, imagery, pixels, streams]


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
