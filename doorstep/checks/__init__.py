"""Every operator as a query over the given tables, next to the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = (
    "bands", "identity", "qualification", "scoring", "observations", "web", "planning",
    "governance", "sheet", "payloads", "movement", "streams",
)


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


CHECKS: dict[str, Check] = {}


def check(name: str, covers: str, sql: str | None = None):
    """Register `fn(domain) -> DataFrame` under `name`; `covers` names inventory rows."""
    from doorstep.checks.domain import Domain

    def register(fn):
        if name in CHECKS:
            raise ValueError(f"two checks named {name}")
        CHECKS[name] = Check(
            run=lambda spark, folder: fn(Domain(spark, folder)),
            sql=sql,
            covers=tuple(covers.split()),
        )
        return fn

    return register


def load_all() -> dict[str, Check]:
    for family in FAMILIES:
        import_module(f"doorstep.checks.{family}")
    return CHECKS
