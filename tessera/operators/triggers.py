"""Triggers on statements over DataFrames: BEFORE or AFTER, for each row or statement, on insert, update, delete, truncate.

A row trigger is an expression over the structs `old` and `new`: BEFORE ones change the new row (or
keep it from being written), AFTER ones give rows for other tables, which fire those tables' triggers
in turn. So any number of rows is one plan. Statement triggers are functions that get the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 16
EVENTS = ("insert", "update", "delete", "truncate")


@dataclass(frozen=True)
class Trigger:
    name: str
    table: str
    event: str
    timing: str = "after"  # before, after
    level: str = "row"  # row, statement
    when: str | None = None  # over old and new; rows for which it isn't true are passed over
    assign: Mapping[str, str] = field(default_factory=dict)  # BEFORE ROW: new columns by expression
    skip: bool = False  # BEFORE ROW: rows that meet `when` aren't written
    into: str | None = None  # AFTER ROW: the table that gets rows
    values: Mapping[str, str] = field(default_factory=dict)  # AFTER ROW: its columns by expression
    action: Callable | None = None  # STATEMENT: called with the database


class Database:
    """Named tables with triggers; a statement replaces its table's DataFrame and those that triggers write to."""

    def __init__(self, tables: Mapping[str, DataFrame], max_depth: int = MAX_DEPTH):
        self.tables, self.triggers, self.max_depth = dict(tables), [], max_depth

    def create(self, trigger: Trigger) -> None:
        if trigger.event not in EVENTS or trigger.timing not in ("before", "after") or trigger.level not in ("row", "statement"):
            raise ValueError(f"not a trigger: {trigger}")
        self.triggers = [t for t in self.triggers if t.name != trigger.name] + [trigger]

    def drop(self, name: str) -> bool:
        before = len(self.triggers)
        self.triggers = [t for t in self.triggers if t.name != name]
        return len(self.triggers) < before

    def _of(self, table: str, event: str, timing: str, level: str) -> list[Trigger]:
        return [t for t in self.triggers if (t.table, t.event, t.timing, t.level) == (table, event, timing, level)]

    def insert(self, table: str, rows: DataFrame, _depth: int = 0) -> None:
        target = self.tables[table]
        new = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(target.schema[c].dataType.simpleString()).alias(c) for c in target.columns])
        pairs = new.select(F.lit(None).cast(target.schema.simpleString()).alias("old"), F.struct(*target.columns).alias("new"))
        self._apply(table, "insert", pairs, lambda changed: target.unionByName(changed.select("new.*")), _depth)

    def update(self, table: str, assignments: Mapping[str, Column], where: Column, _depth: int = 0) -> None:
        target = self.tables[table]
        hit = F.coalesce(where, F.lit(False))
        after = F.struct(*[(assignments[c].cast(target.schema[c].dataType.simpleString()) if c in assignments else F.col(c)).alias(c) for c in target.columns])
        pairs = target.where(hit).select(F.struct(*target.columns).alias("old"), after.alias("new"))
        self._apply(table, "update", pairs, lambda changed: target.where(~hit).unionByName(changed.select("new.*")), _depth, keep_skipped=True)

    def delete(self, table: str, where: Column, _depth: int = 0) -> None:
        target = self.tables[table]
        hit = F.coalesce(where, F.lit(False))
        pairs = target.where(hit).select(F.struct(*target.columns).alias("old"), F.lit(None).cast(target.schema.simpleString()).alias("new"))
        self._apply(table, "delete", pairs, lambda changed: target.where(~hit), _depth, keep_skipped=True)

    def truncate(self, table: str, _depth: int = 0) -> None:
        """Row triggers don't fire."""
        self._statement(table, "truncate", "before")
        self.tables[table] = self.tables[table].limit(0)
        self._statement(table, "truncate", "after")

    def _statement(self, table: str, event: str, timing: str) -> None:
        for t in self._of(table, event, timing, "statement"):
            t.action(self)

    def _apply(self, table: str, event: str, pairs: DataFrame, write: Callable[[DataFrame], DataFrame], depth: int, keep_skipped: bool = False) -> None:
        if depth > self.max_depth:
            raise RecursionError(f"triggers fire each other more than {self.max_depth} deep")
        self._statement(table, event, "before")
        columns = self.tables[table].columns
        skipped = None
        for t in self._of(table, event, "before", "row"):
            met = F.coalesce(F.expr(t.when), F.lit(False)) if t.when else F.lit(True)
            if t.skip:
                gone = pairs.where(met).select("old")
                skipped = gone if skipped is None else skipped.unionByName(gone)
                pairs = pairs.where(~met)
            elif t.assign:
                changed = F.struct(*[(F.when(met, F.expr(t.assign[c])).otherwise(F.col(f"new.{c}")) if c in t.assign else F.col(f"new.{c}")).alias(c) for c in columns])
                pairs = pairs.select("old", F.when(F.col("new").isNotNull(), changed).alias("new"))
        table_after = write(pairs)
        if keep_skipped and skipped is not None:  # what a trigger kept from changing stays as it was
            table_after = table_after.unionByName(skipped.select("old.*"))
        self.tables[table] = table_after
        for t in self._of(table, event, "after", "row"):
            met = F.coalesce(F.expr(t.when), F.lit(False)) if t.when else F.lit(True)
            self.insert(t.into, pairs.where(met).select(*[F.expr(v).alias(c) for c, v in t.values.items()]), depth + 1)
        self._statement(table, event, "after")
