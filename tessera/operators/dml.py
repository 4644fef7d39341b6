"""Changes to tables as DataFrame rewrites: the result is the table after the statement.

On immutable files a statement is a new version of the data; `tessera.sources.versions` stores one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_select(target: DataFrame, rows: DataFrame, columns: Sequence[str] | None = None, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """INSERT INTO target (columns) SELECT ...: rows matched by position; other columns take their default, else null."""
    columns = list(columns or target.columns)
    named = rows.toDF(*columns)
    full = named.select(*[(F.col(c) if c in columns else (defaults or {}).get(c, F.lit(None))).cast(target.schema[c].dataType.simpleString()).alias(c) for c in target.columns])
    return target.unionByName(full)


def upsert_do_nothing(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT (keys) DO NOTHING. Within rows, the first of a key by all columns is taken."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in rows.columns])
    once = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return target.unionByName(once.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def upsert_do_update(target: DataFrame, rows: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """ON CONFLICT (keys) DO UPDATE SET the columns `update` from the new rows, whose keys must be unique."""
    new = rows.select(*[F.col(c) if c in keys else F.col(c).alias(f"_new_{c}") for c in target.columns], F.lit(True).alias("_hit"))
    both = target.withColumn("_old", F.lit(True)).join(new, list(keys), "full")
    pick = [
        F.col(c) if c in keys else F.when(F.col("_hit") & (F.col("_old").isNull() | F.lit(c in update)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in target.columns
    ]
    return both.select(*pick)


def update(target: DataFrame, assignments: Mapping[str, Column], where: Column) -> DataFrame:
    """UPDATE ... SET ... WHERE: only rows for which the condition is true change."""
    hit = F.coalesce(where, F.lit(False))
    return target.select(*[F.when(hit, assignments[c]).otherwise(F.col(c)).cast(target.schema[c].dataType.simpleString()).alias(c) if c in assignments else F.col(c) for c in target.columns])


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], assignments: Mapping[str, Column]) -> DataFrame:
    """UPDATE ... FROM source: rows that meet a source row (unique keys) take the assignments."""
    other = source.withColumn("_hit", F.lit(True))
    both = target.join(other, list(keys), "left")
    return both.select(*[F.when(F.col("_hit"), assignments[c]).otherwise(target[c]).alias(c) if c in assignments else (F.col(c) if c in keys else target[c]) for c in target.columns])


def delete(target: DataFrame, where: Column) -> DataFrame:
    """DELETE ... WHERE: rows for which the condition is false or null stay."""
    return target.where(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DELETE ... USING source: rows without a partner stay."""
    return target.join(source.select(*keys), list(keys), "left_anti")


def returning(rows: DataFrame, *columns: str) -> DataFrame:
    """RETURNING: all columns (no argument, or *) or expressions of the rows that a statement touched."""
    return rows if not columns or columns == ("*",) else rows.selectExpr(*columns)


def inserted(target: DataFrame, rows: DataFrame, columns: Sequence[str] | None = None, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """What insert_select adds: the new rows as the table holds them."""
    return insert_select(target.limit(0), rows, columns, defaults)


def upserted(target: DataFrame, rows: DataFrame, keys: Sequence[str], update: Sequence[str] | None) -> DataFrame:
    """What an upsert adds or changes, as the table holds it afterwards; update None: DO NOTHING, only what is new."""
    if update is None:
        return upsert_do_nothing(target, rows, keys).join(target.select(*keys), list(keys), "left_anti").select(*target.columns)
    return upsert_do_update(target, rows, keys, update).join(rows.select(*keys).distinct(), list(keys), "left_semi").select(*target.columns)


def updated(target: DataFrame, assignments: Mapping[str, Column], where: Column) -> DataFrame:
    """The rows that update changes, as they are afterwards."""
    return update(target.where(F.coalesce(where, F.lit(False))), assignments, F.lit(True))


def deleted(target: DataFrame, where: Column) -> DataFrame:
    return target.where(F.coalesce(where, F.lit(False)))


def truncate(target: DataFrame) -> DataFrame:
    return target.where(F.lit(False))


def apply_operators(target: DataFrame, changes: Mapping[str, tuple[str, Column]], where: Column) -> DataFrame:
    """Update operators by column: = += -= *= /= append remove (the last two on arrays)."""
    do = {
        "=": lambda c, v: v, "+=": lambda c, v: c + v, "-=": lambda c, v: c - v, "*=": lambda c, v: c * v, "/=": lambda c, v: F.try_divide(c, v),
        "append": F.array_append, "remove": F.array_remove,
    }
    return update(target, {c: do[op](F.col(c), v) for c, (op, v) in changes.items()}, where)


def mvcc_snapshot(versions: DataFrame, keys: Sequence[str], snapshot: int, active: Sequence[int] = (), xmin: str = "xmin", xmax: str = "xmax") -> DataFrame:
    """The newest version of each key that the snapshot sees: begun at or before it by a transaction that isn't active, not ended by one."""
    seen = (F.col(xmin) <= snapshot) & ~F.col(xmin).isin(list(active)) if active else F.col(xmin) <= snapshot
    ended = F.col(xmax).isNotNull() & (F.col(xmax) <= snapshot)
    if active:
        ended = ended & ~F.col(xmax).isin(list(active))
    w = Window.partitionBy(*keys).orderBy(F.col(xmin).desc())
    return versions.where(seen & ~ended).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tier(age_hours: Column, hot_hours: int = 48, warm_days: int = 30) -> Column:
    """hot below 48 hours, warm up to 30 days, cold beyond."""
    return F.when(age_hours < hot_hours, "hot").when(age_hours <= warm_days * 24, "warm").otherwise("cold")


def retain(df: DataFrame, at: Column, keep) -> DataFrame:
    """Rows no older than the newest less `keep` (an interval or a number, as `at`). One pass for the newest, then a filter that can be pushed down."""
    newest = df.agg(F.max(at).alias("_newest"))
    return df.join(F.broadcast(newest)).where(at >= F.col("_newest") - keep).drop("_newest")


def mask_column(df: DataFrame, column: str, how: str = "full") -> DataFrame:
    """Data masking: full (every letter and digit), hash (SHA-256), partial (all but the last four), null."""
    c = F.col(column).cast("string")
    masks = {
        "full": F.mask(c), "hash": F.sha2(c, 256), "null": F.lit(None).cast("string"),
        "partial": F.concat(F.repeat(F.lit("*"), F.greatest(F.length(c) - 4, F.lit(0))), F.right(c, F.least(F.length(c), F.lit(4)))),
    }
    return df.withColumn(column, masks[how])


def row_security(df: DataFrame, policies: Sequence[Column]) -> DataFrame:
    """Row-level security: rows that any policy allows; none if there is no policy."""
    allowed = F.lit(False)
    for p in policies:
        allowed = allowed | F.coalesce(p, F.lit(False))
    return df.where(allowed)
