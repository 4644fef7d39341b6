"""A CQL subset: SELECT with CONTAINS, CONTAINS KEY, IN, ALLOW FILTERING; INSERT, UPDATE, DELETE, TRUNCATE, BATCH, CREATE, ALTER and DROP TABLE on named DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dml
from tessera.plans.cypher import split_top


def condition(text: str) -> str:
    text = re.sub(r"(\w+)\s+CONTAINS\s+KEY\s+('[^']*'|\S+)", r"map_contains_key(\1, \2)", text, flags=re.I)
    text = re.sub(r"(\w+)\s+CONTAINS\s+('[^']*'|\S+)", r"array_contains(\1, \2)", text, flags=re.I)
    return text.replace("!=", "<>")


# fixed values: types by name
TYPES = {
    "ascii": "string", "text": "string", "varchar": "string", "uuid": "string", "timeuuid": "string", "inet": "string", "int": "int", "bigint": "bigint", "counter": "bigint", "varint": "decimal(38,0)",
    "smallint": "smallint", "tinyint": "tinyint", "float": "float", "double": "double", "decimal": "decimal(38,10)", "boolean": "boolean", "blob": "binary", "date": "date", "timestamp": "timestamp",
}


def spark_type(text: str) -> str:
    """Spark's type of a CQL type: names above, list, set, map, frozen."""
    text = text.strip().lower()
    if m := re.match(r"(list|set|frozen|map)\s*<(.*)>$", text, re.S):
        inner, depth, parts = "", 0, []
        for c in m[2] + ",":
            depth += {"<": 1, ">": -1}.get(c, 0)
            if c == "," and not depth:
                parts.append(inner)
                inner = ""
            else:
                inner += c
        kinds = [spark_type(p) for p in parts]
        return {"list": "array<{0}>", "set": "array<{0}>", "frozen": "{0}", "map": "map<{0},{1}>"}[m[1]].format(*kinds)
    if text not in TYPES:
        raise ValueError(f"no type {text}")
    return TYPES[text]


class Keyspace:
    """Tables by name; keys are the primary keys that INSERT overwrites by, as CQL's does."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None):
        self.spark, self.tables, self.keys = spark, dict(tables), keys or {}

    def execute(self, text: str) -> DataFrame | None:
        text = text.strip().rstrip(";").strip()
        if m := re.match(r"BEGIN\s+(?:UNLOGGED\s+)?BATCH\s+(.*?)\s*APPLY\s+BATCH$", text, re.I | re.S):
            for part in filter(None, (p.strip() for p in split_top(m[1], ";"))):
                self.execute(part)
            return None
        if re.match(r"SELECT\b", text, re.I):
            return self._select(text)
        if m := re.match(r"INSERT\s+INTO\s+(\w+)\s*\(([^)]*)\)\s*VALUES\s*\((.*)\)(\s+IF\s+NOT\s+EXISTS)?$", text, re.I | re.S):
            table, columns, values, once = m.groups()
            columns, target = [c.strip() for c in columns.split(",")], self.tables[table]
            row = self.spark.range(1).select(*[F.expr(v).alias(c) for c, v in zip(columns, split_top(values))])
            full = row.select(*[(F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema])
            keys = self.keys.get(table)
            if not keys:
                self.tables[table] = target.unionByName(full)
            elif once:
                self.tables[table] = dml.upsert_do_nothing(target, full, keys)
            else:
                self.tables[table] = dml.upsert_do_update(target, full, keys, [c for c in columns if c not in keys])
            return None
        if m := re.match(r"UPDATE\s+(\w+)\s+SET\s+(.*?)\s+WHERE\s+(.*)$", text, re.I | re.S):
            sets = dict(re.match(r"(\w+)\s*=\s*(.*)$", p, re.S).groups() for p in split_top(m[2]))
            self.tables[m[1]] = dml.update(self.tables[m[1]], {k: F.expr(v) for k, v in sets.items()}, F.expr(condition(m[3])))
            return None
        if m := re.match(r"DELETE\s+FROM\s+(\w+)\s+WHERE\s+(.*)$", text, re.I | re.S):
            self.tables[m[1]] = dml.delete(self.tables[m[1]], F.expr(condition(m[2])))
            return None
        if m := re.match(r"TRUNCATE\s+(?:TABLE\s+)?(\w+)$", text, re.I):
            self.tables[m[1]] = dml.truncate(self.tables[m[1]])
            return None
        if m := re.match(r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(?:\w+\.)?(\w+)\s*\((.*)\)(?:\s+WITH\s+.*)?$", text, re.I | re.S):
            return self._create(m[2], m[3], bool(m[1]))
        if m := re.match(r"ALTER\s+TABLE\s+(\w+)\s+ADD\s+(\w+)\s+(.+)$", text, re.I):
            self.tables[m[1]] = self.tables[m[1]].withColumn(m[2], F.lit(None).cast(spark_type(m[3])))
            return None
        if m := re.match(r"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?(\w+)$", text, re.I):
            if m[2] not in self.tables and not m[1]:
                raise ValueError(f"no table {m[2]}")
            self.tables.pop(m[2], None)
            return None
        if re.match(r"(?:CREATE|DROP|ALTER)\s+KEYSPACE\b|USE\s+\w+$", text, re.I):
            return None  # a keyspace is this object
        raise ValueError(f"not understood: {text[:60]}")

    def _create(self, name: str, columns: str, once: bool) -> None:
        if name in self.tables:
            if once:
                return
            raise ValueError(f"table {name} exists")
        fields, keys = [], []
        for part in split_top(columns):
            if m := re.match(r"PRIMARY\s+KEY\s*\((.*)\)$", part, re.I | re.S):
                keys = re.findall(r"\w+", m[1])
                continue
            column, kind = re.match(r"(\w+)\s+(.+)$", part, re.S).groups()
            if re.search(r"\s+PRIMARY\s+KEY$", kind, re.I):
                keys, kind = [column], re.sub(r"\s+PRIMARY\s+KEY$", "", kind, flags=re.I)
            fields.append(f"{column} {spark_type(kind)}")
        self.tables[name] = self.spark.createDataFrame([], ", ".join(fields))
        self.keys[name] = keys

    def _select(self, text: str) -> DataFrame:
        text = re.sub(r"\s+ALLOW\s+FILTERING\b", "", text, flags=re.I)
        m = re.match(r"SELECT\s+(.*?)\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*?))?(\s+(?:GROUP\s+BY|ORDER\s+BY|LIMIT)\s+.*)?$", text, re.I | re.S)
        items, table, where, rest = m.groups()
        return self.spark.sql(f"SELECT {items} FROM {{t}}" + (f" WHERE {condition(where)}" if where else "") + (rest or ""), t=self.tables[table])
