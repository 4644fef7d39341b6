"""An AQL subset over named DataFrames: nested FOR, FILTER, LET, COLLECT ... INTO / WITH COUNT INTO / AGGREGATE, SORT, LIMIT, RETURN [DISTINCT], traversals.

    FOR u IN users FILTER u.age > 30 SORT u.name LIMIT 10 RETURN {name: u.name, age: u.age}
    FOR v, e IN 1..3 OUTBOUND 17 edges RETURN v

A loop variable is a struct column, so later clauses see every earlier variable.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import spatial
from tessera.plans import spatial_names
from tessera.plans.cypher import clauses, split_top
from tessera.plans.graphrag import CALL, KnowledgeBases

WORDS = ("FOR", "FILTER", "LET", "COLLECT", "SORT", "LIMIT", "RETURN")


def expression(text: str) -> str:
    """AQL's operators, functions and object literals as Spark SQL's."""
    text = re.sub(r'"([^"]*)"', lambda m: "'" + m[1].replace("'", "\\'") + "'", text.strip())
    text = spatial_names.aql(text) if spatial_names.uses(text) else text
    if text.startswith("{") and text.endswith("}"):
        parts = [p.split(":", 1) if ":" in p else (p, p) for p in split_top(text[1:-1])]
        return "named_struct(" + ", ".join(f"'{k.strip().strip(chr(39))}', {expression(v)}" for k, v in parts) + ")"
    text = text.replace("==", "=").replace("&&", " AND ").replace("||", " OR ")
    text = re.sub(r"!(?!=)", " NOT ", text)
    text = re.sub(r"\bIN\s*\[([^\]]*)\]", r"IN (\1)", text, flags=re.I)
    text = re.sub(r"\[([^\]]*)\]", r"array(\1)", text)
    names = {"LENGTH": "length", "COUNT_DISTINCT": "count_distinct", "UNIQUE": "array_distinct", "AVERAGE": "avg", "TO_NUMBER": "double", "TO_STRING": "string", "APPEND": "concat", "CONTAINS": "contains"}
    return re.sub(r"\b([A-Z_]+)\s*\(", lambda m: names.get(m[1], m[1].lower()) + "(", text)


def run(spark: SparkSession, text: str, collections: Mapping[str, DataFrame], knowledge: KnowledgeBases | None = None) -> DataFrame:
    """The rows that the query returns. GRAPHRAG_*(...) stands for a collection where knowledge bases are given."""
    if knowledge is not None:
        collections = _Knowing(collections, knowledge)
    rows: DataFrame | None = None
    if spatial_names.uses(text):
        spatial_names.register(spark)
    parts = clauses(text, WORDS)
    for k, (word, body) in enumerate(parts):
        if word == "FOR":
            following = parts[k + 1][1] if k + 1 < len(parts) and parts[k + 1][0] == "FILTER" else ""
            rows = _for(spark, rows, body, collections, following)
        elif word == "FILTER":
            rows = rows.where(expression(body))
        elif word == "LET":
            name, value = body.split("=", 1)
            base = rows if rows is not None else spark.range(1).select()
            rows = base.withColumn(name.strip(), F.expr(expression(value)))
        elif word == "COLLECT":
            rows = _collect(rows, body)
        elif word == "SORT":
            keys = []
            for k in split_top(body):
                m = re.match(r"(.*?)(?:\s+(ASC|DESC))?$", k.strip(), re.I | re.S)
                by = F.expr(expression(m[1]))
                keys.append(by.desc_nulls_last() if (m[2] or "").upper() == "DESC" else by.asc_nulls_first())
            rows = rows.orderBy(*keys)
        elif word == "LIMIT":
            parts = [int(x) for x in split_top(body)]
            rows = rows.offset(parts[0]).limit(parts[1]) if len(parts) == 2 else rows.limit(parts[0])
        elif word == "RETURN":
            distinct = bool(re.match(r"DISTINCT\b", body, re.I))
            body = re.sub(r"^DISTINCT\s+", "", body, flags=re.I).strip()
            base = rows if rows is not None else spark.range(1).select()
            out = base.select(F.expr(expression(body)).alias("value"))
            if out.schema["value"].dataType.typeName() == "struct":
                out = out.select("value.*")
            rows = out.distinct() if distinct else out
    return rows


class _Knowing(dict):
    """Collections, and GRAPHRAG_* calls as such."""

    def __init__(self, collections: Mapping[str, DataFrame], knowledge: KnowledgeBases):
        super().__init__(collections)
        self.knowledge = knowledge

    def __contains__(self, name: object) -> bool:
        return super().__contains__(name) or bool(CALL.match(str(name)))

    def __missing__(self, name: str) -> DataFrame:
        return self.knowledge.call(*CALL.match(name).groups())


def _equalities(var: str, known: list[str], condition: str) -> list[tuple[str, str]]:
    """(expression over known variables, expression over var) of the equalities that a condition's AND parts name between them."""
    out = []
    for part in re.split(r"\s+AND\s+|&&", condition, flags=re.I) if not re.search(r"\bOR\b|\|\|", condition, re.I) else []:
        sides = re.match(r"\s*([\w.]+)\s*==\s*([\w.]+)\s*$", part)
        if not sides:
            continue
        for a, b in (sides.groups(), sides.groups()[::-1]):
            if b.split(".")[0] == var and a.split(".")[0] in known and a.split(".")[0] != var:
                out.append((a, b))
                break
    return out


def _combined(rows: DataFrame, one: DataFrame, var: str, condition: str) -> DataFrame:
    """Earlier rows with a loop's: joined by the equalities of the filter that follows; a product only where it names none."""
    pairs = _equalities(var, rows.columns, condition)
    if not pairs:
        return rows.crossJoin(one)
    same = None
    for a, b in pairs:
        now = F.expr(expression(a)) == F.expr(expression(b))
        same = now if same is None else same & now
    return rows.join(one, same)


def _for(spark: SparkSession, rows: DataFrame | None, body: str, collections: Mapping[str, DataFrame], condition: str = "") -> DataFrame:
    if m := re.match(r"(\w+)(?:\s*,\s*(\w+))?\s+IN\s+(\d+)\.\.(\d+)\s+(OUTBOUND|INBOUND|ANY)\s+(\S+)\s+(\w+)$", body, re.I):
        from tessera.operators import graph

        var, edge_var, least, most, direction, start, name = m.groups()
        edges = collections[name]
        kind = edges.schema["src"].dataType
        s = spark.range(1).select(F.lit(start.strip("'\"")).cast(kind).alias("id"))
        turned = edges if direction.upper() != "INBOUND" else edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
        found = graph.variable_length(s, turned, int(least), int(most), "both" if direction.upper() == "ANY" else "out")
        step = F.struct(F.col("end").alias("id"), F.col("hops").alias("depth")).alias(var)
        out = found.select(step, *([F.struct("start", "end").alias(edge_var)] if edge_var else []))
        return out if rows is None else rows.crossJoin(out)
    var, source = re.match(r"(\w+)\s+IN\s+(.+)$", body, re.I | re.S).groups()
    source = source.strip()
    if m := re.match(r"(NEAR|WITHIN|WITHIN_RECTANGLE)\s*\((.*)\)$", source, re.I | re.S):
        near = _near(m[1].upper(), [a.strip() for a in split_top(m[2])], collections)
        one = near.select(F.struct(*near.columns).alias(var))
        return one if rows is None else _combined(rows, one, var, condition)
    if source in collections:
        df = collections[source]
        one = df.select(F.struct(*df.columns).alias(var))
        return one if rows is None else _combined(rows, one, var, condition)
    base = rows if rows is not None else spark.range(1).select()
    if m := re.match(r"(\d+)\.\.(\d+)$", source):
        return base.select("*", F.explode(F.sequence(F.lit(int(m[1])), F.lit(int(m[2])))).alias(var))
    return base.select("*", F.explode(F.expr(expression(source))).alias(var))


def _near(how: str, args: list[str], collections: Mapping[str, DataFrame]) -> DataFrame:
    """NEAR(c, latitude, longitude, limit), WITHIN(c, latitude, longitude, metres), WITHIN_RECTANGLE(c, lat1, lon1, lat2, lon2): rows of c, which has latitude and longitude."""
    df, numbers = collections[args[0]], [float(a) for a in args[1:5]]
    lat, lon = F.col("latitude"), F.col("longitude")
    if how == "WITHIN_RECTANGLE":
        (a, b), (c, d) = sorted(numbers[::2]), sorted(numbers[1::2])
        return df.where(lat.between(a, b) & lon.between(c, d))
    far = df.withColumn("distance", spatial.haversine(lon, lat, F.lit(numbers[1]), F.lit(numbers[0])))
    return far.orderBy("distance", *df.columns).limit(int(numbers[2]) if len(numbers) > 2 else 100) if how == "NEAR" else far.where(F.col("distance") <= numbers[2])


def _collect(rows: DataFrame, body: str) -> DataFrame:
    count = re.search(r"\bWITH\s+COUNT\s+INTO\s+(\w+)", body, re.I)
    into = re.search(r"(?<!COUNT )\bINTO\s+(\w+)\s*$", body, re.I) if not count else None
    aggregate = re.search(r"\bAGGREGATE\s+(.*?)(?=\bINTO\b|\bWITH\b|$)", body, re.I | re.S)
    keys = re.split(r"\bWITH\s+COUNT\b|\bINTO\b|\bAGGREGATE\b", body, flags=re.I)[0].strip()
    groups = [F.expr(expression(v)).alias(k.strip()) for k, v in (p.split("=", 1) for p in split_top(keys))] if keys else []
    aggs = []
    if aggregate:
        aggs += [F.expr(expression(v)).alias(k.strip()) for k, v in (p.split("=", 1) for p in split_top(aggregate[1]))]
    if count:
        aggs.append(F.count(F.lit(1)).alias(count[1]))
    if into:
        aggs.append(F.collect_list(F.struct(*rows.columns)).alias(into[1]))
    return rows.groupBy(*groups).agg(*aggs) if aggs else rows.select(*groups).distinct()
