"""A Cypher subset over two DataFrames: nodes (id, labels array<string>, properties...) and edges (src, dst, type, properties...).

MATCH and OPTIONAL MATCH (comma-separated paths, labels, property maps, types with |, both
directions, *min..max), WHERE, WITH, RETURN [DISTINCT], ORDER BY, SKIP, LIMIT, UNWIND, CALL ...
YIELD, and on a Graph: CREATE, MERGE, SET, REMOVE, [DETACH] DELETE. Variables are joined where paths
share them; within one MATCH a relationship is used once. A query becomes one DataFrame plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import spatial_names
from tessera.plans.procedures import call

CLAUSES = ("OPTIONAL MATCH", "MATCH", "WHERE", "WITH", "RETURN", "ORDER BY", "SKIP", "LIMIT", "UNWIND", "CALL", "YIELD", "CREATE", "MERGE", "SET", "REMOVE", "DETACH DELETE", "DELETE")
AGGREGATES = re.compile(r"\b(count|sum|avg|min|max|collect|collect_list|stdev)\s*\(", re.I)
DEFAULT_HOPS = (1, 10)


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts of text at separators outside brackets and quotes."""
    out, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        if c == sep and not depth and not quote:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()] if now.strip() else out


def clauses(text: str, words: tuple[str, ...] = CLAUSES) -> list[tuple[str, str]]:
    """(keyword, body) pairs; keywords in quotes or brackets don't count. STARTS WITH and ENDS WITH aren't clauses."""
    pattern = re.compile("|".join(rf"\b{w.replace(' ', r'\s+')}\b" for w in words), re.I)
    marks, depth, quote, k = [], 0, "", 0
    while k < len(text):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif not depth and (m := pattern.match(text, k)) and (k == 0 or not (text[k - 1].isalnum() or text[k - 1] in "._")) and not re.search(r"\b(STARTS|ENDS)\s+$", text[:k], re.I):
            marks.append((k, m.end(), re.sub(r"\s+", " ", m[0].upper())))
            k = m.end()
            continue
        k += 1
    return [(w, text[b : marks[i + 1][0] if i + 1 < len(marks) else len(text)].strip().rstrip(";")) for i, (_, b, w) in enumerate(marks)]


def expression(text: str) -> str:
    """Cypher's operators and functions as Spark SQL's."""
    text = re.sub(r'"([^"]*)"', lambda m: "'" + m[1].replace("'", "\\'") + "'", text)
    text = spatial_names.cypher(text) if spatial_names.uses(text) else text
    text = re.sub(r"\b(\w+):(\w+)\b(?!')", r"array_contains(\1.labels, '\2')", text)
    text = re.sub(r"=~\s*", "RLIKE ", text)
    text = re.sub(r"([\w.]+)\s+STARTS\s+WITH\s+('[^']*'|[\w.]+)", r"startswith(\1, \2)", text, flags=re.I)
    text = re.sub(r"([\w.]+)\s+ENDS\s+WITH\s+('[^']*'|[\w.]+)", r"endswith(\1, \2)", text, flags=re.I)
    text = re.sub(r"([\w.]+)\s+CONTAINS\s+('[^']*'|[\w.]+)", r"contains(\1, \2)", text, flags=re.I)
    text = re.sub(r"\bIN\s*\[([^\]]*)\]", r"IN (\1)", text, flags=re.I)
    text = re.sub(r"\bexists\s*\(\s*(\w+\.\w+)\s*\)", r"(\1 IS NOT NULL)", text, flags=re.I)
    text = re.sub(r"\b(id|type|labels)\s*\(\s*(\w+)\s*\)", lambda m: f"{m[2]}.{m[1].lower()}", text, flags=re.I)
    text = re.sub(r"\bcollect\s*\(", "collect_list(", text, flags=re.I)
    text = re.sub(r"\bstdev\s*\(", "stddev_samp(", text, flags=re.I)
    text = re.sub(r"\bcount\s*\(\s*(DISTINCT\s+)?(\w+)\s*\)", lambda m: f"count({m[1] or ''}{m[2]})", text, flags=re.I)
    return re.sub(r"\btoLower\b", "lower", re.sub(r"\btoUpper\b", "upper", text))


NODE = re.compile(r"\(\s*(\w*)\s*((?::\w+)*)\s*(\{[^}]*\})?\s*\)")
REL = re.compile(r"(<?)-(?:\[\s*(\w*)\s*(?::([\w|:]+))?\s*(\*[\d.]*)?\s*(\{[^}]*\})?\s*\])?-(>?)")


@dataclass
class Node:
    var: str
    labels: list[str]
    props: dict[str, str]


@dataclass
class Rel:
    var: str
    types: list[str]
    hops: tuple[int, int] | None
    props: dict[str, str]
    direction: str


def _props(text: str | None) -> dict[str, str]:
    return {k.strip(): v.strip() for k, v in (p.split(":", 1) for p in split_top((text or "{}").strip()[1:-1]))}


def parse_path(text: str, fresh: list[int]) -> list:
    """Node, Rel, Node, ...; elements without a name get one."""
    out, k = [], 0
    text = re.sub(r"^\s*\w+\s*=\s*(?=\()", "", text.strip())
    while k < len(text):
        if m := NODE.match(text, k):
            fresh[0] += 1
            out.append(Node(m[1] or f"_n{fresh[0]}", [x for x in m[2].split(":") if x], _props(m[3])))
        elif m := REL.match(text, k):
            fresh[0] += 1
            hops = None
            if m[4]:
                a, dots, b = m[4][1:].partition("..")
                hops = (int(a or 1), int(b or DEFAULT_HOPS[1])) if dots else (int(a), int(a)) if a else DEFAULT_HOPS
            out.append(Rel(m[2] or f"_r{fresh[0]}", [t for t in re.split(r"[|:]+", m[3] or "") if t], hops, _props(m[5]), "in" if m[1] else "out" if m[6] else "both"))
        else:
            raise ValueError(f"can't read the pattern at: {text[k:]}")
        k = m.end()
        k += len(text[k:]) - len(text[k:].lstrip())
    return out


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    _fresh: list[int] = field(default_factory=lambda: [0])

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def _node(self, n: Node) -> DataFrame:
        df = self.nodes
        for label in n.labels:
            df = df.where(F.array_contains("labels", label))
        for k, v in n.props.items():
            df = df.where(F.col(k) == F.expr(expression(v)))
        return df.select(F.struct(*df.columns).alias(n.var))

    def _steps(self, r: Rel) -> DataFrame:
        """(_from, _to, relationship struct, its id) in the pattern's direction."""
        e = self.edges.where(F.col("type").isin(r.types)) if r.types else self.edges
        for k, v in r.props.items():
            e = e.where(F.col(k) == F.expr(expression(v)))
        rel = F.struct(*self.edges.columns)
        e = e.select("src", "dst", rel.alias("_rel"), F.xxhash64(*[F.col(c) for c in self.edges.columns]).alias("_e"))
        out = e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), "_rel", "_e")
        back = e.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), "_rel", "_e")
        return {"out": out, "in": back, "both": out.unionByName(back)}[r.direction]

    def _match(self, bound: DataFrame | None, text: str) -> DataFrame:
        used = "_used"
        rows = bound
        first = True
        for path in split_top(text):
            parts = parse_path(path, self._fresh)
            rows = self._bind(rows, parts[0])
            if first:
                rows = rows.withColumn(used, F.array().cast("array<long>"))
                first = False
            for k in range(1, len(parts), 2):
                rows = self._hop(rows, parts[k - 1], parts[k], parts[k + 1], used)
        return rows.drop(used)

    def _bind(self, rows: DataFrame | None, n: Node) -> DataFrame:
        if rows is None:
            return self._node(n)
        if n.var not in rows.columns:
            return rows.crossJoin(self._node(n))
        for label in n.labels:
            rows = rows.where(F.array_contains(f"{n.var}.labels", label))
        for k, v in n.props.items():
            rows = rows.where(F.col(f"{n.var}.{k}") == F.expr(expression(v)))
        return rows

    def _hop(self, rows: DataFrame, a: Node, r: Rel, b: Node, used: str) -> DataFrame:
        steps = self._steps(r)
        if r.hops is None:
            rows = rows.join(steps, F.col(f"{a.var}.id") == F.col("_from")).where(~F.array_contains(used, F.col("_e")))
            rows = rows.withColumn(used, F.array_append(used, F.col("_e"))).withColumnRenamed("_rel", r.var).drop("_from", "_e")
        else:
            kind = self.edges.schema.simpleString()
            now = rows.withColumn(r.var, F.array().cast(f"array<{kind}>")).withColumn("_to", F.col(f"{a.var}.id"))
            found = now if r.hops[0] == 0 else None
            for h in range(1, r.hops[1] + 1):
                now = now.join(steps.withColumnRenamed("_to", "_next"), F.col("_to") == F.col("_from")).where(~F.array_contains(used, F.col("_e")))
                now = now.withColumn(used, F.array_append(used, F.col("_e"))).withColumn(r.var, F.array_append(r.var, F.col("_rel"))).withColumn("_to", F.col("_next")).drop("_from", "_e", "_rel", "_next")
                if h >= r.hops[0]:
                    found = now if found is None else found.unionByName(now)
            rows = found
        if b.var in rows.columns:
            return self._bind(rows.where(F.col("_to") == F.col(f"{b.var}.id")).drop("_to"), b)
        return rows.join(self._node(b), F.col("_to") == F.col(f"{b.var}.id")).drop("_to")

    def query(self, text: str) -> DataFrame:
        """The rows that the query returns."""
        if spatial_names.uses(text):
            spatial_names.register(self.spark)
        rows: DataFrame | None = None
        for word, body in self._grouped(text):
            if word == "MATCH":
                pattern, where = body
                rows = self._match(rows, pattern)
                rows = rows.where(expression(where)) if where else rows
            elif word == "OPTIONAL MATCH":
                pattern, where = body
                rows = self._optional(rows, pattern, where)
            elif word == "UNWIND":
                value, _, name = re.match(r"(.*?)(\s+AS\s+)(\w+)$", body, re.I | re.S).groups()
                value = re.sub(r"^\[(.*)\]$", r"array(\1)", value.strip())
                base = rows if rows is not None else self.spark.range(1).select()
                rows = base.select("*", F.explode(F.expr(expression(value))).alias(name))
            elif word == "CALL":
                name, args = re.match(r"([\w.]+)\s*(?:\((.*)\))?", body[0], re.S).groups()
                rows = call(name, self.nodes, self.edges, args)
                if body[1]:
                    rows = rows.select(*[F.expr(x) for x in split_top(body[1])])
            elif word in ("WITH", "RETURN"):
                rows = self._project(rows, *body)
            else:
                raise ValueError(f"{word} isn't part of a query; use Graph.execute")
        return rows

    def _grouped(self, text: str) -> list[tuple[str, object]]:
        """Clauses with what belongs to them: a MATCH's WHERE, a projection's ORDER BY, SKIP, LIMIT and WHERE."""
        out: list[list] = []
        for word, body in clauses(text):
            if word in ("MATCH", "OPTIONAL MATCH"):
                out.append([word, [body, ""]])
            elif word in ("WITH", "RETURN"):
                out.append([word, [body, "", None, None, ""]])
            elif word == "CALL":
                out.append([word, [body, ""]])
            elif word == "YIELD":
                out[-1][1][1] = body
            elif word == "WHERE":
                out[-1][1][1 if out[-1][0] not in ("WITH", "RETURN") else 4] = body
            elif word in ("ORDER BY", "SKIP", "LIMIT"):
                out[-1][1][{"ORDER BY": 1, "SKIP": 2, "LIMIT": 3}[word]] = body if word == "ORDER BY" else int(body)
            else:
                out.append([word, body])
        return [(w, tuple(b) if isinstance(b, list) else b) for w, b in out]

    def _optional(self, rows: DataFrame, pattern: str, where: str) -> DataFrame:
        keyed = rows.withColumn("_row", F.xxhash64(*[F.to_json(F.struct(c)) for c in rows.columns]))
        found = self._match(keyed.dropDuplicates(["_row"]), pattern)
        found = found.where(expression(where)) if where else found
        new = [c for c in found.columns if c not in keyed.columns]
        return keyed.join(found.select("_row", *new), "_row", "left").drop("_row")

    def _project(self, rows: DataFrame, items: str, order: str, skip: int | None, limit: int | None, where: str) -> DataFrame:
        distinct = bool(re.match(r"DISTINCT\b", items, re.I))
        items = re.sub(r"^DISTINCT\s+", "", items, flags=re.I)
        cols, grouped = [], []
        for item in split_top(items):
            if item == "*":
                cols += [(c, c) for c in rows.columns]
                continue
            m = re.match(r"(.*?)\s+AS\s+(\w+)$", item, re.I | re.S)
            value, name = (m[1], m[2]) if m else (item, item.strip())
            cols.append((expression(value), name))
        aggregate = any(AGGREGATES.search(v) for v, _ in cols)
        names = [n for _, n in cols]
        if aggregate:
            grouped = [F.expr(v).alias(n) for v, n in cols if not AGGREGATES.search(v)]
            out = rows.groupBy(*grouped).agg(*[F.expr(v).alias(n) for v, n in cols if AGGREGATES.search(v)]).select(*[F.col(f"`{n}`") for n in names])
        else:
            out = rows.select(*[F.expr(v).alias(n) for v, n in cols], *([F.struct(*rows.columns).alias("_all")] if order and not distinct else []))
        out = out.distinct() if distinct else out
        if where:
            out = out.where(expression(where))
        if order:
            keys = []
            for k in split_top(order):
                m = re.match(r"(.*?)(?:\s+(ASC|DESC)(?:ENDING)?)?$", k, re.I | re.S)
                value = m[1].strip()
                by = F.col(f"`{value}`") if value in names else F.expr(re.sub(r"\b([A-Za-z_]\w*)(?=\.)", r"_all.\1", expression(value))) if "_all" in out.columns else F.expr(expression(value))
                keys.append(by.desc_nulls_last() if (m[2] or "").upper() == "DESC" else by.asc_nulls_last())
            out = out.orderBy(*keys)
        out = out.drop("_all")
        out = out.offset(skip) if skip else out
        return out.limit(limit) if limit is not None else out

    def execute(self, text: str) -> Graph:
        """CREATE, MERGE (one node), or MATCH ... SET / REMOVE / DELETE / DETACH DELETE: the graph after it."""
        parts = self._grouped(text)
        nodes, edges = self.nodes, self.edges
        kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
        matched = [p for p in parts if p[0] in ("MATCH", "WITH")]
        rows = self._match(None, matched[0][1][0]) if matched else None
        if rows is not None and matched[0][1][1]:
            rows = rows.where(expression(matched[0][1][1]))
        for word, body in parts:
            if word in ("CREATE", "MERGE"):
                for path in split_top(body):
                    found = parse_path(path, self._fresh)
                    base = rows if rows is not None else self.spark.range(1).select()
                    made = {}
                    for n in found[::2]:
                        if rows is not None and n.var in rows.columns or n.var in made:
                            continue
                        values = {"labels": F.array(*map(F.lit, n.labels)).cast("array<string>")} | {k: F.expr(expression(v)) for k, v in n.props.items()}
                        new = base.select(*[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in kinds])
                        if word == "MERGE":
                            new = new.join(self._node(n).select(*[F.col(f"{n.var}.{k}").alias(k) for k in n.props]), list(n.props), "left_anti").select(*kinds)
                        made[n.var] = values["id"] if "id" in values else None
                        nodes = nodes.unionByName(new)
                    for k in range(1, len(found), 2):
                        a, r, b = found[k - 1], found[k], found[k + 1]
                        if r.direction == "in":
                            a, b = b, a
                        end = lambda n: made[n.var] if n.var in made else F.col(f"{n.var}.id")
                        values = {"src": end(a), "dst": end(b), "type": F.lit(r.types[0])} | {p: F.expr(expression(v)) for p, v in r.props.items()}
                        edges = edges.unionByName(base.select(*[values.get(f.name, F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in edges.schema]))
            elif word == "SET":
                for item in split_top(body):
                    var, key, value = re.match(r"(\w+)\.(\w+)\s*=\s*(.*)$", item, re.S).groups()
                    new = rows.select(F.col(f"{var}.id").alias("id"), F.expr(expression(value)).alias("_v")).groupBy("id").agg(F.max("_v").alias("_v"), F.lit(True).alias("_hit"))
                    if key not in nodes.columns:
                        nodes = nodes.withColumn(key, F.lit(None).cast(new.schema["_v"].dataType))
                    nodes = nodes.join(new, "id", "left").select(*[F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(c)).alias(c) if c == key else F.col(c) for c in nodes.columns])
            elif word == "REMOVE":
                for item in split_top(body):
                    var, key = re.match(r"(\w+)\.(\w+)$", item).groups()
                    hit = rows.select(F.col(f"{var}.id").alias("id"), F.lit(True).alias("_hit")).distinct()
                    nodes = nodes.join(hit, "id", "left").select(*[F.when(F.col("_hit"), None).otherwise(F.col(c)).alias(c) if c == key else F.col(c) for c in nodes.columns])
            elif word in ("DELETE", "DETACH DELETE"):
                for var in split_top(body):
                    if "src" in rows.select(f"{var}.*").columns:
                        gone = rows.select(f"{var}.*").distinct()
                        edges = edges.join(gone, list(edges.columns), "left_anti")
                        continue
                    ids = rows.select(F.col(f"{var}.id").alias("_id")).distinct()
                    hang = edges.join(ids, (F.col("src") == F.col("_id")) | (F.col("dst") == F.col("_id")), "left_semi") if word == "DELETE" else None
                    if hang is not None and not hang.isEmpty():
                        raise ValueError("a node that has relationships needs DETACH DELETE")
                    edges = edges.join(ids.withColumnRenamed("_id", "src"), "src", "left_anti").join(ids.withColumnRenamed("_id", "dst"), "dst", "left_anti").select(*edges.columns)
                    nodes = nodes.join(ids.withColumnRenamed("_id", "id"), "id", "left_anti").select(*nodes.columns)
        return Graph(nodes, edges)
