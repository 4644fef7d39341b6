"""Procedures that queries can CALL, and stored procedures in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry, spatial
from tessera.operators import graph


def _options(args: str | None) -> dict[str, str]:
    return {k: v.strip("'\"") for k, v in re.findall(r"(\w+)\s*:\s*('[^']*'|\"[^\"]*\"|[\w.+-]+)", args or "")}


def _start(nodes: DataFrame, o: dict[str, str]) -> DataFrame:
    return nodes.where(F.col("id") == F.lit(o["start"]).cast(nodes.schema["id"].dataType)).select("id")


def _places(nodes: DataFrame, o: dict[str, str]) -> DataFrame:
    """Nodes with x and y, and their distance from (x, y): on the sphere if given by longitude and latitude."""
    if "longitude" in o:
        return nodes.withColumn("distance", spatial.haversine(F.col("x"), F.col("y"), F.lit(float(o["longitude"])), F.lit(float(o["latitude"]))))
    return nodes.withColumn("distance", spatial.distance(F.col("x"), F.col("y"), F.lit(float(o["x"])), F.lit(float(o["y"]))))


def _meeting(nodes: DataFrame, o: dict[str, str]) -> DataFrame:
    own, other = geometry.from_wkt(F.col(o.get("property", "geometry"))), geometry.from_wkt(F.lit(o["geometry"]))
    return nodes.where(geometry.boxes_meet(own, other)).where(geometry.relates(own, other, "intersects"))


PROCEDURES: dict[str, Callable[[DataFrame, DataFrame, dict[str, str]], DataFrame]] = {
    "graph.pagerank": lambda n, e, o: graph.pagerank(n, e, float(o.get("damping", 0.85)), int(o.get("iterations", 20)), float(o.get("tolerance", 1e-4))),
    "graph.shortestpath": lambda n, e, o: graph.shortest_path(int(o["start"]), e, o.get("weight")),
    "graph.bfs": lambda n, e, o: graph.bfs(_start(n, o), e, int(o.get("maxDepth", 5))),
    "graph.components": lambda n, e, o: graph.connected_components(n, e),
    "graph.communitydetection": lambda n, e, o: graph.communities(n, e, int(o.get("minSize", 2))),
    "graph.betweennesscentrality": lambda n, e, o: graph.betweenness(n, e),
    "graph.closenesscentrality": lambda n, e, o: graph.closeness(n, e),
    "graph.degreecentrality": lambda n, e, o: graph.degrees(n, e),
    "graph.trianglecount": lambda n, e, o: graph.triangles(n, e),
    "spatial.closest": lambda n, e, o: _places(n, o).orderBy("distance", "id").limit(int(o.get("limit", 1))),
    "spatial.withindistance": lambda n, e, o: _places(n, o).where(F.col("distance") <= float(o["distance"])),
    "spatial.intersects": lambda n, e, o: _meeting(n, o),
}


def call(name: str, nodes: DataFrame, edges: DataFrame, args: str | None = None) -> DataFrame:
    """CALL name({key: value, ...})."""
    try:
        f = PROCEDURES[name.lower()]
    except KeyError:
        raise ValueError(f"no procedure {name}; there are {', '.join(sorted(PROCEDURES))}") from None
    return f(nodes, edges, _options(args))


class ProcedureCatalog:
    """Stored procedures: SQL scripts (DECLARE, SET, IF, WHILE, LOOP ... in BEGIN ... END) with named parameters."""

    def __init__(self, spark: SparkSession):
        self.spark, self._all = spark, {}

    def register(self, name: str, parameters: list[str], script: str) -> None:
        self._all[name] = (list(parameters), script)

    def get(self, name: str) -> tuple[list[str], str]:
        return self._all[name]

    def drop(self, name: str) -> bool:
        return self._all.pop(name, None) is not None

    def list(self) -> list[str]:
        return sorted(self._all)

    def call(self, name: str, **arguments) -> DataFrame:
        """Run the script; its last statement's rows are the result."""
        parameters, script = self._all[name]
        if set(arguments) != set(parameters):
            raise ValueError(f"{name} takes {', '.join(parameters)}")
        return self.spark.sql(script, args=arguments)
