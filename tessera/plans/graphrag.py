"""Knowledge bases by name, and the GRAPHRAG_* functions over them: build, query, extract, reason, stats, entities, similar.

    SELECT * FROM GRAPHRAG_BUILD('kb', 'doc 1', 'Ada works for Acme')
    SELECT * FROM GRAPHRAG_REASON('kb', 'Ada', 'Acme', 3)

Documents can be added in bulk (`add`); entities, nodes and edges follow from all of them when they
are asked for, and are written once for each state of the documents.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import knowledge, text
from tessera.sources.rounds import drop_round, keep_round

#: Words that begin with a capital, and numbers, unless a base is given patterns of its own.
PATTERNS = {"name": r"\b\p{Lu}\p{L}+\b", "number": r"\b[0-9]{2,}\b"}
CALL = re.compile(r"\bGRAPHRAG_(\w+)\s*\((.*)\)\s*$", re.I | re.S)


class KnowledgeBases:
    def __init__(self, spark: SparkSession, patterns: Mapping[str, str] | None = None, keywords: DataFrame | None = None):
        self.spark, self.patterns, self.keywords = spark, dict(patterns or PATTERNS), keywords
        self.docs: dict[str, DataFrame] = {}
        self._built: dict[str, tuple[DataFrame, DataFrame, DataFrame]] = {}
        self._asked: dict[str, int] = {}

    def add(self, name: str, docs: DataFrame) -> None:
        """Documents (doc_id, text) in bulk."""
        rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        self.docs[name] = rows if name not in self.docs else self.docs[name].unionByName(rows)
        if name in self._built:
            drop_round(*self._built.pop(name))

    def parts(self, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Entities, nodes and edges of a base."""
        if name not in self.docs:
            raise ValueError(f"no knowledge base {name}")
        if name not in self._built:
            found = knowledge.build_knowledge(self.docs[name], "doc_id", "text", self.patterns, self.keywords)
            self._built[name] = tuple(keep_round(df, part) for df, part in zip(found, ("entities", "nodes", "edges")))
        return self._built[name]

    def build(self, name: str, doc_id: str, body: str) -> DataFrame:
        """Add one document: (doc_id, entities, relationships) found in it."""
        one = self.spark.createDataFrame([(doc_id, body)], "doc_id string, text string")
        self.add(name, one)
        found, _, edges = knowledge.build_knowledge(one, "doc_id", "text", self.patterns, self.keywords)
        n = found.select("entity").distinct().agg(F.count(F.lit(1)).alias("entities"))
        return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("relationships"))).select(F.lit(doc_id).alias("doc_id"), "entities", "relationships")

    def query(self, name: str, question: str, max_hops: str = "2", limit: str = "10", *_: str) -> DataFrame:
        """Documents for a question, best first."""
        self._asked[name] = self._asked.get(name, 0) + 1
        words = re.findall(r"\w+", question)
        return knowledge.rag_query(*self.parts(name), "doc_id", words, int(max_hops), int(limit))

    def extract(self, name: str, doc_id: str, body: str, *_: str) -> DataFrame:
        """Entities of a text that isn't added."""
        one = self.spark.createDataFrame([(doc_id, body)], "doc_id string, text string")
        return knowledge.build_knowledge(one, "doc_id", "text", self.patterns, self.keywords)[0].drop("entity")

    def relations(self, name: str) -> DataFrame:
        """Relations that the basic rules find in the base's documents."""
        return text.extract_relations(self.docs[name], "doc_id", "text")

    def reason(self, name: str, source: str, target: str, max_hops: str = "3", *_: str) -> DataFrame:
        """The best paths between two entities."""
        _, nodes, edges = self.parts(name)
        names = nodes.select(F.col("id").alias("_id"), F.col("text").alias("_text"))
        paths = knowledge.find_paths(nodes, edges, source, target, int(max_hops)).select("path", "hops", "confidence", "score")
        steps = paths.select("*", F.posexplode("path").alias("_k", "_id")).join(names, "_id")
        words = F.transform(F.sort_array(F.collect_list(F.struct("_k", "_text"))), lambda x: x["_text"])
        return steps.groupBy("path", "hops", "confidence", "score").agg(words.alias("entities")).drop("path").orderBy(F.desc("score"), "entities")

    def stats(self, name: str) -> DataFrame:
        """(documents, entities, types, relationships, queries)."""
        _, nodes, edges = self.parts(name)
        n = self.docs[name].agg(F.count_distinct("doc_id").alias("documents"))
        return n.crossJoin(knowledge.stats(nodes, edges)).withColumn("queries", F.lit(self._asked.get(name, 0)))

    def entities(self, name: str, kind: str | None = None, limit: str = "100") -> DataFrame:
        return knowledge.list_entities(self.parts(name)[1], kind or None, int(limit)).select("text", "type", "confidence", "documents")

    def similar(self, name: str, entity: str, limit: str = "10", least: str = "0") -> DataFrame:
        _, nodes, edges = self.parts(name)
        return knowledge.find_similar(nodes, edges, entity, int(limit)).where(F.col("score") >= float(least)).select("text", "score")

    def call(self, function: str, arguments: str) -> DataFrame:
        """GRAPHRAG_<function>(arguments), the arguments as SQL literals."""
        from tessera.plans.cypher import split_top

        f = {k: getattr(self, k) for k in ("build", "query", "extract", "relations", "reason", "stats", "entities", "similar")}.get(function.lower())
        if f is None:
            raise ValueError(f"no function GRAPHRAG_{function}")
        given = [a.strip() for a in split_top(arguments)]
        return f(*[a[1:-1].replace("''", "'") if a[:1] in "'\"" else None if a.upper() == "NULL" else a for a in given])

    def execute(self, sql: str) -> DataFrame:
        """SELECT * FROM GRAPHRAG_...(...)."""
        m = re.match(r"\s*SELECT\s+\*\s+FROM\s+(.*)$", sql.strip().rstrip(";"), re.I | re.S)
        c = CALL.match(m[1].strip()) if m else None
        if c is None:
            raise ValueError("not a GRAPHRAG query")
        return self.call(c[1], c[2])
