"""Questions: a keyword classifier, a planner, and a facade that answers with DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import fenced, quoted_hint
from kgloom.operators import catalogs, graph, store

from . import render


def archetype(question: Column) -> Column:
    """STRUCTURAL unless a more special archetype's words occur."""
    q, out = F.lower(question), F.lit("STRUCTURAL")
    for name, _, words in reversed(catalogs.QUESTION_WORDS):
        out = F.when(_any(q, words), name).otherwise(out)
    return out


def confidence(question: Column) -> Column:
    q, out = F.lower(question), F.lit(0.6)
    for _, value, words in reversed(catalogs.QUESTION_WORDS):
        out = F.when(_any(q, words), value).otherwise(out)
    return out


def _any(q: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | q.contains(w)
    return out


def plan_questions(df: DataFrame, default_depth: int = 2) -> DataFrame:
    """archetype, confidence, action, entity, depth, error for each row's question (and namespace)."""
    kind, entity = archetype(F.col("question")), F.coalesce(F.nullif(F.col("entity_name"), F.lit("")), quoted_hint(F.col("question")))
    out = df.withColumns({"archetype": kind, "confidence": confidence(F.col("question")), "entity": entity})
    namespace = F.coalesce(F.col("namespace"), F.lit(""))
    needs = F.col("archetype").isin("IMPACT", "STRUCTURAL", "RUNTIME")
    error = F.when(needs & F.col("entity").isNull(), "entity needed").when((F.col("archetype") == "GOVERNANCE") & (namespace == ""),
        "namespace needed")
    action = F.when(F.col("archetype") == "IMPACT", "IMPACT_ANALYSIS").when(F.col("archetype") == "GOVERNANCE", "HEALTH_AUDIT").when(
        F.col("archetype") == "TEMPORAL", "READ_LOG").otherwise("FETCH_NEIGHBORHOOD")
    depth = F.when(F.col("archetype") == "IMPACT", F.greatest(F.lit(default_depth), F.lit(5))).when(
        F.col("archetype").isin("STRUCTURAL", "RUNTIME"), default_depth)
    return out.withColumn("error", error).withColumn("action", F.when(F.col("error").isNull(), action)).withColumn("depth",
        F.when(F.col("error").isNull(), depth))


@dataclass
class Plan:
    archetype: str
    action: str
    entity: str | None
    depth: int | None


class Engine:
    """A graph's tables and the questions that they answer. Results of ``neighborhood`` and ``relevance`` are kept until a table is
    replaced (``update``)."""

    def __init__(self, entities: DataFrame, edges: DataFrame, accesses: DataFrame, log: DataFrame,
        llm: Callable[[str, str], str] | None = None):
        self.entities, self.edges, self.accesses, self.log, self.llm = entities, edges, accesses, log, llm
        self.spark = entities.sparkSession
        self._kept: dict[tuple, object] = {}

    def update(self, **tables: DataFrame) -> None:
        """New versions of entities, edges, accesses or log; what was kept for the old ones goes."""
        for name, df in tables.items():
            if name not in ("entities", "edges", "accesses", "log"):
                raise AttributeError(name)
            setattr(self, name, df)
        self._kept.clear()

    def _once(self, key: tuple, make):
        if key not in self._kept:
            if len(self._kept) >= 100:
                del self._kept[next(iter(self._kept))]
            self._kept[key] = make()
        return self._kept[key]

    def neighborhood(self, origin: str, depth: int = 1, direction: str = "both") -> tuple[DataFrame, DataFrame]:
        return self._once(("near", origin, depth, direction), lambda: graph.neighborhood(self.edges, origin, depth, direction))

    def relevance(self, origin: str, depth: int = 2) -> tuple[DataFrame, DataFrame, int]:
        return self._once(("relevant", origin, depth), lambda: graph.relevance(self.edges, origin, depth))

    def plan(self, question: str, entity_name: str | None = None, namespace: str | None = None) -> Plan:
        rows = self.spark.createDataFrame([(question, entity_name, namespace)], "question string, entity_name string, namespace string")
        r = plan_questions(rows).first()
        if r["error"]:
            raise ValueError(r["error"])
        return Plan(r["archetype"], r["action"], r["entity"], r["depth"])

    def find(self, name: str) -> str:
        """The id of the latest active entity of that name; LookupError without one."""
        origin = self.entities.where((F.col("canonical_name") == name) & F.col("is_active")).orderBy("id").select("id").first()
        if origin is None:
            raise LookupError(name)
        return origin["id"]

    def ask(self, question: str, entity_name: str | None = None, namespace: str | None = None) -> DataFrame:
        p = self.plan(question, entity_name, namespace)
        if p.action == "HEALTH_AUDIT":
            own = self.entities.where(F.col("namespace") == namespace)
            inside = graph.within(self.entities, self.edges, namespace)
            return graph.health_audit(own, inside, self.accesses.join(own.select(F.col("id").alias("from_id")), "from_id", "left_semi"))
        if p.action == "READ_LOG":
            return store.evolution(self.log)
        origin = self.find(p.entity)
        if p.action == "IMPACT_ANALYSIS":
            return graph.blast_radius(self.edges, self.spark.createDataFrame([(origin,)], "origin string"), p.depth)
        return self.relevance(origin, p.depth)[0]

    def context(self, origin: str, depth: int = 2, limit: int = render.MOST_CHARS) -> render.Context:
        nodes, edges, _ = self.relevance(origin, depth)
        return render.context(self.entities, edges, nodes, origin, limit)

    def answer(self, question: str, entity_name: str | None = None) -> dict:
        """question, text, citations, diagram of a question about one entity: by the given model (a function of a system prompt and a
        text), or else the context itself."""
        p = self.plan(question, entity_name)
        c = self.context(self.find(p.entity), p.depth)
        text = self.llm("Answer from the context alone.", f"{c.text}\n\nQuestion: {question}\n") if self.llm else c.text
        rows = self.spark.createDataFrame([(text,)], "text string").select(fenced(F.col("text"), "mermaid").alias("d"))
        return {"question": question, "text": text, "citations": c.citations, "diagram": rows.first()["d"]}
