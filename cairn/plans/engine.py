"""Route plans and the retrieval engine."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import ranking
from cairn.plans import routes

#: Route classes and defaults.
SEMANTIC = {"chunk_dense", "enhanced_chunk_dense", "section_dense", "section_summary_dense", "file_summary_dense", "qa_dense"}
LEXICAL = {"bm25_sparse", "exact_match", "boolean_search"}
TOP_K, RERANK_N, STRATEGY = 20, 50, "rrf"


@dataclass
class Route:
    name: str
    top_k: int = TOP_K
    params: dict = field(default_factory=dict)


@dataclass
class Plan:
    routes: list[Route]
    strategy: str = STRATEGY
    rerank_top_n: int = RERANK_N
    weights: dict[str, float] = field(default_factory=dict)


def default_plan(top_k: int) -> Plan:
    """R7."""
    return Plan([Route(r, 3 * top_k) for r in ("chunk_dense", "enhanced_chunk_dense", "bm25_sparse")], rerank_top_n=min(6 * top_k, 100))


def parse_plan(text: str) -> Plan:
    """The first fenced or braced JSON object."""
    m = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S) or re.search(r"(\{.*\})", text, re.S)
    if not m:
        raise ValueError("no plan found")
    got = json.loads(m[1])
    return Plan([Route(r["name"], int(r.get("top_k", TOP_K)), r.get("params") or {}) for r in got.get("routes", [])], got.get("fusion_strategy", STRATEGY), int(got.get("rerank_top_n", RERANK_N)))


def validated(plan: Plan, known: set[str], top_k: int) -> Plan:
    """R6."""
    routes = [r for r in plan.routes if r.name in known]
    return Plan(routes or [Route("chunk_dense", 3 * top_k), Route("bm25_sparse", 3 * top_k)], plan.strategy, plan.rerank_top_n, plan.weights)


def for_mode(plan: Plan, mode: str, top_k: int) -> Plan:
    """Structured and graph search count as hybrid."""
    only = {"semantic": SEMANTIC, "lexical": LEXICAL}.get(mode)
    if only is None:
        return plan
    routes = [r for r in plan.routes if r.name in only]
    return Plan(routes or [Route("chunk_dense" if only is SEMANTIC else "bm25_sparse", 3 * top_k)], plan.strategy, plan.rerank_top_n, plan.weights)


class Engine:
    """Routes by name; a route is a function (query, top_k, params) -> DataFrame(chunk_id, score).

    With a store it has the nine built-in routes, aligns what they find, and pins answers to questions; without one,
    the registered routes' hits are taken as chunks.
    """

    def __init__(self, store: routes.Store | None = None):
        self.store = store
        self._routes: dict[str, Callable[[str, int, dict], DataFrame]] = routes.builtin(store) if store else {}

    def register(self, name: str, route: Callable[[str, int, dict], DataFrame]) -> None:
        self._routes[name] = route

    def unregister(self, name: str) -> None:
        self._routes.pop(name, None)

    def names(self) -> list[str]:
        return list(self._routes)

    def describe(self) -> dict[str, str]:
        return {n: (f.__doc__ or "").strip() for n, f in self._routes.items()}

    def single(self, name: str, q: str, top_k: int = TOP_K, **params) -> DataFrame:
        """One capability."""
        return self._routes[name](q, top_k, params)

    @staticmethod
    def is_semantic(name: str) -> bool:
        """Q21."""
        return name in SEMANTIC

    @staticmethod
    def is_lexical(name: str) -> bool:
        return name in LEXICAL

    def recall(self, q: str, plan: Plan) -> DataFrame:
        """Unknown routes are passed over."""
        return ranking.recall({r.name: self._routes[r.name](r.params.get("query_text") or q, r.top_k, r.params) for r in plan.routes if r.name in self._routes})

    def pinned(self, recalled: DataFrame) -> DataFrame | None:
        """The sources of the best question, if its score and answer are good enough: (ord, chunk_id, score, text)."""
        if self.store is None or self.store.qa is None:
            return None
        known = self.store.qa.select(F.col("id").alias("key"), "answer", "source_chunk_ids")
        asked = recalled.filter("route = 'qa_dense'").join(known, "key").withColumn("source_chunk_ids", F.col("source_chunk_ids").cast("array<string>"))
        chunks = self.store.texts().select("chunk_id", F.col("text").alias("display_text"), F.col("text").alias("search_text"))
        return ranking.hydrate(ranking.pin(asked), chunks)

    def candidates(self, q: str, plan: Plan) -> tuple[DataFrame, DataFrame | None]:
        """(aligned recall rows without the pinned chunks, the pinned evidence): the first phases of R26."""
        recalled = self.recall(q, plan)
        if self.store is None:
            return recalled, None
        vectors = [r.params["vector"] for r in plan.routes if r.params.get("vector") is not None]
        asked = self.store.query_vector(q, {"vector": vectors[0] if vectors else None}) if vectors or self.store.embed else None
        aligned, evidence = routes.align(recalled, self.store, asked), self.pinned(recalled)
        return (aligned if evidence is None else ranking.without(aligned, evidence)), evidence

    def retrieve(self, q: str, texts: DataFrame | None = None, plan: Plan | None = None, top_k: int = 10, mode: str = "hybrid", skip_rerank: bool = False, threshold: float | None = None) -> DataFrame:
        """Recall, align, pin, fuse, rerank or cut, threshold. Pinned evidence comes from pinned(), and is not among the rows."""
        if not 1 <= len(q) <= 2000 or not 1 <= top_k <= 100:
            raise ValueError("query or top_k out of bounds")
        plan = for_mode(validated(plan or default_plan(top_k), set(self._routes), top_k), mode, top_k)
        rows, _ = self.candidates(q, plan)
        fused = ranking.fuse(rows, plan.strategy, plan.weights)
        if skip_rerank:
            out = ranking.best(fused, top_k).drop("first")
        else:
            out = ranking.rerank(fused, self.store.texts() if texts is None else texts, q.split(), plan.rerank_top_n, top_k)
        return out if threshold is None else out.filter(F.col("score") >= threshold)
