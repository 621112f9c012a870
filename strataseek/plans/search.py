"""Question to ranked chunks, and to an answer."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.config import DEFAULT_TOP_K, FEATURES
from strataseek.errors import ValidationError
from strataseek.functions.text import tokens
from strataseek.operators.answers import context_block, parse_confidence
from strataseek.operators.prompts import checked_language, system_prompt, user_prompt
from strataseek.operators.rerank import provider_rows, rerank
from strataseek.operators.retrieval import TextIndex, channel_weights, dense, fuse, is_identifier_query, sparse
from strataseek.providers import CrossEncoder, Embedder, ExtractiveGenerator, Generator, HashEmbedder, complete

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SearchRequest:
    query: str
    feature: str = FEATURES[0]
    codebase: str | None = None
    top_k: int = DEFAULT_TOP_K
    language: str = "cobol"
    model: str | None = None

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise ValidationError("the query is blank")
        if self.top_k <= 0:
            raise ValidationError("top_k has to be 1 or more")
        if self.feature not in FEATURES:
            raise ValidationError(f"unknown feature: {self.feature}")
        object.__setattr__(self, "language", checked_language(self.language))
        for name in ("codebase", "model"):
            value = getattr(self, name)
            object.__setattr__(self, name, value.strip() or None if value else None)


def within(points: DataFrame, codebase: str | None) -> DataFrame:
    """The points of a codebase, or all."""
    return points.where(F.col("codebase") == codebase) if codebase else points


@dataclass
class Engine:
    spark: SparkSession
    points: DataFrame
    embedder: Embedder = field(default_factory=HashEmbedder)
    generator: Generator = field(default_factory=ExtractiveGenerator)
    cross_encoder: CrossEncoder | None = None
    models: tuple[str, ...] = ("primary", "fallback")
    index: TextIndex | None = None

    def _one(self, column) -> object:
        return self.spark.range(1).select(column).first()[0]

    def retrieve(self, request: SearchRequest) -> DataFrame:
        """The fused top_k with payload and score. The codebase filter stands before both cuts. Without an index the texts are searched."""
        points = within(self.points, request.codebase)
        limit = 2 * request.top_k
        query = self.embedder.embed([request.query], "query")[0]
        weights = channel_weights(bool(self._one(is_identifier_query(F.lit(request.query)))))
        by_terms = sparse(points, request.query, limit, index=self.index, filtered=bool(request.codebase)).select(F.col("id").cast("string"), "score")
        fused = fuse(dense(points, query, limit), by_terms, weights, request.top_k)
        return points.drop("vector").join(F.broadcast(fused.select("id", F.col("fused").alias("score"))), "id")  # top_k rows

    def search(self, request: SearchRequest) -> DataFrame:
        found = self.retrieve(request).withColumn("name", F.coalesce(F.nullif("paragraph_name", F.lit("")), "name"))
        words = self._one(tokens(F.lit(request.query)))
        scores = None
        if self.cross_encoder is not None:
            rows = found.select("id", "content").collect()  # top_k rows
            try:
                given = provider_rows([r["id"] for r in rows], self.cross_encoder.scores(request.query, [r["content"] for r in rows]))
                scores = self.spark.createDataFrame(given, "id string, relevance double") if given else None
            except Exception as e:  # a cross-encoder that fails leaves the metadata order
                log.warning("the cross-encoder failed, results keep the order by metadata: %s", e)
        return rerank(found, words, request.feature, scores)

    def messages(self, request: SearchRequest, chunks: list) -> list[dict[str, str]]:
        rows = [(c["file_path"], c["line_start"], c["line_end"], c["name"], c["division"], c["content"], {"paragraph_name": c["paragraph_name"] or "", "division": c["division"] or ""}) for c in chunks]
        kind = "array<struct<file_path:string,line_start:int,line_end:int,name:string,division:string,content:string,metadata:map<string,string>>>"
        context = self.spark.createDataFrame([(rows,)], f"c {kind}").select(context_block(F.col("c"))).first()[0]
        return [{"role": "system", "content": system_prompt(request.feature, request.language)}, {"role": "user", "content": user_prompt(request.query, context)}]

    def stream(self, request: SearchRequest) -> Iterator[str]:
        models = [request.model] if request.model else []
        yield from complete(self.generator, self.messages(request, self.search(request).collect()), models + list(self.models))

    def answer(self, request: SearchRequest) -> dict:
        chunks = self.search(request).collect()  # top_k rows
        models = ([request.model] if request.model else []) + list(self.models)
        used: list[str] = []
        text = "".join(complete(self.generator, self.messages(request, chunks), models, used)).strip()
        return {
            "answer": text,
            "chunks": [r.asDict(recursive=True) for r in chunks],
            "query": request.query,
            "feature": request.feature,
            "confidence": self._one(parse_confidence(F.lit(text))),
            "codebase_filter": request.codebase,
            "model": used[0],
        }
