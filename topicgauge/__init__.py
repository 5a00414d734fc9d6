"""Topic coverage of documents, for whole tables of documents and queries, on Spark."""

from topicgauge.operators.embedding import HashedTerms, ModelVectors, PrecomputedVectors
from topicgauge.plans.analysis import Analysis, analyze, analyze_chunks
from topicgauge.plans.compare import compare_documents, score_documents, score_prechunked
from topicgauge.settings import ChunkOptions

__all__ = [
    "Analysis",
    "ChunkOptions",
    "HashedTerms",
    "ModelVectors",
    "PrecomputedVectors",
    "analyze",
    "analyze_chunks",
    "compare_documents",
    "score_documents",
    "score_prechunked",
]
