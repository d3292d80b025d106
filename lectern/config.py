"""One configuration object for ingestion, retrieval and answers, and its presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Chunking:
    size: int = 1500
    overlap: int = 200
    strategy: str = "flat"  # or "chapter"
    code_rule: str = "broad"  # or "strict"


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 10
    rerank_k: int = 5
    similarity: float = 0.4
    topic: float = 0.2
    keyword: float = 0.05
    code: float = 0.25
    text: float = 0.1


@dataclass(frozen=True)
class Answers:
    confidence: float = 0.85
    degraded_confidence: float = 0.5
    sources: int = 3
    snippets: int = 2
    fallback_chars: int = 500
    legacy_separator: bool = False


@dataclass(frozen=True)
class Config:
    namespace: str = "books_rag"
    dimension: int = 384
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    answers: Answers = field(default_factory=Answers)
    log_level: str = "INFO"


DEFAULT = Config()
PRESETS: dict[str, Config] = {
    "default": DEFAULT,
    "dev": replace(DEFAULT, log_level="DEBUG"),
    "production": replace(DEFAULT, log_level="WARNING", retrieval=replace(DEFAULT.retrieval, top_k=20)),
    "fast": replace(DEFAULT, retrieval=replace(DEFAULT.retrieval, top_k=5, rerank_k=3)),
}
