"""Parameters of hybrid retrieval."""

from __future__ import annotations

from dataclasses import dataclass

# Bounds of a request.
MOST_PASSAGES = 30
MOST_QUERY_CHARS = 2000
MOST_DOCUMENT_IDS = 100


@dataclass(frozen=True)
class RetrievalConfig:
    """Knobs of hybrid retrieval; values enter plans as literals."""

    # The defaults of a search.
    vector_candidates: int = 50
    keyword_candidates: int = 50
    rrf_k: int = 60
    vector_weight: float = 1.0
    keyword_weight: float = 1.0
    rerank_enabled: bool = False
    rerank_candidates: int = 30
    rerank_min_score: float | None = None
    mmr_lambda: float = 0.7
    neighbor_window: int = 1
    max_context_tokens: int = 6000
    top_k: int = 8

    def __post_init__(self) -> None:
        problems = {
            "a search needs a weight that isn't zero": not (self.vector_weight or self.keyword_weight),
            "without reranking there is no score to have a least value": self.rerank_min_score is not None and not self.rerank_enabled,
            f"between 1 and {MOST_PASSAGES} passages can be asked for": self.top_k not in range(1, MOST_PASSAGES + 1),
            "lambda lies between 0 and 1": not 0 <= self.mmr_lambda <= 1,
            "sizes and windows aren't negative": min(self.vector_candidates, self.keyword_candidates, self.rerank_candidates, self.neighbor_window, self.max_context_tokens) < 0,
        }
        if found := [text for text, bad in problems.items() if bad]:
            raise ValueError("; ".join(found))


def content_room(most_tokens: int, reserve: int = 64, special: int = 2) -> int:
    """Tokens that are left for content in a model's input, after a reserve and its special tokens."""
    if (room := most_tokens - reserve - special) < 1:
        raise ValueError(f"no room for content in {most_tokens} tokens")
    return room
