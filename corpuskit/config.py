"""Settings with the defaults the behaviour has to match.

Plain keyword arguments override any field; nothing is read from the environment.
"""

from __future__ import annotations

from dataclasses import dataclass, field


# Defaults that results depend on.
DEFAULT_CHUNK_SIZE = 512
DEFAULT_CHUNK_OVERLAP = 64
DEFAULT_TOP_K = 5
DEFAULT_RETRY_MAX = 5
DEFAULT_RETRY_BASE_DELAY = 2.0
DEFAULT_EMBED_CONCURRENCY = 4
DEFAULT_EMBED_BATCH = 64
DEFAULT_SNIPPET_CHARS = 400
DEFAULT_COLLECTION = "documents"
REPLY_RESERVE_TOKENS = 1024
LOCAL_CONTEXT_WINDOW = 4096
DEFAULT_CONTEXT_WINDOW = 128_000
# Model name -> context window (tokens).
CONTEXT_WINDOWS = {
    "anthropic/claude-opus-4-7": 200_000,
    "anthropic/claude-sonnet-4-6": 200_000,
    "anthropic/claude-haiku-4-5": 200_000,
}
# Default collection name per source kind.
SOURCE_COLLECTIONS = {
    "email": "emails",
    "text": "documents",
    "web": "paulgraham",
    "image": "images",
}


@dataclass(frozen=True)
class Settings:
    chunk_size: int = DEFAULT_CHUNK_SIZE
    chunk_overlap: int = DEFAULT_CHUNK_OVERLAP
    top_k: int = DEFAULT_TOP_K
    retry_max: int = DEFAULT_RETRY_MAX
    retry_base_delay: float = DEFAULT_RETRY_BASE_DELAY
    # None: as many embedding calls at a time as there are tasks
    embed_concurrency: int | None = None
    embed_batch: int = DEFAULT_EMBED_BATCH
    snippet_chars: int = DEFAULT_SNIPPET_CHARS
    hash_dim: int = 64
    # Largest question block shipped whole to every search task (rows).
    max_broadcast_questions: int = 20_000
    context_windows: dict = field(default_factory=lambda: dict(CONTEXT_WINDOWS))

    def __post_init__(self):
        if self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be in [0, chunk_size)")
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")
