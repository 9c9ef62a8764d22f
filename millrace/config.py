"""Default settings; a call's own arguments take precedence."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """How documents are chunked, embedded and searched."""

    chunking_method: str = "sentence"
    chunk_size: int = 40
    overlap_size: int = 5
    semantic_breakpoint_percentile: float = 95
    semantic_buffer_size: int = 1
    semantic_max_chunk_sentences: int = 0
    token_chunk_size: int = 512
    token_chunk_overlap: int = 50
    token_encoding: str = "cl100k_base"
    embedding_batch_size: int = 64
    embedding_model: str = "hash-64"
    n_results: int = 5
    source_url: str = ""
    use_hybrid_search: bool = False
    hybrid_rrf_k: int = 60
    hybrid_candidates: int = 3
    use_hyde: bool = False
    record_data: bool = False
    data_language: str = "english"


def resolve(flag: bool | None, default: bool) -> bool:
    """An explicit flag, or the configured one."""
    return default if flag is None else flag


def result_count(asked: int | None, default: int = Settings.n_results) -> int:
    """The number of results asked for, at least one; the default where none or nonsense is given."""
    try:
        return max(1, int(asked)) if asked is not None else default
    except (TypeError, ValueError):
        return default
