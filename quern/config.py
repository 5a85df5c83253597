"""Settings of the engine, with their defaults. Values are passed to the operators as arguments."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    # splitting
    chunk_size: int = 1024
    chunk_overlap: int = 130
    # BM25
    k1: float = 1.5
    b: float = 0.75
    negative_idf_share: float = 0.25
    df_cutoff: float = 0.0
    # fusion
    alpha: float = 0.48
    rrf_k: int = 60
    # widths
    top_k: int = 10
    dense_k: int = 23
    sparse_k: int = 23
    fused_k: int = 25
    multi_k: int = 12
    multi_fused_k: int = 15
    pool_cap: int = 40
    min_per_subquery: int = 2
    max_subqueries: int = 4
    # diversity
    mmr_fetch: int = 50
    mmr_lambda: float = 0.87
    # reranking: "pooled" (all of a pool against the question), "per_subquery" or "none"
    rerank_mode: str = "pooled"
    score_threshold: float = 0.0
    min_kept: int = 3
    consensus_skip: float = 0.0
    # scoped search
    entity_k: int = 8
    max_entities: int = 3
    person_k: int = 2
    person_sources: int = 12
    # retention of sources that mention the key of a question
    fan_in: bool = False
    fan_in_sources: int = 6
    # context
    radius: int = 2
    context_chars: int = 24_000
    hop_context_chars: int = 48_000
    hop_chunks: int = 20
    judge_chars: int = 30_000
    judge_doc_chars: int = 1_500
    # control
    max_passes: int = 3
    digest_chars: int = 400
    digest_sources: int = 12
    digest_fields: int = 4
    # memory and cache
    history_turns: int = 5
    history_answer_chars: int = 1_500
    cache_entries: int = 1_000
    cache_seconds: int = 86_400
    #: words of the site's own name, which name nothing in questions and titles
    site_words: tuple[str, ...] = ()
    # service
    question_chars: int = 2_000
    session_idle: str = "30 minutes"
    watermark: str = "10 minutes"


DEFAULTS = Config()


def from_env(environ: dict[str, str], prefix: str = "QUERN_") -> Config:
    """Settings from an environment: PREFIX and a field's name in capitals. Numbers and flags (1, true, yes,
    on) by the field's kind; "none" or nothing leaves the default; words of a list are apart by commas."""
    found = {}
    for field in fields(Config):
        raw = environ.get(f"{prefix}{field.name.upper()}", "").strip()
        if raw.lower() in ("", "none"):
            continue
        default = getattr(DEFAULTS, field.name)
        if isinstance(default, bool):
            found[field.name] = raw.lower() in ("1", "true", "yes", "on")
        elif isinstance(default, tuple):
            found[field.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
        else:
            found[field.name] = type(default)(raw)
    return replace(DEFAULTS, **found)
