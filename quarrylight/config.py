"""Engine parameters: one frozen object, passed explicitly and clamped on construction."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: Least and greatest of each clamped parameter.
LIMITS = {
    "hedge_ms": (0, 15_000),
    "max_agents": (2, 8),
    "enrich_concurrency": (1, 8),
    "relevance_floor": (0.02, 0.45),
    "max_rows": (6, 48),
    "snippet_chars": (800, 120_000),
    "enriched_floor": (400, 200_000),
    "citation_urls": (16, 96),
    "sources_line": (8, 40),
    "adaptive_cap": (6, 32),
    "cache_ttl_s": (30, 86_400),
}


@dataclass(frozen=True)
class EngineConfig:
    as_of: str = "2026-01-01"
    max_results: int = 20
    page_enrich: int = 12
    conversation_budget: int = 48
    memory_lines: int = 24
    hedge_ms: int = 2000
    max_agents: int = 5
    enrich_concurrency: int = 7
    relevance_floor: float = 0.06
    max_rows: int = 28
    snippet_chars: int = 24_000
    enriched_floor: int = 24_000
    citation_urls: int = 48
    sources_line: int = 24
    adaptive_cap: int = 14
    cache_ttl_s: int = 240
    strict_guard: bool = False

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name in LIMITS:
                low, high = LIMITS[f.name]
                object.__setattr__(self, f.name, max(low, min(getattr(self, f.name), high)))

    @property
    def year(self) -> int:
        return int(self.as_of[:4])


#: Presets of results, pages, searches a conversation and remembered lines.
PROFILES = {
    "light": EngineConfig(max_results=8, page_enrich=4, conversation_budget=8, memory_lines=10),
    "balanced": EngineConfig(max_results=12, page_enrich=8, conversation_budget=16, memory_lines=16),
    "full": EngineConfig(),
}
