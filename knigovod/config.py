"""Settings of a run. Every value that depends on the owner of the books is an input."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Segments and text layer
    min_segment_confidence: float = 0.25
    row_tolerance: float = 18.0
    min_text_layer_chars: int = 100
    # Extraction
    max_amount: int = 9_999_999
    min_amount_above_words: int = 100
    # Registry matching
    match_threshold: float = 60.0
    match_floor: float = 45.0
    match_margin: float = 5.0
    min_token_length: int = 4
    max_token_candidates: int = 4
    # Account suggestion
    correction_similarity: float = 0.82
    description_similarity: float = 0.35
    duplicate_similarity: float = 0.95
    # Checks
    total_basis: str = "gross"
    # The books' owner: never taken for the vendor
    own_vat_numbers: tuple[str, ...] = ()
    buyer_pattern: str | None = None
    # (pattern that betrays a vendor, canonical name, text to find in the registry)
    vendor_aliases: tuple[tuple[str, str, str], ...] = ()


DEFAULT = Settings()

# Largest dimension that may be folded into an expression or sent to every task.
# Beyond these the operators take their shuffle path.
MAX_INLINE_ROWS = 2_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
