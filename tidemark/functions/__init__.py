"""Column expressions: no data movement, all inside code generation."""

from tidemark.functions.bits import bit_string, datelist_bits
from tidemark.functions.boxscore import box_score_flags, comment_flag, minutes_played
from tidemark.functions.tiers import RATING_BOUNDS, RATING_LABELS, tier

__all__ = [
    "RATING_BOUNDS",
    "RATING_LABELS",
    "bit_string",
    "box_score_flags",
    "comment_flag",
    "datelist_bits",
    "minutes_played",
    "tier",
]
