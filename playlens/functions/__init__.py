from playlens.functions.columns import (  # noqa: F401
    level_gap_pick,
    ratio,
    repaired_text,
    round6,
    success_flag,
)
