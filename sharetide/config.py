"""Tunable thresholds, gathered in one immutable object that every stage accepts."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults of every threshold and of the text vocabulary.
NULL_TOKENS = ("nan", "none", "null", "")
UNKNOWN = "Unknown"
ALL_REGIONS = "All Regions"
REGION_ALIASES = {
    "tn": "Tamil Nadu",
    "tamil nadu": "Tamil Nadu",
    "tamil ndu": "Tamil Nadu",
    "tamilnadu": "Tamil Nadu",
    "tn_state": "Tamil Nadu",
    "w. bengal": "West Bengal",
    "west bengal": "West Bengal",
    "westbengal": "West Bengal",
    "andhra pradesh": "Andhra Pradesh",
    "andhrapradesh": "Andhra Pradesh",
    "karnataka": "Karnataka",
    "karnatka": "Karnataka",
    "kerala": "Kerala",
    "rajasthan": "Rajasthan",
    "maharashtra": "Maharashtra",
    "delhi": "Delhi",
    "gujarat": "Gujarat",
    "telangana": "Telangana",
}


@dataclass(frozen=True)
class Settings:
    """Thresholds of the weekly run.

    ``epoch_year`` anchors the running week number ``(iso_year - epoch_year) * 52 + iso_week``.
    ``clamp53`` folds ISO week 53 into week 52.  ``strict_hint`` refuses week hints written as
    integral decimals (``2.0``).  ``on_multi`` says what happens to a brand sold in several
    categories: ``fan_out`` repeats its rows per category, ``first`` keeps the smallest name.
    """

    lookback: int = 3
    z_threshold: float = 3.0
    ma_factor: float = 2.0
    envelope_factor: float = 3.0
    contamination: float = 0.04
    substantial_shift_pp: float = 1.5
    scale_floor_pp: float = 0.20
    z_clip: float = 10.0
    sum_tolerance: float = 0.5
    epoch_year: int = 2022
    clamp53: bool = True
    strict_hint: bool = False
    on_multi: str = "fan_out"
    dedupe: str = "before_validation"
    n_trees: int = 100
    tree_sample: int = 256
    seed: int = 42
    horizon: int = 4
    holdout: int = 4
    min_history: int = 6
    salts: int = 32
