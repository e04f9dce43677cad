"""Column names: groups by suffix, long forms of coded names, normalisers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from emberbasin.schemas import (
    FUTURE_INDICATORS,
    FUTURE_KEYS,
    FUTURE_TYPES,
    MONTH_NAMES,
    MONTHLY_INDICATORS,
    MONTHLY_KEY,
    MONTHLY_TYPES,
    SCENARIO_YEARS,
    SCENARIOS,
)

# Coded name shapes.
FUTURE_CODE = r"^(bau|opt|pes)(30|50|80)_([a-z]{2})_x_([rslc])"
MONTHLY_CODE = r"^(bws|bwd|iav)_([0-9]{2})_(raw|score|cat|label)$"
CLEAN_NAME = r"^[A-Z0-9_]+$"


def ending_with(columns: Iterable[str], *suffixes: str) -> list[str]:
    return [c for c in columns if c.endswith(suffixes)]


def containing(columns: Iterable[str], *parts: str) -> list[str]:
    return [c for c in columns if any(p in c for p in parts)]


def future_long_name(code: str) -> str:
    """``bau30_ws_x_r`` spelled out; other names unchanged."""
    if code in FUTURE_KEYS:
        return FUTURE_KEYS[code]
    found = re.match(FUTURE_CODE, code)
    if not found:
        return code
    scenario, year, indicator, kind = found.groups()
    topic = FUTURE_INDICATORS.get(indicator, indicator)
    return f"{topic} ({SCENARIOS[scenario]}, Year {SCENARIO_YEARS[year]}) - {FUTURE_TYPES[kind]}"


def monthly_long_names() -> dict[str, str]:
    """``bws_01_raw`` and its kin, for each indicator, month and type, plus the key."""
    names = {"pfaf_id": MONTHLY_KEY}
    for code, topic in MONTHLY_INDICATORS.items():
        for month in range(1, 13):
            for kind, label in MONTHLY_TYPES.items():
                names[f"{code}_{month:02d}_{kind}"] = f"{topic} (Month {month}) - {label}"
    return names


def upper_underscore(name: str) -> str:
    """Upper case, every character outside ``A-Z 0-9 _`` made an underscore."""
    return re.sub(r"[^A-Z0-9_]", "_", name.upper())


def upper_squeezed(name: str) -> str:
    """Upper case; ``% ( )`` are kept, runs of underscores become one, none at the ends."""
    kept = re.sub(r"[^A-Z0-9%_()]+", "_", name.upper())
    return re.sub(r"_{2,}", "_", kept).strip("_")


def month_names(columns: Sequence[str]) -> list[str]:
    """``MONTH_1`` to ``MONTH_12`` inside a name become the month; other numbers stay."""

    def spelled(found: re.Match[str]) -> str:
        month = int(found.group(1))
        return MONTH_NAMES[month - 1] if 1 <= month <= 12 else found.group(0)

    return [re.sub(r"MONTH_(\d{1,2})", spelled, c) for c in columns]


def is_clean_name(name: str) -> bool:
    return re.match(CLEAN_NAME, name) is not None


def resolve_column(columns: Iterable[str], candidates: Sequence[str]) -> str:
    """The first candidate that is there in any case, as it is spelled there."""
    present = {c.lower(): c for c in columns}
    for candidate in candidates:
        if candidate.lower() in present:
            return present[candidate.lower()]
    raise KeyError(f"none of {', '.join(candidates)} is among the columns")
