"""Recoding: case chains, dictionaries, flags and sentinels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from . import fixed_values as fv


def first_match(cases: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """Label of the first true condition, else ``otherwise`` (null by default)."""
    (condition, label), *rest = cases
    chain = F.when(condition, label)
    for condition, label in rest:
        chain = chain.when(condition, label)
    return chain.otherwise(F.lit(otherwise))


def is_member(value: Column, members: Sequence) -> Column:
    """Membership that is false, never null, for a missing value."""
    return F.coalesce(value.isin(*members), F.lit(False))


def lookup(mapping: Mapping, key: Column) -> Column:
    """Value of a literal dictionary; null for an unknown or missing key."""
    entries = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.when(key.isNotNull(), F.create_map(*entries)[key])


def flag(condition: Column, missing_as_zero: bool = False) -> Column:
    """0/1 integer of a condition; a null condition stays null unless asked otherwise."""
    number = condition.cast("int")
    return F.coalesce(number, F.lit(0)) if missing_as_zero else number


def null_if(value: Column, *sentinels: object) -> Column:
    """``value`` with every sentinel turned into null."""
    return F.when(~value.isin(*sentinels), value)


def is_blank(value: Column) -> Column:
    """True for null and for the empty string."""
    return value.isNull() | (value == "")


def level_rank(value: Column, levels: Sequence[str]) -> Column:
    """Position (from 1) of a label in a fixed level list; null when not listed."""
    return lookup({level: position for position, level in enumerate(levels, 1)}, value)


def phase_of_period(label: Column) -> Column:
    return lookup(fv.PHASES, label)


def sector_of(activity: Column) -> Column:
    cases = [(activity.isin(*codes), name) for name, codes in fv.SECTORS.items()]
    return first_match(cases, "Other")


def ownership_band(pct: Column, minority: bool = False) -> Column:
    """Band of a state share.

    Without ``minority`` the open interval (0, 50) has no band and gives null.
    """
    names = fv.OWNERSHIP_BANDS_4 if minority else fv.OWNERSHIP_BANDS_3
    private, *middle, full = names
    cases = [(pct == 0, private)]
    if minority:
        cases.append(((pct > 0) & (pct < 50), middle[0]))
    cases += [((pct >= 50) & (pct < 100), middle[-1]), (pct == 100, full)]
    return first_match(cases)


def ownership_two_way(pct: Column) -> Column:
    return first_match([(pct == 0, "Private"), (pct >= 50, "State-owned")])


def ownership_type(foreign: Column, state: Column, four_way: bool = False) -> Column:
    """Foreign / domestic state / domestic private, or all four combinations."""
    domestic = [
        ((foreign == 0) & (state == 1), "Domestic state"),
        ((foreign == 0) & (state == 0), "Domestic private"),
    ]
    if four_way:
        abroad = [
            ((foreign == 1) & (state == 1), "Foreign state"),
            ((foreign == 1) & (state == 0), "Foreign private"),
        ]
    else:
        abroad = [(foreign == 1, "Foreign owned")]
    return first_match(abroad + domestic)


def policy_group(country: Column) -> Column:
    return first_match(
        [
            (country.isin(*fv.GREEN_COUNTRIES), "Green government"),
            (country.isin(*fv.LAGGARD_COUNTRIES), "Laggard government"),
        ]
    )


def matches_ignoring_case(value: Column, pattern: str) -> Column:
    return value.rlike(f"(?i){pattern}")


def fuel_of(description: Column) -> Column:
    """Fuel by regular expression; the order of the patterns decides."""
    cases = [(matches_ignoring_case(description, p), fuel) for p, fuel in fv.FUEL_PATTERNS]
    return first_match(cases, "other")
