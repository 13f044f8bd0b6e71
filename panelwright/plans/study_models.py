"""The published model tables as specifications, and their fit on a model panel.

The panel needs the columns ``installation_id, registry_id, year, bvdId, phase,
state_ownership_pct_tv, eps, v2x_polyarchy, n_employees, foreign_owned`` and
the outcome (``log_emissions_intensity``, ``log_verified`` or ``surplus_norm``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.regress import (
    Fit, ModelSpec, Term, computed, crossed, fit_all, interaction, main, regression_table,
)

INTENSITY, VERIFIED, SURPLUS = "log_emissions_intensity", "log_verified", "surplus_norm"
COUNTRY, SITE = ("registry_id", "year"), ("installation_id", "year")

# Row labels of the published tables.
LABELS = {
    "state_ownership_pct_tv": "State ownership %",
    "state_ownership_pct_tv:eps": "State ownership × EPS",
    "eps": "EPS",
    "v2x_polyarchy": "V-Dem polyarchy",
    "log(n_employees + 1)": "Log employees",
    "foreign_owned": "Foreign owned",
}
PHASE_LABELS = {
    "state_ownership_pct_tv": "State ownership % (Phase 2)",
    "state_ownership_pct_tv:phase3": "State ownership × Phase 3",
    "state_ownership_pct_tv:phase4": "State ownership × Phase 4",
    "state_ownership_pct_tv:eps": "State ownership × EPS",
    "eps": "EPS",
    "v2x_polyarchy": "V-Dem polyarchy",
}


def own() -> Term:
    return main("state_ownership_pct_tv")


def democracy() -> Term:
    return main("v2x_polyarchy")


def baseline() -> list[Term]:
    return [own()]


def policy() -> list[Term]:
    return [own(), main("eps"), democracy()]


def with_interaction() -> list[Term]:
    return [*crossed(own(), main("eps")), democracy()]


def without_stringency() -> list[Term]:
    return [own(), democracy()]


def employees() -> Term:
    return computed("log(n_employees + 1)", F.log1p("n_employees"))


def controls() -> list[Term]:
    return [*with_interaction(), employees(), main("foreign_owned")]


def phase_dummy(phase: int) -> Term:
    return computed(f"phase{phase}", (F.col("phase") == phase).cast("int"))


def phase_terms(extra: list[Term]) -> list[Term]:
    """Ownership with its shifts in phases 3 and 4, and further terms."""
    return [own(), interaction(own(), phase_dummy(3)), interaction(own(), phase_dummy(4)), *extra]


def _model(name: str, outcome: str, terms: list[Term], effects=COUNTRY, phase: int | None = None) -> ModelSpec:
    where = None if phase is None else F.col("phase") == phase
    return ModelSpec(outcome, tuple(terms), effects, "bvdId", name, where)


def _by_phase_table() -> list[ModelSpec]:
    steps = {"Baseline": baseline, "+Policy": policy, "+Inter": policy}
    last = {"Baseline": baseline, "+Policy": without_stringency, "+Inter": without_stringency}
    return [
        _model(f"P{phase} {step}", INTENSITY, terms(), phase=phase)
        for phase in (2, 3, 4)
        for step, terms in (last if phase == 4 else steps).items()
    ]


def _phase_effects_table() -> list[ModelSpec]:
    return [
        _model(
            f"P{phase} {label} FE", INTENSITY,
            without_stringency() if phase == 4 else policy(), effects, phase,
        )
        for phase in (2, 3, 4)
        for label, effects in (("Country", COUNTRY), ("Install", SITE))
    ]


def _phase_shift_table(outcome: str) -> list[ModelSpec]:
    index = [main("eps"), democracy()]
    return [
        _model("Baseline", outcome, phase_terms([]), SITE),
        _model("+Policy", outcome, phase_terms(index), SITE),
        _model("+Interaction", outcome, phase_terms([interaction(own(), main("eps")), *index]), SITE),
    ]


def _with_employees() -> list[ModelSpec]:
    return [
        _model("Baseline", VERIFIED, [*baseline(), employees()]),
        _model("+Policy", VERIFIED, [*policy(), employees()]),
        _model("+Interaction", VERIFIED, [*with_interaction(), employees()]),
    ]


TABLES: dict[str, Callable[[], list[ModelSpec]]] = {
    "emissions_intensity": lambda: [
        _model("Baseline", INTENSITY, baseline()),
        _model("+Policy", INTENSITY, policy()),
        _model("+Interaction", INTENSITY, with_interaction()),
        _model("+Controls", INTENSITY, controls()),
        _model("Install FE", INTENSITY, with_interaction(), SITE),
        *[_model(f"Phase {p}", INTENSITY, with_interaction(), phase=p) for p in (2, 3, 4)],
    ],
    "emissions_intensity_by_phase": _by_phase_table,
    "intensity_phase_fe": _phase_effects_table,
    "intensity_phase_interactions": lambda: _phase_shift_table(INTENSITY),
    "log_verified": lambda: [
        *_with_employees(), _model("Install FE", VERIFIED, with_interaction(), SITE),
    ],
    "log_verified_by_phase": lambda: [
        _model(
            f"Phase {p}", VERIFIED, without_stringency() if p == 4 else with_interaction(), SITE, p
        )
        for p in (2, 3, 4)
    ],
    "log_verified_install_fe": lambda: [
        _model(name, VERIFIED, terms(), SITE)
        for name, terms in (("Baseline", baseline), ("+Policy", policy), ("+Interaction", with_interaction))
    ],
    "log_verified_phase_interactions": lambda: _phase_shift_table(VERIFIED),
    "lv_country_fe_employees": lambda: [
        *_with_employees(),
        *[
            _model(
                f"Phase {p}", VERIFIED,
                [*(without_stringency() if p == 4 else with_interaction()), employees()], phase=p,
            )
            for p in (2, 3, 4)
        ],
    ],
    "surplus_phase_interactions": lambda: _phase_shift_table(SURPLUS),
}

PANEL_COLUMNS = (
    "installation_id", "registry_id", "year", "bvdId", "phase", "state_ownership_pct_tv", "eps",
    "v2x_polyarchy", "n_employees", "foreign_owned", INTENSITY, VERIFIED, SURPLUS,
)


def fit_table(panel: DataFrame, table: str) -> list[Fit]:
    """All models of one published table; the narrow panel is read once and kept."""
    columns = [c for c in PANEL_COLUMNS if c in panel.columns]
    narrow = panel.select(*columns).persist()
    try:
        return fit_all(narrow, TABLES[table]())
    finally:
        narrow.unpersist()


def published_table(panel: DataFrame, table: str) -> DataFrame:
    """The table itself: labelled terms, N, R2 and adjusted R2, models side by side."""
    labels = PHASE_LABELS if table.endswith("phase_interactions") else LABELS
    return regression_table(fit_table(panel, table), labels)


