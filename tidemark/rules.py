"""Rules as data: event types, keyword and code sets, label grid, feature baskets.

Everything in this module is a parameter of some operator; nothing is read
implicitly except as a default argument.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from tidemark.functions.matching import CodeRule

# --- Fixed values: event types -------------------------------------------------
TIMED_EVENTS = {
    "icu": "ICU_ADMIT",
    "pressor": "PRESSOR_START",
    "vent": "VENT_START",
    "rrt": "RRT_START",
    "death": "DEATH",
}
UNTIMED_EVENTS = ("ACS", "PCI", "CABG", "CARDIAC_ARREST")

# --- Fixed values: item keywords -----------------------------------------------
PRESSOR_WORDS = ("norepinephrine", "epinephrine", "vasopressin", "dopamine", "phenylephrine", "dobutamine")
VENT_PROCEDURE_WORDS = ("intubation", "ventilation", "mechanical vent")
VENT_CHART_WORDS = ("vent mode", "peep", "tidal volume")
RRT_PROCEDURE_WORDS = ("dialysis", "crrt", "cvvh", "renal replacement")
RRT_CHART_WORDS = ("dialysis", "crrt", "cvvh")

# --- Fixed values: diagnosis and procedure codes --------------------------------
DIAGNOSIS_RULES = (
    CodeRule("ACS", 10, prefixes=("I21", "I22"), exact=("I24.0", "I20.0")),
    CodeRule("ACS", 9, prefixes=("410",), exact=("411.1", "413.0")),
    CodeRule("CARDIAC_ARREST", 10, prefixes=("I46",)),
    CodeRule("CARDIAC_ARREST", 9, exact=("427.5", "427.41", "427.42")),
)
PROCEDURE_RULES = (
    CodeRule("PCI", 10, prefixes=("0270",)),
    CodeRule("PCI", 9, exact=("00.66", "36.06", "36.07", "36.09")),
    CodeRule("CABG", 10, prefixes=("021",)),
    CodeRule("CABG", 9, prefixes=("36.1",)),
)

# --- Fixed values: lab classes, first match wins ---------------------------------
LAB_CLASSES = (
    ("lactate", ("lactate",)),
    ("troponin", ("troponin",)),
    ("creatinine", ("creatinine",)),
    ("potassium", ("potassium",)),
    ("sodium", ("sodium",)),
    ("bicarbonate", ("bicarbonate", "hco3")),
    ("wbc", ("white blood", "wbc")),
    ("hemoglobin", ("hemoglobin", "hgb")),
    ("platelet", ("platelet",)),
    ("glucose", ("glucose",)),
    ("bun", ("bun", "urea nitrogen")),
    ("bilirubin", ("bilirubin",)),
    ("inr", ("inr",)),
)
HIGH_SENSITIVITY_ITEMS = (51003,)


@dataclass(frozen=True)
class LabelRule:
    """One event name with the horizons (hours) it is labelled for."""

    name: str
    event_type: str
    horizons: tuple[int, ...]


@dataclass(frozen=True)
class CompositeRule:
    """A composite horizon and, per event, the horizon of the flag it uses."""

    horizon: int
    members: tuple[tuple[str, int], ...]


# --- Fixed values: label grid -----------------------------------------------------
PREDICTION_HOURS = (1, 6, 24)
LABEL_RULES = (
    LabelRule("icu", "ICU_ADMIT", (24, 48)),
    LabelRule("pressor", "PRESSOR_START", (24, 48)),
    LabelRule("vent", "VENT_START", (24, 48)),
    LabelRule("rrt", "RRT_START", (24,)),
    LabelRule("death", "DEATH", (24, 48, 72)),
)
# There is no 48 h rrt flag: the 48 h composite uses the 24 h one.
COMPOSITE_RULES = (
    CompositeRule(24, (("icu", 24), ("pressor", 24), ("vent", 24), ("rrt", 24), ("death", 24))),
    CompositeRule(48, (("icu", 48), ("pressor", 48), ("vent", 48), ("rrt", 24), ("death", 48))),
)


@dataclass(frozen=True)
class WindowSpec:
    """One feature basket: window length and what to compute inside it.

    ``vitals`` lists (short name, statistics); ``first_vitals`` asks for the
    first charted row instead. ``delta_vitals``, ``last_vitals`` and
    ``time_to_first_vital`` are options beyond the standard baskets.
    """

    name: str
    hours: float
    suffix: str
    first_vitals: bool = False
    vitals: tuple[tuple[str, tuple[str, ...]], ...] = ()
    labs_first: tuple[str, ...] = ()
    labs_max: tuple[str, ...] = ()
    process: bool = True
    history: bool = True
    trend: bool = False
    lab_derived: bool = False
    lab_missing: tuple[str, ...] = ()
    last_vitals: tuple[str, ...] = ()
    delta_vitals: tuple[str, ...] = ()
    time_to_first_vital: bool = False
    ranges: tuple[tuple[str, float, float], ...] = field(default=())
    #: ends at the first deterioration; inside, its columns have a suffix of their own, outside the one ``shown``
    truncated: bool = False
    shown: str | None = None

    def __post_init__(self):
        if self.hours <= 0:
            raise ValueError(f"window {self.name}: hours must be positive")
        for short, stats in self.vitals:
            if short not in VITAL_COLUMNS:
                raise ValueError(f"window {self.name}: unknown vital {short}")
            if bad := set(stats) - {"min", "max", "mean", "std"}:
                raise ValueError(f"window {self.name}: unknown statistics {sorted(bad)}")


# --- Fixed values: vital names and baskets -----------------------------------------
VITAL_COLUMNS = {
    "sbp": "sbp",
    "dbp": "dbp",
    "hr": "heartrate",
    "rr": "resprate",
    "spo2": "o2sat",
    "temp": "temperature",
}
W6_LABS = ("lactate", "troponin", "creatinine", "potassium", "sodium", "bicarbonate", "wbc", "hemoglobin", "platelet")
W24_LABS = tuple(name for name, _ in LAB_CLASSES)

W1 = WindowSpec("w1", 1, "w1", first_vitals=True, process=False, history=False)
W6 = WindowSpec(
    "w6", 6, "6h",
    vitals=(
        ("sbp", ("min", "max", "mean", "std")),
        ("dbp", ("min",)),
        ("hr", ("min", "max", "mean", "std")),
        ("rr", ("max", "mean")),
        ("spo2", ("min", "mean")),
        ("temp", ("max", "min")),
    ),
    labs_first=W6_LABS, trend=True, lab_missing=("lactate", "troponin"),
)
W24 = WindowSpec(
    "w24", 24, "24h",
    vitals=(
        ("sbp", ("min", "max", "mean", "std")),
        ("hr", ("min", "max", "mean")),
        ("rr", ("max", "mean")),
        ("spo2", ("min", "mean")),
        ("temp", ("max",)),
    ),
    labs_first=W24_LABS, labs_max=("lactate", "creatinine"), lab_derived=True,
)
WINDOWS = {"W1": W1, "W6": W6, "W24": W24}


def truncated_window(spec: WindowSpec) -> WindowSpec:
    """The same basket up to the first deterioration, to be built beside the whole one."""
    return replace(spec, name=f"{spec.name}t", suffix=f"{spec.suffix}t", truncated=True, shown=spec.suffix)

# --- Fixed values: plausibility ranges used by the quality checks --------------------
VITAL_RANGES = (
    ("hr_mean", 20.0, 250.0),
    ("sbp_mean", 40.0, 280.0),
    ("temp_mean", 30.0, 43.0),
    ("rr_mean", 4.0, 60.0),
    ("spo2_mean", 50.0, 100.0),
)
