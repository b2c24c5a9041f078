"""The registered queries as DuckDB SQL over the same tables.

Written against the definitions, with range joins and row numbers instead of the
ordered scans the operators use. ``WITH`` parts are shared between queries.
"""

from __future__ import annotations

import re

from tidemark import rules as R
from tidemark.plans import bindings as B


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def hours(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) / 3.6e9)"


def r6(sql: str, columns, digits: int = 6) -> str:
    """Round computed doubles, as the queries do."""
    cols = columns.split() if isinstance(columns, str) else list(columns)
    body = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)
    return f"SELECT * REPLACE ({body}) FROM ({sql})" if cols else sql


def _like(column: str, words) -> str:
    return "(" + " OR ".join(f"lower({column}) LIKE '%{w}%'" for w in words) + ")"


CTE: dict[str, str] = {}
CTE["ev"] = "SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events"
CTE["stays"] = """
SELECT user_id AS subject_id, event_id AS stay_id, CASE WHEN value >= 10 THEN event_id END AS hadm_id,
       ts AS intime, ts + to_hours(k % 13) AS outtime,
       CASE WHEN k % 2 = 0 THEN 'AMBULANCE' ELSE 'WALK IN' END AS arrival_transport,
       CASE WHEN value >= 10 THEN 'ADMITTED' ELSE 'HOME' END AS disposition,
       'GROUP ' || (k % 5) AS race
FROM ev WHERE event_type = 'signup'"""
CTE["persons"] = """
SELECT c_custkey AS subject_id, 14 + c_nationkey * 4 AS anchor_age, 2024 - c_custkey % 3 AS anchor_year,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'M' ELSE 'F' END AS gender,
       CASE WHEN c_acctbal < 0 THEN DATE '2024-01-20' END AS dod
FROM customer"""
CTE["cohort"] = f"""
SELECT s.subject_id, s.stay_id, s.hadm_id, s.intime AS ed_intime, s.outtime AS ed_outtime, p.anchor_age, p.anchor_year,
       p.gender, p.dod, p.anchor_age + year(s.intime) - p.anchor_year AS age_at_ed, s.arrival_transport, s.disposition,
       s.race, {hours('s.intime', 's.outtime')} AS ed_los_hours, CASE WHEN s.hadm_id IS NOT NULL THEN 1 ELSE 0 END AS was_admitted
FROM stays s JOIN persons p ON s.subject_id = p.subject_id
WHERE s.intime IS NOT NULL AND s.outtime > s.intime AND p.anchor_age + year(s.intime) - p.anchor_year BETWEEN 18 AND 110
  AND (p.dod IS NULL OR s.intime <= p.dod)"""
CTE["facts"] = """
SELECT e.user_id AS subject_id, s.stay_id, s.hadm_id, e.event_id, e.ts, e.event_type, e.value, e.k
FROM (SELECT * FROM ev WHERE event_type <> 'signup') e ASOF JOIN stays s ON e.user_id = s.subject_id AND e.ts >= s.intime"""
CTE["triage"] = """
SELECT event_id AS stay_id, CASE WHEN k % 3 <> 0 THEN 95.0::DOUBLE + k / 10.0::DOUBLE END AS temperature,
       CASE WHEN k % 5 <> 0 THEN value + 40 END AS heartrate, CASE WHEN k % 7 <> 0 THEN (k % 30)::DOUBLE END AS resprate,
       (90 + k % 10)::DOUBLE AS o2sat, CASE WHEN k % 6 <> 0 THEN value + 60 END AS sbp,
       CASE WHEN k % 6 <> 1 THEN value + 30 END AS dbp, CASE WHEN k % 9 <> 0 THEN (k % 10)::VARCHAR END AS pain,
       k % 5 + 1 AS acuity, 'complaint ' || (k % 11) AS chiefcomplaint
FROM ev WHERE event_type = 'signup' AND k % 4 <> 0"""
CTE["vitals"] = """
SELECT stay_id, ts AS charttime, CASE WHEN event_type = 'view' THEN 94.0::DOUBLE + k / 10.0::DOUBLE END AS temperature,
       CASE WHEN event_type = 'view' THEN value END AS heartrate, CASE WHEN event_type = 'view' THEN (k % 40)::DOUBLE END AS resprate,
       CASE WHEN event_type = 'click' THEN (80 + k % 20)::DOUBLE END AS o2sat, CASE WHEN event_type = 'click' THEN value END AS sbp,
       CASE WHEN event_type = 'click' THEN k::DOUBLE END AS dbp
FROM facts WHERE event_type IN ('view', 'click')"""
CTE["medications"] = "SELECT stay_id, ts AS charttime FROM facts WHERE event_type = 'click' AND k % 3 = 0"
CTE["admissions"] = """
SELECT user_id AS subject_id, CASE WHEN value >= 10 THEN event_id END AS hadm_id, ts + to_hours(k % 5 - 2) AS admittime,
       CASE WHEN k % 9 = 0 THEN ts + to_hours(k * 3 - 20) END AS deathtime
FROM ev WHERE event_type = 'signup' AND (value >= 10 OR k % 7 = 0)"""
CTE["lab_dict"] = f"SELECT DISTINCT k AS itemid, ({_list(B.LAB_LABELS)})[k % {len(B.LAB_LABELS)} + 1] AS label FROM ev"
CTE["labs"] = """
SELECT hadm_id, k AS itemid, ts AS charttime, value - 5 AS valuenum FROM facts WHERE event_type IN ('error', 'purchase', 'view')"""
CTE["item_dict"] = f"SELECT DISTINCT k AS itemid, ({_list(B.ITEM_LABELS)})[k % {len(B.ITEM_LABELS)} + 1] AS label FROM ev"
CTE["dx_dict"] = "SELECT DISTINCT 'I' || lpad(k::VARCHAR, 2, '0') AS icd_code, 'diagnosis ' || (k % 6) AS long_title FROM ev"
CTE["dx"] = "SELECT hadm_id, 'I' || lpad(k::VARCHAR, 2, '0') AS icd_code FROM facts WHERE event_type = 'purchase'"
CTE["px_dict"] = "SELECT DISTINCT '02' || lpad(k::VARCHAR, 2, '0') AS icd_code, 'procedure ' || (k % 6) AS long_title FROM ev"
CTE["px"] = "SELECT hadm_id, '02' || lpad(k::VARCHAR, 2, '0') AS icd_code FROM facts WHERE event_type = 'error'"
CTE["dx_hits"] = """
SELECT d.hadm_id, 'ACS' AS event_type, c.long_title FROM dx d JOIN dx_dict c USING (icd_code)
WHERE icd_code LIKE 'I21%' OR icd_code LIKE 'I22%' OR icd_code IN ('I24.0', 'I20.0')
UNION ALL
SELECT d.hadm_id, 'CARDIAC_ARREST', c.long_title FROM dx d JOIN dx_dict c USING (icd_code) WHERE icd_code LIKE 'I46%'"""
CTE["px_hits"] = """
SELECT d.hadm_id, 'PCI' AS event_type, c.long_title FROM px d JOIN px_dict c USING (icd_code) WHERE icd_code LIKE '0270%'
UNION ALL
SELECT d.hadm_id, 'CABG', c.long_title FROM px d JOIN px_dict c USING (icd_code) WHERE icd_code LIKE '021%'"""
_IN7 = "BETWEEN b.ed_intime AND b.ed_outtime + INTERVAL 7 DAY"
CTE["item_hits"] = f"""
SELECT 'PRESSOR_START' AS event_type, 'icu.inputevents' AS source_table, f.hadm_id, f.ts AS t, d.label
FROM facts f JOIN item_dict d ON f.k = d.itemid
WHERE f.event_type = 'purchase' AND f.value - 15 > 0 AND {_like('d.label', R.PRESSOR_WORDS)}
UNION
SELECT 'VENT_START', 'icu.procedureevents+chartevents', f.hadm_id, f.ts, d.label FROM facts f JOIN item_dict d ON f.k = d.itemid
WHERE (f.event_type = 'error' AND {_like('d.label', R.VENT_PROCEDURE_WORDS)})
   OR (f.event_type = 'view' AND f.value >= 20 AND {_like('d.label', R.VENT_CHART_WORDS)})
UNION
SELECT 'RRT_START', 'icu.procedureevents+chartevents', f.hadm_id, f.ts, d.label FROM facts f JOIN item_dict d ON f.k = d.itemid
WHERE (f.event_type = 'error' AND {_like('d.label', R.RRT_PROCEDURE_WORDS)})
   OR (f.event_type = 'view' AND f.value >= 20 AND {_like('d.label', R.RRT_CHART_WORDS)})"""
CTE["evlog"] = f"""
SELECT b.subject_id, b.stay_id, b.hadm_id, 'ICU_ADMIT' AS event_type, f.ts AS event_time, 'exact' AS event_time_type,
       'icu.icustays' AS source_table, 'Unit ' || (f.k % 3) AS event_detail
FROM cohort b JOIN facts f ON b.hadm_id = f.hadm_id WHERE f.event_type = 'error' AND f.k % 4 = 0 AND f.ts {_IN7}
UNION ALL
SELECT b.subject_id, b.stay_id, b.hadm_id, h.event_type, min(h.t), 'exact', h.source_table, string_agg(DISTINCT h.label, '; ' ORDER BY h.label)
FROM cohort b JOIN item_hits h ON b.hadm_id = h.hadm_id WHERE h.t {_IN7} GROUP BY ALL
UNION ALL
SELECT b.subject_id, b.stay_id, b.hadm_id, h.event_type, NULL, 'none', 'hosp.diagnoses_icd (hospitalization-level)',
       string_agg(DISTINCT h.long_title, '; ' ORDER BY h.long_title)
FROM cohort b JOIN dx_hits h ON b.hadm_id = h.hadm_id GROUP BY b.subject_id, b.stay_id, b.hadm_id, h.event_type
UNION ALL
SELECT b.subject_id, b.stay_id, b.hadm_id, h.event_type, NULL, 'none', 'hosp.procedures_icd (hospitalization-level)',
       string_agg(DISTINCT h.long_title, '; ' ORDER BY h.long_title)
FROM cohort b JOIN px_hits h ON b.hadm_id = h.hadm_id GROUP BY b.subject_id, b.stay_id, b.hadm_id, h.event_type
UNION ALL
SELECT b.subject_id, b.stay_id, b.hadm_id, 'DEATH', a.deathtime, 'exact', 'hosp.admissions.deathtime', 'In-hospital death'
FROM cohort b JOIN admissions a ON b.hadm_id = a.hadm_id WHERE a.deathtime >= b.ed_intime"""

_TYPES = "(" + ", ".join(f"'{t}'" for t in R.TIMED_EVENTS.values()) + ")"


def _label_ctes() -> None:
    CTE["timed"] = f"""
SELECT e.stay_id, e.event_type, {hours('b.ed_intime', 'e.event_time')} AS h FROM evlog e JOIN cohort b USING (stay_id)
WHERE e.event_time BETWEEN b.ed_intime AND b.ed_intime + INTERVAL 30 DAY"""
    aggs = [
        "max(CASE WHEN event_type = 'DEATH' THEN 1 ELSE 0 END) AS death_hosp",
        "min(CASE WHEN event_type = 'ICU_ADMIT' THEN h END) AS time_to_icu",
        "min(CASE WHEN event_type = 'DEATH' THEN h END) AS time_to_death",
        f"min(CASE WHEN event_type IN {_TYPES} THEN h END) AS time_to_deterioration",
    ]
    flags = []
    for r in R.LABEL_RULES:
        for hz in r.horizons:
            for p in R.PREDICTION_HOURS:
                name = f"{r.name}_{hz}h_from_w{p}"
                flags.append(name)
                aggs.append(f"max(CASE WHEN event_type = '{r.event_type}' AND h > {p} AND h <= {p + hz} THEN 1 ELSE 0 END) AS {name}")
    by = []
    for n, cond in [*[(n, f"= '{t}'") for n, t in R.TIMED_EVENTS.items()], ("deterioration", f"IN {_TYPES}")]:
        for p in R.PREDICTION_HOURS:
            by.append(f"event_by_{n}_w{p}")
            aggs.append(f"max(CASE WHEN event_type {cond} AND h <= {p} THEN 1 ELSE 0 END) AS event_by_{n}_w{p}")
    CTE["timed_agg"] = "SELECT stay_id, " + ",\n".join(aggs) + " FROM timed GROUP BY stay_id"
    hosp = {"cardiac_arrest_hosp": "('CARDIAC_ARREST')", "acs_hosp": "('ACS')", "revasc_hosp": "('PCI', 'CABG')",
            "pci_hosp": "('PCI')", "cabg_hosp": "('CABG')"}
    CTE["untimed_agg"] = (
        "SELECT stay_id, " + ", ".join(f"max(CASE WHEN event_type IN {v} THEN 1 ELSE 0 END) AS {n}" for n, v in hosp.items())
        + " FROM evlog WHERE event_time IS NULL GROUP BY stay_id"
    )
    zero = lambda n: f"coalesce({n}, 0) AS {n}"
    comp = []
    for c in R.COMPOSITE_RULES:
        for p in R.PREDICTION_HOURS:
            any_of = " OR ".join(f"coalesce({e}_{hz}h_from_w{p}, 0) = 1" for e, hz in c.members)
            comp.append(f"CASE WHEN {any_of} THEN 1 ELSE 0 END AS deterioration_{c.horizon}h_from_w{p}")
    CTE["labels"] = f"""
SELECT b.stay_id, b.subject_id, b.hadm_id, b.ed_intime, b.ed_outtime, {', '.join(zero(n) for n in ['death_hosp', *hosp])},
       CASE WHEN coalesce(acs_hosp, 0) = 1 OR coalesce(revasc_hosp, 0) = 1 THEN 1 ELSE 0 END AS coronary_event_hosp,
       time_to_icu, time_to_death, time_to_deterioration, {', '.join(zero(n) for n in flags)}, {', '.join(comp)},
       {', '.join(zero(n) for n in by)}
FROM cohort b LEFT JOIN timed_agg USING (stay_id) LEFT JOIN untimed_agg USING (stay_id)"""


_label_ctes()
TIME_COLS = ["time_to_icu", "time_to_death", "time_to_deterioration"]

# --- windows -------------------------------------------------------------------------
_DEMO = "e.age_at_ed, e.gender, e.arrival_transport, e.race"
_CASES = " ".join(f"WHEN {_like('label', words)} THEN '{name}'" for name, words in R.LAB_CLASSES)
CTE["lab_items"] = f"""
SELECT * FROM (SELECT itemid, CASE {_CASES} END AS lab_type, CASE WHEN itemid IN ({', '.join(map(str, B.HS_ITEMS))}) THEN 1 ELSE 0 END AS hs
FROM lab_dict) WHERE lab_type IS NOT NULL"""
CTE["lab_vals"] = "SELECT l.hadm_id, l.charttime, l.valuenum, i.lab_type, i.hs FROM labs l JOIN lab_items i USING (itemid) WHERE l.valuenum > 0"
CTE["history"] = """
SELECT b.stay_id,
  (SELECT count(DISTINCT a.hadm_id) FROM admissions a WHERE a.subject_id = b.subject_id AND a.hadm_id <> b.hadm_id
     AND a.admittime >= b.ed_intime - INTERVAL 1 YEAR AND a.admittime < b.ed_intime) AS prev_admits_1yr,
  (SELECT count(DISTINCT s.stay_id) FROM stays s WHERE s.subject_id = b.subject_id AND s.stay_id <> b.stay_id
     AND s.intime >= b.ed_intime - INTERVAL 1 YEAR AND s.intime < b.ed_intime) AS prev_ed_visits_1yr
FROM cohort b"""
for _w, _p in (("w1", 1), ("w6", 6), ("w24", 24)):
    CTE[f"ends_{_w}"] = f"SELECT *, least(ed_outtime, ed_intime + INTERVAL {_p} HOUR) AS t_end FROM cohort"
    _cut = "ed_intime + to_microseconds(round(time_to_deterioration * 3.6e9)::BIGINT)"
    _lab = "(SELECT stay_id, time_to_deterioration FROM labels)"
    CTE[f"ends_{_w}t"] = f"SELECT b.*, least(ed_outtime, ed_intime + INTERVAL {_p} HOUR, {_cut}) AS t_end FROM cohort b JOIN {_lab} USING (stay_id)"
    CTE[f"ends_{_w}p"] = f"SELECT b.*, least(ed_intime + INTERVAL {_p} HOUR, {_cut}) AS t_end FROM cohort b JOIN {_lab} USING (stay_id)"

_FN = {"min": "min", "max": "max", "mean": "avg", "std": "stddev_samp"}


def _basket(name: str, spec: R.WindowSpec, ends: str, parity: bool = False) -> None:
    w = spec.suffix
    stats = [f"{_FN[st]}(v.{R.VITAL_COLUMNS[v]}) AS {v}_{st}_{w}" for v, sts in spec.vitals for st in sts]
    CTE[f"vit_{name}"] = f"""
SELECT v.stay_id, {', '.join(stats)}, count(*) AS n_vitalsign_measurements_{w}
FROM vitals v JOIN {ends} e ON v.stay_id = e.stay_id WHERE v.charttime BETWEEN e.ed_intime AND e.t_end GROUP BY v.stay_id"""
    classes = "(" + ", ".join(f"'{c}'" for c in spec.labs_first) + ")"
    order = "ORDER BY l.charttime, l.valuenum, l.hs"
    if parity:
        CTE[f"lraw_{name}"] = f"""
SELECT e.stay_id, e.ed_intime, l.* FROM (SELECT l.*, row_number() OVER (PARTITION BY l.hadm_id, l.lab_type {order}) AS rn
FROM lab_vals l WHERE l.lab_type IN {classes}) l JOIN {ends} e ON l.hadm_id = e.hadm_id WHERE l.charttime BETWEEN e.ed_intime AND e.t_end"""
    else:
        CTE[f"lraw_{name}"] = f"""
SELECT e.stay_id, e.ed_intime, l.*, row_number() OVER (PARTITION BY e.stay_id, l.lab_type {order}) AS rn
FROM lab_vals l JOIN {ends} e ON l.hadm_id = e.hadm_id WHERE l.charttime BETWEEN e.ed_intime AND e.t_end AND l.lab_type IN {classes}"""
    first = []
    for c in spec.labs_first:
        first.append(f"max(CASE WHEN lab_type = '{c}' AND rn = 1 THEN valuenum END) AS {c}_first_{w}")
        if c == "troponin":
            first.append(f"max(CASE WHEN lab_type = 'troponin' AND rn = 1 THEN hs END) AS is_hs_troponin_{w}")
    first += [f"max(CASE WHEN lab_type = '{c}' THEN valuenum END) AS {c}_max_{w}" for c in spec.labs_max]
    CTE[f"lab_{name}"] = f"SELECT stay_id, {', '.join(first)}, {hours('min(ed_intime)', 'min(charttime)')} AS time_to_first_lab_hours FROM lraw_{name} GROUP BY stay_id"
    CTE[f"med_{name}"] = f"""
SELECT e.stay_id, {hours('min(e.ed_intime)', 'min(m.charttime)')} AS time_to_first_med_hours
FROM {ends} e JOIN medications m ON m.stay_id = e.stay_id WHERE m.charttime BETWEEN e.ed_intime AND e.t_end GROUP BY e.stay_id"""
    vit = [f"vs.{v}_{st}_{w}" for v, sts in spec.vitals for st in sts]
    labs = []
    for c in spec.labs_first:
        labs.append(f"ls.{c}_first_{w}")
        if c == "troponin":
            labs.append(f"ls.is_hs_troponin_{w}")
    labs += [f"ls.{c}_max_{w}" for c in spec.labs_max]
    extra = []
    if spec.trend:
        extra += [f"CASE WHEN vs.sbp_max_{w} > 0 THEN vs.sbp_std_{w} / vs.sbp_mean_{w} END AS sbp_cv_{w}",
                  f"vs.hr_max_{w} - vs.hr_min_{w} AS hr_range_{w}"]
    if spec.lab_derived:
        extra += [f"CASE WHEN ls.creatinine_first_{w} > 0 THEN ls.bun_first_{w} / ls.creatinine_first_{w} END AS bun_creatinine_ratio",
                  f"ls.lactate_max_{w} - ls.lactate_first_{w} AS lactate_delta_{w}"]
    extra += [f"CASE WHEN ls.{c}_first_{w} IS NULL THEN 1 ELSE 0 END AS missing_{c}_{w}" for c in spec.lab_missing]
    CTE[f"features_{name}"] = f"""
SELECT e.stay_id, {_DEMO}, {', '.join(vit)}, coalesce(vs.n_vitalsign_measurements_{w}, 0) AS n_vitalsign_measurements_{w},
       t.chiefcomplaint, {', '.join(labs)}, e.ed_los_hours, ls.time_to_first_lab_hours, m.time_to_first_med_hours,
       h.prev_admits_1yr, h.prev_ed_visits_1yr, {', '.join(extra)}
FROM {ends} e LEFT JOIN vit_{name} vs ON vs.stay_id = e.stay_id LEFT JOIN triage t ON t.stay_id = e.stay_id
LEFT JOIN lab_{name} ls ON ls.stay_id = e.stay_id LEFT JOIN med_{name} m ON m.stay_id = e.stay_id
LEFT JOIN history h ON h.stay_id = e.stay_id"""


_V = ("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp")
_FIRST = ", ".join(f"v.{c} NULLS FIRST" for c in _V)
_PICK = {s: f"coalesce(t.{c}, fv.{c})" for s, c in R.VITAL_COLUMNS.items()}
CTE["first_vitals"] = f"""
SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY v.stay_id ORDER BY v.charttime, {_FIRST}) AS rn FROM vitals v
JOIN ends_w1 e ON v.stay_id = e.stay_id WHERE v.charttime BETWEEN e.ed_intime AND e.t_end) WHERE rn = 1"""
CTE["features_w1"] = f"""
SELECT e.stay_id, {_DEMO}, t.chiefcomplaint, {', '.join(f'{_PICK[s]} AS {s}_w1' for s in ('temp', 'hr', 'rr', 'spo2', 'sbp', 'dbp'))},
       t.pain AS triage_pain, t.acuity AS triage_acuity,
       CASE WHEN {_PICK['sbp']} > 0 THEN {_PICK['hr']} / {_PICK['sbp']} END AS shock_index_w1,
       ({_PICK['sbp']} + 2 * {_PICK['dbp']}) / 3 AS map_w1,
       {', '.join(f'CASE WHEN {_PICK[s]} IS NULL THEN 1 ELSE 0 END AS missing_{s}_w1' for s in ('temp', 'hr', 'sbp'))}
FROM ends_w1 e LEFT JOIN triage t ON t.stay_id = e.stay_id LEFT JOIN first_vitals fv ON fv.stay_id = e.stay_id"""
for _n, _s in (("w6", R.W6), ("w24", R.W24)):
    _basket(_n, _s, f"ends_{_n}")
    _basket(f"{_n}t", _s, f"ends_{_n}t")
    _basket(f"{_n}p", _s, f"ends_{_n}p", parity=True)

CTE["ecg_meas"] = """
SELECT event_id AS study_id, (CASE WHEN k % 7 <> 0 THEN k * 10 WHEN k % 2 = 0 THEN 0 END)::FLOAT AS rr_interval,
       (CASE WHEN k % 5 <> 0 THEN k + 20 END)::FLOAT AS p_onset, (k + 60)::FLOAT AS p_end,
       (CASE WHEN k % 6 <> 0 THEN k + 80 END)::FLOAT AS qrs_onset, (k + 170)::FLOAT AS qrs_end, (k + 480)::FLOAT AS t_end,
       (k - 30)::FLOAT AS p_axis, (k - 45)::FLOAT AS qrs_axis, (k - 10)::FLOAT AS t_axis
FROM ev WHERE event_type = 'purchase' AND k % 8 <> 0"""
for _w in ("w1", "w6"):
    CTE[f"ecg_{_w}"] = f"""
SELECT e.stay_id, f.event_id AS ecg_study_id_{_w}, f.ts AS ecg_time_{_w}, {hours('e.ed_intime', 'f.ts')} AS ecg_hours_from_ed_{_w},
       CASE WHEN m.rr_interval > 0 THEN 60000.0 / m.rr_interval::DOUBLE END AS ecg_hr_{_w}, m.rr_interval AS ecg_rr_interval_{_w},
       m.qrs_end - m.qrs_onset AS ecg_qrs_dur_{_w}, m.qrs_onset - m.p_onset AS ecg_pr_{_w}, m.t_end - m.qrs_onset AS ecg_qt_{_w},
       {', '.join(f'm.{c} AS ecg_{c}_{_w}' for c in ('p_onset', 'p_end', 'qrs_onset', 'qrs_end', 't_end', 'p_axis', 'qrs_axis', 't_axis'))},
       CASE WHEN f.event_id IS NULL THEN 1 ELSE 0 END AS missing_ecg_{_w}
FROM ends_{_w} e LEFT JOIN (
  SELECT * FROM (SELECT b.stay_id, p.event_id, p.ts, row_number() OVER (PARTITION BY b.stay_id ORDER BY p.ts, p.event_id) AS rn
  FROM ends_{_w} b JOIN ev p ON p.user_id = b.subject_id AND p.event_type = 'purchase' AND p.ts BETWEEN b.ed_intime AND b.t_end) WHERE rn = 1
) f ON f.stay_id = e.stay_id LEFT JOIN ecg_meas m ON m.study_id = f.event_id"""


def q(select: str, *roots: str) -> str:
    """Prefix the SELECT with the WITH parts it needs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in needed and _mentions(text, name):
                visit(CTE[name])
                if name not in needed:
                    needed.append(name)

    if select.strip().upper().startswith("WITH"):
        select = f"SELECT * FROM ({select})"
    visit(select)
    if not needed:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in needed) + "\n" + select


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"(?<![\w.'])(?:FROM|JOIN)\s+{name}\b|,\s*{name}\s+[a-z]\b", text) is not None


def doubles_of(spec: R.WindowSpec) -> list[str]:
    """Computed double columns of a basket that need rounding."""
    w = spec.suffix
    out = [f"{v}_{st}_{w}" for v, sts in spec.vitals for st in sts]
    out += [f"{c}_first_{w}" for c in spec.labs_first] + [f"{c}_max_{w}" for c in spec.labs_max]
    out += ["ed_los_hours", "time_to_first_lab_hours", "time_to_first_med_hours"]
    out += [f"sbp_cv_{w}", f"hr_range_{w}"] if spec.trend else []
    out += ["bun_creatinine_ratio", f"lactate_delta_{w}"] if spec.lab_derived else []
    return out


W1_DOUBLES = [*[f"{s}_w1" for s in ("temp", "hr", "rr", "spo2", "sbp", "dbp")], "shock_index_w1", "map_w1"]


def ecg_doubles(w: str) -> list[str]:
    return [f"ecg_{c}_{w}" for c in ("hours_from_ed", "hr", "rr_interval", "qrs_dur", "pr", "qt", "p_onset", "p_end", "qrs_onset",
                                      "qrs_end", "t_end", "p_axis", "qrs_axis", "t_axis")]
