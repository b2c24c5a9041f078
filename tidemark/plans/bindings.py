"""The nineteen source tables, derived from the generic ``events`` and ``customer`` tables.

Sign-ups act as stays; every other event belongs to the latest sign-up of its
user at or before it. Views and clicks are vital signs, errors and purchases are
laboratory values, items and codes. ``k`` is the number inside ``props``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ordered import last_at_or_before
from tidemark.functions.session import materialize
from tidemark.functions.timeops import add_hours
from tidemark.sources.tables import Sources, conform, read_parquet

# Labels of the item and laboratory dictionaries, taken in turn by k.
ITEM_LABELS = (
    "Norepinephrine", "Epinephrine", "Vasopressin", "Dopamine drip", "Intubation", "Invasive Ventilation",
    "Vent Mode (Hamilton)", "PEEP set", "Tidal Volume (observed)", "Dialysis - CRRT", "Hemodialysis Output",
    "CVVH filter", "Heart Rhythm", "Foley Catheter", "Pain Level", "Gauge Size",
)
LAB_LABELS = (
    "Lactate", "Troponin T", "Creatinine", "Potassium, Whole Blood", "Sodium", "Bicarbonate", "White Blood Cells",
    "Hemoglobin", "Platelet Count", "Glucose", "Urea Nitrogen", "Bilirubin, Total", "INR(PT)", "Anion Gap",
    "Calculated HCO3", "Hgb Creatinine mix",
)
HS_ITEMS = (17,)


def pick(labels: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (index % len(labels) + 1).cast("int"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return read_parquet(spark, f"{sf_dir}/events.parquet", ["event_id", "ts", "user_id", "event_type", "value", "props"]).select(
        "event_id", "ts", "user_id", "event_type", "value", k.alias("k")
    )


def stays_from(events: DataFrame) -> DataFrame:
    k, hadm = F.col("k"), F.when(F.col("value") >= 10, F.col("event_id"))
    return conform(
        events.where(F.col("event_type") == "signup").select(
            F.col("user_id").alias("subject_id"),
            F.col("event_id").alias("stay_id"),
            hadm.alias("hadm_id"),
            F.col("ts").alias("intime"),
            add_hours("ts", (k % 13).cast("double")).alias("outtime"),
            F.when(k % 2 == 0, "AMBULANCE").otherwise("WALK IN").alias("arrival_transport"),
            F.when(hadm.isNull(), "HOME").otherwise("ADMITTED").alias("disposition"),
            F.concat(F.lit("GROUP "), (k % 5).cast("string")).alias("race"),
        ),
        "stays",
    )


def admissions_from(events: DataFrame) -> DataFrame:
    """Sign-ups of some value; some of the others are admissions whose id is missing."""
    k, valued = F.col("k"), F.col("value") >= 10
    return conform(
        events.where((F.col("event_type") == "signup") & (valued | (k % 7 == 0))).select(
            F.col("user_id").alias("subject_id"), F.when(valued, F.col("event_id")).alias("hadm_id"),
            add_hours("ts", (k % 5 - 2).cast("double")).alias("admittime"),
            F.when(k % 9 == 0, add_hours("ts", (k * 3 - 20).cast("double"))).alias("deathtime"),
        ),
        "admissions",
    )


def persons_from(customers: DataFrame) -> DataFrame:
    bal = F.col("c_acctbal")
    return conform(
        customers.select(
            F.col("c_custkey").alias("subject_id"),
            (F.lit(14) + F.col("c_nationkey") * 4).alias("anchor_age"),
            (F.lit(2024) - F.col("c_custkey") % 3).alias("anchor_year"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "M").otherwise("F").alias("gender"),
            F.when(bal < 0, F.lit("2024-01-20").cast("date")).alias("dod"),
        ),
        "persons",
    )


def stays_and_persons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = read_parquet(
        spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"]
    )
    return stays_from(raw_events(spark, sf_dir)), persons_from(customers)


def ecg_tables(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Purchases act as ECG studies; one in eight has no measurements."""
    k = F.col("k")
    purchases = events.where(F.col("event_type") == "purchase")
    ids = [F.col("user_id").alias("subject_id"), F.col("event_id").alias("study_id")]
    studies = purchases.select(
        *ids, F.lit(None).alias("file_name"), F.col("ts").alias("ecg_time"), F.lit(None).alias("path")
    )
    measurements = purchases.where(k % 8 != 0).select(
        *ids,
        F.when(k % 7 != 0, k * 10).otherwise(F.when(k % 2 == 0, F.lit(0))).alias("rr_interval"),
        F.when(k % 5 != 0, k + 20).alias("p_onset"), (k + 60).alias("p_end"),
        F.when(k % 6 != 0, k + 80).alias("qrs_onset"), (k + 170).alias("qrs_end"), (k + 480).alias("t_end"),
        (k - 30).alias("p_axis"), (k - 45).alias("qrs_axis"), (k - 10).alias("t_axis"),
    )
    return conform(studies, "ecg_studies"), conform(measurements, "ecg_measurements")


def events_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """Bind all source tables. The assignment of events to stays is one ordered scan."""
    events = raw_events(spark, sf_dir)
    stays, persons = stays_and_persons(spark, sf_dir)
    others = events.where(F.col("event_type") != "signup").withColumnRenamed("user_id", "subject_id")
    assigned = last_at_or_before(others, "subject_id", "ts", stays, "intime", ["stay_id", "hadm_id"])
    # a dozen source tables read the assigned events, each only some event types
    facts = materialize(
        assigned.where(F.col("anchor").isNotNull()).select(
            "subject_id", F.col("anchor.stay_id").alias("stay_id"), F.col("anchor.hadm_id").alias("hadm_id"),
            "event_id", "ts", "event_type", "value", "k",
        ),
        partition_by=["event_type"],
    )
    k, v = F.col("k"), F.col("value")
    of = lambda *types: facts.where(F.col("event_type").isin(*types))
    view, click = F.col("event_type") == "view", F.col("event_type") == "click"
    signups = events.where(F.col("event_type") == "signup")
    ks = events.select("k").distinct()

    triage = signups.where(k % 4 != 0).select(
        F.col("event_id").alias("stay_id"),
        F.when(k % 3 != 0, F.lit(95.0) + k / 10.0).alias("temperature"),
        F.when(k % 5 != 0, v + 40).alias("heartrate"),
        F.when(k % 7 != 0, (k % 30).cast("double")).alias("resprate"),
        (F.lit(90.0) + k % 10).alias("o2sat"),
        F.when(k % 6 != 0, v + 60).alias("sbp"),
        F.when(k % 6 != 1, v + 30).alias("dbp"),
        F.when(k % 9 != 0, (k % 10).cast("string")).alias("pain"),
        (k % 5 + 1).alias("acuity"),
        F.concat(F.lit("complaint "), (k % 11).cast("string")).alias("chiefcomplaint"),
    )
    vitals = of("view", "click").select(
        "stay_id", F.col("ts").alias("charttime"),
        F.when(view, F.lit(94.0) + k / 10.0).alias("temperature"),
        F.when(view, v).alias("heartrate"),
        F.when(view, (k % 40).cast("double")).alias("resprate"),
        F.when(click, F.lit(80.0) + k % 20).alias("o2sat"),
        F.when(click, v).alias("sbp"),
        F.when(click, k.cast("double")).alias("dbp"),
    )
    ecg_studies, ecg_measurements = ecg_tables(events)
    diag = lambda c: F.concat(F.lit("I"), F.lpad(c.cast("string"), 2, "0"))
    proc = lambda c: F.concat(F.lit("02"), F.lpad(c.cast("string"), 2, "0"))
    code_table = lambda make, word: ks.select(
        make(k).alias("icd_code"), F.lit(10).alias("icd_version"), F.concat(F.lit(word), (k % 6).cast("string")).alias("long_title")
    )
    tables = {
        "stays": stays,
        "persons": persons,
        "triage": triage,
        "vitals": vitals,
        "medications": of("click").where(k % 3 == 0).select("stay_id", F.col("ts").alias("charttime")),
        "admissions": admissions_from(events),
        "lab_items": ks.select(k.alias("itemid"), pick(LAB_LABELS, k).alias("label")),
        "labs": of("error", "purchase", "view").select(
            "subject_id", "hadm_id", k.alias("itemid"), F.col("ts").alias("charttime"), (v - 5).alias("valuenum")
        ),
        "diagnosis_codes": code_table(diag, "diagnosis "),
        "diagnoses": of("purchase").select("subject_id", "hadm_id", diag(k).alias("icd_code"), F.lit(10).alias("icd_version")),
        "procedure_codes": code_table(proc, "procedure "),
        "procedures": of("error").select("subject_id", "hadm_id", proc(k).alias("icd_code"), F.lit(10).alias("icd_version")),
        "unit_stays": of("error").where(k % 4 == 0).select(
            "hadm_id", F.col("ts").alias("intime"), F.concat(F.lit("Unit "), (k % 3).cast("string")).alias("first_careunit")
        ),
        "items": ks.select(k.alias("itemid"), pick(ITEM_LABELS, k).alias("label")),
        "inputs": of("purchase").select(
            "subject_id", "hadm_id", F.col("ts").alias("starttime"), k.alias("itemid"), (v - 15).alias("amount")
        ),
        "procedure_events": of("error").select("subject_id", "hadm_id", F.col("ts").alias("starttime"), k.alias("itemid")),
        "chart_events": of("view").select(
            "subject_id", "hadm_id", F.col("ts").alias("charttime"), k.alias("itemid"),
            F.when(v >= 20, v.cast("string")).alias("value"),
        ),
        "ecg_studies": ecg_studies,
        "ecg_measurements": ecg_measurements,
    }
    return Sources(**{name: conform(df, name) for name, df in tables.items()})
