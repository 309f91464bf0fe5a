"""Input and output schemas of the clinical tables.

Inputs follow the column types declared for the read models (ids are 64-bit, so
that keys beyond two billion fit; age ``short``, temperature ``decimal(5,2)``, zone-less times ``timestamp_ntz``).
Outputs are listed in column order; ``conform`` casts and orders a DataFrame to
one of them, and ``assert_schema`` checks a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, LONG, SHORT, DOUBLE, STR = T.IntegerType(), T.LongType(), T.ShortType(), T.DoubleType(), T.StringType()
NTZ = T.TimestampNTZType()
DEC52 = T.DecimalType(5, 2)


def _st(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


VITAL_MEANS = ["heart_rate", "sbp", "dbp", "mbp", "sbp_ni", "dbp_ni", "mbp_ni",
               "resp_rate", "temperature", "spo2", "glucose"]
VITAL_COLUMNS = ["heart_rate", "sbp", "dbp", "mbp", "sbp_ni", "dbp_ni", "mbp_ni",
                 "resp_rate", "temperature", "temperature_site", "spo2", "glucose"]
CHEMISTRY_COLUMNS = ["bicarbonate", "calcium", "sodium", "potassium"]
COAGULATION_COLUMNS = ["d_dimer", "fibrinogen", "thrombin", "inr", "pt", "ptt"]

INPUTS: dict[str, T.StructType] = {
    "icustays": _st(("subject_id", LONG), ("hadm_id", LONG), ("stay_id", LONG),
                    ("first_careunit", STR), ("last_careunit", STR),
                    ("intime", NTZ), ("outtime", NTZ), ("los", DOUBLE)),
    "diagnoses_icd": _st(("subject_id", LONG), ("hadm_id", LONG), ("seq_num", LONG),
                         ("icd_code", STR), ("icd_version", INT)),
    "d_icd_diagnoses": _st(("icd_code", STR), ("icd_version", INT), ("long_title", STR)),
    "age": _st(("subject_id", LONG), ("hadm_id", LONG), ("anchor_age", SHORT)),
    "icustay_detail": _st(("stay_id", LONG), ("gender", STR), ("race", STR),
                          ("icu_intime", NTZ), ("icu_outtime", NTZ)),
    "vitalsign": _st(("subject_id", LONG), ("stay_id", LONG), ("charttime", NTZ),
                     *[(c, DEC52 if c == "temperature" else STR if c == "temperature_site" else DOUBLE)
                       for c in VITAL_COLUMNS]),
    "procedureevents": _st(("subject_id", LONG), ("stay_id", LONG), ("storetime", NTZ),
                           ("caregiver_id", INT), ("itemid", LONG), ("value", DOUBLE),
                           ("valueuom", STR), ("location", STR), ("locationcategory", STR),
                           ("orderid", LONG), ("linkorderid", LONG), ("ordercategoryname", STR),
                           ("ordercategorydescription", STR), ("patientweight", DOUBLE),
                           ("isopenbag", SHORT), ("continueinnextdept", SHORT),
                           ("statusdescription", STR), ("originalamount", DOUBLE),
                           ("originalrate", DOUBLE)),
    "d_items": _st(("itemid", LONG), ("label", STR), ("unitname", STR),
                   ("lownormalvalue", DOUBLE), ("highnormalvalue", DOUBLE)),
    "chemistry": _st(("subject_id", LONG), ("charttime", NTZ),
                     *[(c, DOUBLE) for c in CHEMISTRY_COLUMNS]),
    "coagulation": _st(("subject_id", LONG), ("charttime", NTZ),
                       *[(c, DOUBLE) for c in COAGULATION_COLUMNS]),
}

STAY_COLUMNS = ["subject_id", "hadm_id", "stay_id", "first_careunit", "last_careunit",
                "intime", "outtime", "los"]

OUTPUTS: dict[str, list[str]] = {
    "first_icu_stay": STAY_COLUMNS,
    "fis_icd9": STAY_COLUMNS + ["seq_num", "icd_code", "icd_version"],
    "fis_icd9_titled": STAY_COLUMNS + ["seq_num", "icd_code", "icd_version", "long_title"],
    "fisi9t_profile": ["subject_id", "hadm_id", "stay_id", "anchor_age", "gender", "race",
                       "first_careunit", "last_careunit", "intime", "outtime", "los",
                       "seq_num", "icd_code", "icd_version", "long_title"],
    "fisi9t_unique_patient_profile": ["subject_id", "anchor_age", "gender", "race", "hadm_id",
                                      "stay_id", "first_careunit", "last_careunit", "intime",
                                      "outtime", "los"],
    "fisi9t_vitalsign_hourly": ["subject_id", "stay_id", "charttime_hour"] + VITAL_COLUMNS,
    "fisi9t_procedureevents_hourly": [
        "subject_id", "stay_id", "charttime_hour", "charttime", "caregiver_id", "itemid",
        "item_label", "item_unitname", "item_lownormalvalue", "item_highnormalvalue",
        "value", "valueuom", "location", "locationcategory", "orderid", "linkorderid",
        "ordercategoryname", "ordercategorydescription", "patientweight", "isopenbag",
        "continueinnextdept", "statusdescription", "originalamount", "originalrate"],
    "fisi9t_chemistry_hourly": ["subject_id", "stay_id", "charttime_hour"] + CHEMISTRY_COLUMNS,
    "fisi9t_coagulation_hourly": ["subject_id", "stay_id", "charttime_hour"] + COAGULATION_COLUMNS,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, cast to its types (a projection only)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def assert_schema(df: DataFrame, table: str) -> DataFrame:
    want = OUTPUTS[table]
    if df.columns != want:
        raise AssertionError(f"{table}: columns {df.columns} != {want}")
    return df
