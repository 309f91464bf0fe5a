"""Clinical input tables derived from the generic test tables.

The test data has no ICU tables, so each clinical input is a projection of the
driver's ``events``, ``customer``, ``nation`` and ``part`` tables (the mapping of
FIXTURES.md section 3).  Everything is lazy DataFrame code: a stay is one user's
ten-day slice of events, vitals/labs/procedures are events with the value routed
to columns by event type.  A table's plan is built when it is first asked for, each from one list
of SQL expressions.  The DuckDB oracle SQL starts from the same mapping.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import expr, lit

from ..functions.time import micros_of
from ..schemas import INPUTS

# Fixed values of the mapping (FIXTURES.md section 3): id offsets, stay length in
# days, the modulus that blanks discharge times, and the code/item ranges.
HADM_OFFSET = 20000000
STAY_OFFSET = 30000000
DAYS_PER_STAY = 10
NO_OUTTIME_MODULUS = 13
ICD_CODE_MODULUS = 250
UNTITLED_MODULUS = 4  # codes that this divides have a title of version 10 only


#: Columns that are read of the given tables.
GIVEN = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double",
}


@dataclass
class ClinicalTables:
    """The ten clinical inputs, as lazy DataFrames."""

    icustays: DataFrame
    diagnoses_icd: DataFrame
    d_icd_diagnoses: DataFrame
    age: DataFrame
    icustay_detail: DataFrame
    vitalsign: DataFrame
    procedureevents: DataFrame
    d_items: DataFrame
    chemistry: DataFrame
    coagulation: DataFrame

    def register(self) -> "ClinicalTables":
        for name in INPUTS:
            getattr(self, name).createOrReplaceTempView(name)
        return self


def _of(kinds: str, value: str = "value", negate: bool = False) -> str:
    """``value`` of events of the kinds (or of all others), else null."""
    listed = ", ".join(f"'{k}'" for k in kinds.split())
    return f"CASE WHEN event_type {'NOT ' if negate else ''}IN ({listed}) THEN {value} END"


class SurrogateTables(ClinicalTables):
    """The clinical inputs derived from the given tables in a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return self.spark.read.schema(GIVEN[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def _conform(df: DataFrame, name: str, **columns: str) -> DataFrame:
        """The input ``name`` from SQL expressions (by default the column of the same name), cast to its schema."""
        return df.selectExpr(*[f"CAST({columns.get(f.name, f.name)} AS {f.dataType.simpleString()}) AS {f.name}" for f in INPUTS[name].fields])

    @cached_property
    def events(self) -> DataFrame:
        return self.given("events").selectExpr("event_id", "ts", "user_id", "event_type", "value",
                                               f"user_id * 10 + CAST(floor((dayofmonth(ts) - 1) / {DAYS_PER_STAY}) AS BIGINT) AS sk")

    @cached_property
    def icustays(self) -> DataFrame:
        stays = self.events.selectExpr("user_id AS subject_id", "sk", "event_type", "ts").groupBy("subject_id", "sk").agg(
            *[expr(e) for e in ("min_by(event_type, ts) AS first_careunit", "max_by(event_type, ts) AS last_careunit", "min(ts) AS t0", "max(ts) AS t1")])
        gone = f"subject_id % {NO_OUTTIME_MODULUS} = 0"
        stays = stays.withColumn("los", (micros_of("t1") - micros_of("t0") - 86_400_000_000) / lit(86_400_000_000.0))
        return self._conform(stays, "icustays", hadm_id=f"sk + {HADM_OFFSET}", stay_id=f"sk + {STAY_OFFSET}", intime="t0 + INTERVAL 12 HOURS",
                             outtime=f"CASE WHEN NOT {gone} THEN t1 - INTERVAL 12 HOURS END", los=f"CASE WHEN NOT {gone} THEN los END")

    @cached_property
    def diagnoses_icd(self) -> DataFrame:
        return self._conform(self.events.where("event_type IN ('error', 'signup')"), "diagnoses_icd", subject_id="user_id",
                             hadm_id=f"sk + {HADM_OFFSET}", seq_num="event_id", icd_code=f"event_id % {ICD_CODE_MODULUS} + 1",
                             icd_version="CASE WHEN user_id % 5 = 0 AND event_type = 'error' THEN 10 ELSE 9 END")

    @cached_property
    def d_icd_diagnoses(self) -> DataFrame:
        return self._conform(self.given("part"), "d_icd_diagnoses", icd_code="p_partkey", long_title="p_name",
                             icd_version=f"CASE WHEN p_partkey % {UNTITLED_MODULUS} = 0 THEN 10 ELSE 9 END")

    @cached_property
    def _with_nation(self) -> DataFrame:
        stays = self.icustays.select("subject_id", "hadm_id", "stay_id", "intime", "outtime")
        return stays.join(self.given("customer").selectExpr("c_custkey AS subject_id", "c_nationkey"), "subject_id")

    @cached_property
    def age(self) -> DataFrame:
        return self._conform(self._with_nation, "age", anchor_age="c_nationkey + 18")

    @cached_property
    def icustay_detail(self) -> DataFrame:
        nation = self.given("nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
        return self._conform(self._with_nation.join(nation, "c_nationkey"), "icustay_detail", race="n_name", icu_intime="intime",
                             icu_outtime="outtime", gender="CASE WHEN subject_id % 2 = 0 THEN 'M' ELSE 'F' END")

    @cached_property
    def vitalsign(self) -> DataFrame:
        return self._conform(
            self.events, "vitalsign", subject_id="user_id", stay_id=f"sk + {STAY_OFFSET}", charttime="ts",
            heart_rate=_of("click"), sbp=_of("click view"), dbp=_of("view"), mbp=_of("view error"), sbp_ni=_of("error"),
            dbp_ni=_of("error signup"), mbp_ni=_of("purchase"), resp_rate="value", spo2=_of("purchase click"), glucose=_of("signup"),
            temperature=_of("signup view", "CAST((3500 + (event_id % 70) * 10) / 100D AS DECIMAL(5, 2))"),
            temperature_site=_of("error", "event_type", negate=True))

    @cached_property
    def chemistry(self) -> DataFrame:
        return self._conform(self.events, "chemistry", subject_id="user_id", charttime="ts", bicarbonate=_of("click view"),
                             calcium=_of("view error"), sodium=_of("view", negate=True), potassium=_of("signup", negate=True))

    @cached_property
    def coagulation(self) -> DataFrame:
        return self._conform(self.events, "coagulation", subject_id="user_id", charttime="ts", d_dimer=_of("click view"),
                             fibrinogen=_of("error", negate=True), thrombin=_of("error signup"), inr=_of("click", negate=True),
                             pt=_of("view", negate=True), ptt=_of("purchase click"))

    @cached_property
    def procedureevents(self) -> DataFrame:
        third = "event_id % 3 = 0"
        return self._conform(
            self.events.where("event_type IN ('purchase', 'click')"), "procedureevents", subject_id="user_id", stay_id=f"sk + {STAY_OFFSET}",
            storetime="CASE WHEN event_id % 11 <> 0 THEN ts END", caregiver_id="event_id % 17", itemid=f"event_id % {ICD_CODE_MODULUS} + 1",
            valueuom="'mL'", location=f"CASE WHEN {third} THEN 'arm' END", locationcategory=f"CASE WHEN {third} THEN 'limb' END",
            orderid="event_id", linkorderid="event_id - event_id % 2",
            ordercategoryname=f"CASE WHEN {third} THEN 'Imaging' WHEN event_id % 3 = 1 THEN 'Ventilation' ELSE 'Lines' END",
            ordercategorydescription="'Task'", patientweight="50D + event_id % 50", isopenbag="event_id % 2", continueinnextdept="0",
            statusdescription="'FinishedRunning'", originalamount="value", originalrate="value / 2")

    @cached_property
    def d_items(self) -> DataFrame:
        return self._conform(self.given("part"), "d_items", itemid="p_partkey", label="p_name", unitname="p_brand",
                             lownormalvalue="p_size", highnormalvalue="p_retailprice")


def surrogate_tables(spark: SparkSession, sf_dir: str) -> ClinicalTables:
    """The ten clinical inputs derived from the test tables in ``sf_dir``."""
    return SurrogateTables(spark, sf_dir)
