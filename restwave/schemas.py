"""Stored tables, landed payloads and smoothing catalogue."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restwave.functions import month_of

PART = "part"
ACTIVITY_BUCKETS = 64
# Stored beside every row and hidden from readers: how a loaded row ranks among writes of its key
# (`upsert.VERSION`), and whether it only marks a fetched day.
HIDDEN = "_rank int, _batch bigint, _asked date, _entry int, _item int, _hidden boolean"


@dataclass(frozen=True)
class Table:
    """A stored table.

    `part` is derived from the key, so a key can only live in one partition and an upsert is
    exact after reading just the partitions its batch touches.
    """

    name: str
    model: str
    kind: str  # daily | intraday | activity | sets
    columns: str
    keys: tuple[str, ...]
    unique: bool = True
    not_null: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(f"id bigint, user_id string, {self.columns}")

    @property
    def stored_schema(self) -> T.StructType:
        return T.StructType.fromDDL(f"id bigint, user_id string, {self.columns}, {HIDDEN}, {PART} string")

    def part(self) -> Column:
        if self.kind == "daily":
            return month_of("date")
        if self.kind == "intraday":
            return month_of("date_time_utc")
        return F.format_string("%02d", F.pmod(F.xxhash64("user_id", "activityId"), F.lit(ACTIVITY_BUCKETS)))


def _doubles(names: str) -> str:
    return ", ".join(f"{n} double" for n in names.split())


def _daily(name: str, model: str, columns: str) -> Table:
    return Table(name, model, "daily", f"date date, {columns}, date_pulled date",
                 ("user_id", "date"), not_null=("user_id", "date"))


def _intraday(name: str, model: str, columns: str) -> Table:
    return Table(name, model, "intraday",
                 f"query_date date, date_time_utc timestamp, {columns}, date_pulled date, pull_status string",
                 ("user_id", "date_time_utc"), not_null=("user_id", "query_date", "date_time_utc"))


# Table, model and column names.
TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        _daily("health_stats", "HealthStats",
               _doubles("weight bmi body_fat body_water bone_mass muscle_mass fat_mass")),
        _daily("steps", "Steps", _doubles("step_goal total_steps total_distance")),
        _daily("sleep", "Sleep",
               _doubles("rem_time resting_hr local_sleep_start_time local_sleep_time_end "
                        "gmt_sleep_start_time gmt_sleep_end_time total_sleep_time deep_time "
                        "awake_time light_time")
               + ", sleep_score_quality string, "
               + _doubles("respiration spo2")
               + ", hrv_status string, "
               + _doubles("sleep_need body_battery_change skin_temp_f skin_temp_c hrv_7d_average "
                          "sleep_score")),
        _daily("stress", "Stress",
               _doubles("high_stress_duration low_stress_duration overall_stress_level "
                        "rest_stress_duration")),
        _daily("body_battery", "BodyBattery", _doubles("low_body_battery high_body_battery")),
        _daily("heart_rate", "HeartRate",
               _doubles("resting_hr wellness_max_avg_hr wellness_min_avg_hr")),
        _intraday("heart_rate_detailed", "HeartRateDetailed", "timestamp double, hr double"),
        _intraday("spo2_detailed", "SpO2Detailed",
                  "timestamp double, spo2_level double, monitoring_environment_level double"),
        _intraday("steps_detailed", "StepsDetailed",
                  "start_gmt date, end_gmt date, steps double, pushes double, "
                  "primary_activity_level string, activity_level_constant string"),
        _intraday("respiration_detailed", "RespirationDetailed",
                  "timestamp double, respiration double"),
        Table("activities", "Activity", "activity",
              "activityId string, activityName string, activityType string, date date, "
              "startTime string, "
              + _doubles("distance duration elapsedDuration movingDuration averageSpeed calories "
                         "bmrCalories averageHR maxHR steps waterEstimated aerobicTrainingEffect "
                         "anaerobicTrainingEffect activityTrainingLoad moderateIntensityMinutes "
                         "vigorousIntensityMinutes differenceBodyBattery hrTimeInZone_1 "
                         "hrTimeInZone_2 hrTimeInZone_3 hrTimeInZone_4 hrTimeInZone_5")
              + ", detailsPulled boolean",
              ("user_id", "activityId"), not_null=("user_id", "activityId")),
        Table("strength", "StrengthActivity", "sets",
              "activityId string, date date, time string, exerciseType string, "
              "exerciseName string, exerciseProbability string, setType string, reps int, "
              "weight int, duration double",
              ("user_id", "activityId"), unique=False, not_null=("user_id", "activityId")),
    )
}

# Activity types that share the activities table.
ACTIVITY_TYPES = (
    "strength", "bouldering", "cycling", "running", "indoor_cycling", "hiking", "lap_swimming",
    "volleyball", "rock_climbing", "hiit", "pickleball", "tennis", "indoor_running",
    "open_water_swimming",
)

# Load order.
UPDATE_ORDER = (
    "HealthStats", "Steps", "Sleep", "Stress", "BodyBattery", "HeartRate",
    "HeartRateDetailed", "SpO2Detailed", "StepsDetailed", "RespirationDetailed",
)


@dataclass(frozen=True)
class DailyPayload:
    """Where one daily metric sits in its response body."""

    path: str | None
    date_field: str
    values_field: str
    mapping: dict[str, str]
    text: frozenset[str] = field(default_factory=frozenset)
    weigh_ins: bool = False

    def _fields(self) -> str:
        return ", ".join(f"`{k}`: {'string' if k in self.text else 'double'}" for k in self.mapping)

    @property
    def measures(self) -> str:
        return f"array<struct<{self._fields()}>>"

    @property
    def body(self) -> str:
        # The values member is kept as JSON text, as it may be an object, a list or absent.
        entry = (f"array<struct<`{self.date_field}`: string, `{self.values_field}`: string, "
                 f"{self._fields()}>>")
        return f"struct<`{self.path}`: {entry}>" if self.path else entry


@dataclass(frozen=True)
class DescriptorPayload:
    """An intraday response whose rows are positional, named by a descriptor list."""

    mapping: dict[str, str]
    available: str
    descriptors: str
    values: str
    index_field: str = "index"
    key_field: str = "key"

    @property
    def body(self) -> str:
        return (f"struct<`{self.available}`: double, "
                f"`{self.descriptors}`: array<struct<`{self.key_field}`: string, "
                f"`{self.index_field}`: int>>, `{self.values}`: array<array<double>>, `_corrupt`: string>")


@dataclass(frozen=True)
class FlatPayload:
    """An intraday response that is a plain list of objects."""

    mapping: dict[str, str]
    available: str
    start: str
    text: frozenset[str]

    @property
    def body(self) -> str:
        fields = ", ".join(f"`{k}`: {'string' if k in self.text else 'double'}" for k in self.mapping)
        return f"array<struct<{fields}>>"


# Response paths and field names of the daily metrics.
DAILY_PAYLOADS: dict[str, DailyPayload] = {
    "health_stats": DailyPayload(
        "dailyWeightSummaries", "summaryDate", "allWeightMetrics",
        {"weight": "weight", "bmi": "bmi", "bodyFat": "body_fat", "bodyWater": "body_water",
         "boneMass": "bone_mass", "muscleMass": "muscle_mass"}, weigh_ins=True),
    "steps": DailyPayload(
        "values", "calendarDate", "values",
        {"stepGoal": "step_goal", "totalSteps": "total_steps", "totalDistance": "total_distance"}),
    "sleep": DailyPayload(
        "individualStats", "calendarDate", "values",
        {"remTime": "rem_time", "restingHeartRate": "resting_hr",
         "localSleepStartTimeInMillis": "local_sleep_start_time",
         "localSleepEndTimeInMillis": "local_sleep_time_end",
         "gmtSleepStartTimeInMillis": "gmt_sleep_start_time",
         "gmtSleepEndTimeInMillis": "gmt_sleep_end_time",
         "totalSleepTimeInSeconds": "total_sleep_time", "deepTime": "deep_time",
         "awakeTime": "awake_time", "lightTime": "light_time",
         "sleepScoreQuality": "sleep_score_quality", "respiration": "respiration",
         "spO2": "spo2", "hrvStatus": "hrv_status", "sleepNeed": "sleep_need",
         "bodyBatteryChange": "body_battery_change", "skinTempF": "skin_temp_f",
         "skinTempC": "skin_temp_c", "hrv7dAverage": "hrv_7d_average",
         "sleepScore": "sleep_score"},
        text=frozenset({"sleepScoreQuality", "hrvStatus"})),
    "heart_rate": DailyPayload(
        None, "calendarDate", "values",
        {"restingHR": "resting_hr", "wellnessMaxAvgHR": "wellness_max_avg_hr",
         "wellnessMinAvgHR": "wellness_min_avg_hr"}),
    "stress": DailyPayload(
        None, "calendarDate", "values",
        {"highStressDuration": "high_stress_duration", "lowStressDuration": "low_stress_duration",
         "overallStressLevel": "overall_stress_level",
         "restStressDuration": "rest_stress_duration"}),
    "body_battery": DailyPayload(
        None, "calendarDate", "values",
        {"lowBodyBattery": "low_body_battery", "highBodyBattery": "high_body_battery"}),
}

# Response paths and field names of the intraday metrics.
INTRADAY_PAYLOADS: dict[str, DescriptorPayload | FlatPayload] = {
    "heart_rate_detailed": DescriptorPayload(
        {"timestamp": "timestamp", "heartrate": "hr"},
        "restingHeartRate", "heartRateValueDescriptors", "heartRateValues"),
    "respiration_detailed": DescriptorPayload(
        {"timestamp": "timestamp", "respiration": "respiration"},
        "lowestRespirationValue", "respirationValueDescriptorsDTOList", "respirationValuesArray"),
    "spo2_detailed": DescriptorPayload(
        {"timestamp": "timestamp", "spo2Level": "spo2_level",
         "monitoringEnvironmentLevel": "monitoring_environment_level"},
        "averageSpO2", "spO2HourlyAveragesDescriptorList", "spO2HourlyAverages",
        index_field="spo2ValueDescIndex", key_field="spo2ValueDescKey"),
    "steps_detailed": FlatPayload(
        {"startGMT": "start_gmt", "endGMT": "end_gmt", "steps": "steps", "pushes": "pushes",
         "primaryActivityLevel": "primary_activity_level",
         "activityLevelConstant": "activity_level_constant"},
        "steps", "start_gmt",
        text=frozenset({"startGMT", "endGMT", "primaryActivityLevel", "activityLevelConstant"})),
}

# The smoothed columns of every cleaned table.
SMOOTHED_COLUMNS: dict[str, tuple[str, ...]] = {
    "health_stats": ("weight", "bmi", "body_fat", "body_water", "bone_mass", "muscle_mass",
                     "fat_mass"),
    "sleep": ("resting_hr", "sleep_score", "total_sleep_time", "rem_time", "deep_time",
              "light_time", "awake_time", "sleep_start_time", "sleep_end_time", "hrv_7d_average"),
    "steps": ("step_goal", "total_steps", "total_distance"),
    "stress": ("high_stress_duration", "low_stress_duration", "overall_stress_level",
               "rest_stress_duration"),
    "heart_rate": ("resting_hr", "wellness_max_avg_hr", "wellness_min_avg_hr"),
    "body_battery": ("low_body_battery", "high_body_battery"),
}

# Kernels, bandwidths and row widths of the standard run.
KERNELS = ("gaussian", "boxcar")
BANDWIDTHS = (1, *range(7, 150, 7))
ROW_WIDTHS = (1, *range(7, 181, 7))


@dataclass(frozen=True)
class SeriesView:
    series: str
    axis: str
    axis_label: str
    legend: str


# The published series of every dashboard metric.
SERIES_VIEWS: dict[str, tuple[SeriesView, ...]] = {
    "health_stats": (
        SeriesView("weight", "default", "Weight (lb)", "Weight"),
        SeriesView("body_fat", "body_fat", "Body Fat %", "Body Fat"),
    ),
    "heart_rate": (SeriesView("resting_hr", "default", "Heart Rate (bpm)", "Resting HR"),),
    "sleep": (
        SeriesView("deep_time", "default", "Time (hours)", "Deep Sleep"),
        SeriesView("rem_time", "default", "Time (hours)", "REM Sleep"),
        SeriesView("light_time", "default", "Time (hours)", "Light Sleep"),
        SeriesView("awake_time", "default", "Time (hours)", "Awake Time"),
        SeriesView("total_sleep_time", "default", "Time (hours)", "Total Sleep Time"),
        SeriesView("sleep_score", "sleep_score", "Sleep Score", "Sleep Score"),
    ),
    "steps": (
        SeriesView("total_steps", "default", "Total Steps", "Total Steps"),
        SeriesView("step_goal", "default", "Total Steps", "Step Goal"),
        SeriesView("total_distance", "distance", "Total Distance (m)", "Total Distance"),
    ),
}
# Fixed value.
DEFAULT_SMOOTH = ("gaussian", 14)


# Metric names of the pull functions, by kind of table.
METRICS = {
    "daily": {"weight": "health_stats", "steps": "steps", "sleep": "sleep", "stress": "stress",
              "body_battery": "body_battery", "heart_rate": "heart_rate"},
    "intraday": {"heart_rate": "heart_rate_detailed", "spo2": "spo2_detailed",
                 "steps": "steps_detailed", "respiration": "respiration_detailed"},
}


def metric_table(name: str, kind: str) -> Table:
    """The daily or intraday table given by its own, its model's or its metric's name."""
    t = TABLES[METRICS[kind][name]] if name in METRICS[kind] else table(name)
    if t.kind != kind:
        raise ValueError(f"{name!r} is not a metric of {kind} tables")
    return t


def table(name: str) -> Table:
    """Look a table up by table or model name."""
    for t in TABLES.values():
        if name in (t.name, t.model):
            return t
    raise ValueError(f"no table or model named {name!r}")
