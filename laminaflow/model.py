"""Fixed values of the data model: signal dictionary, families, limits, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Signal -> semantic group used by the telemetry statistics.
SIGNAL_GROUPS = {
    "SO1": "oxygen", "SO2": "oxygen",
    "ST2": "temperature", "ST3": "temperature", "ST4": "temperature", "ST5": "temperature",
    "SP1": "pressure", "SP2": "pressure", "SP3": "pressure", "SP4": "pressure", "SP5": "pressure",
    "SP8": "pressure", "SP9": "pressure", "SP11": "pressure", "SP12": "pressure",
    "SP14": "pressure", "SP15": "pressure", "SP16": "pressure",
    "SF1": "flow",
    "ST1 (flow H)": "humidity", "Flow H": "humidity",
    "ST1 (flow T)": "temp_gas", "Flow T": "temp_gas",
    "LIR": "layer_counter",
    "BI1": "binary",
}

# Signal -> (min, max, nominal, alarm_low, alarm_high) of the machine dictionary.
SIGNAL_LIMITS = {
    "SO1": (0.0, 20.0, 0.5, None, 2.0),
    "SO2": (0.0, 20.0, 0.5, None, 2.0),
    "ST3": (0.0, 250.0, None, None, 200.0),
    "ST4": (0.0, 250.0, None, None, 200.0),
    "ST5": (0.0, 200.0, None, None, 200.0),
    "ST1 (flow T)": (-10.0, 80.0, None, None, None),
    "ST1 (flow H)": (0.0, 100.0, None, None, 40.0),
    "Flow T": (-10.0, 80.0, None, None, None),
    "Flow H": (0.0, 100.0, None, None, 40.0),
    "SP4": (0.8, 1.3, 1.0, 0.85, 1.8),
    "SF1": (0.0, 30.0, 3.0, 1.5, None),
    "LIR": (0.0, 390000.0, None, None, None),
}

# Chart group -> member signals in lookup order and the defaults used when none is set.
CHART_GROUPS = {
    "oxygen": (("SO1", "SO2"), {"alarm_high": 2.0, "max": 20.0, "nominal": 0.5, "min": 0.0}),
    "temperature": (("ST3", "ST4", "ST5"), {"alarm_high": 200.0, "max": 250.0, "min": 0.0}),
    "humidity": (("ST1 (flow H)", "Flow H"), {"alarm_high": 40.0, "max": 100.0, "min": 0.0}),
    "pressure": (("SP4",), {"alarm_high": 1.8, "alarm_low": 0.85, "nominal": 1.0, "max": 1.3, "min": 0.8}),
}

# File name pattern (glob), family, role; first match wins.
FILE_FAMILIES = [
    ("*_Monitor100.log", "monitor100_log", "primary"),
    ("*_Monitor200.log", "monitor200_log", "auxiliary"),
    ("*_stateFlow.log", "stateflow_log", "primary"),
    ("*_stateFlowData.log", "stateflowdata_log", "auxiliary"),
    ("*_burn.log", "burn_log", "primary"),
    ("*_time.log", "time_log", "secondary"),
    ("*_sensors.log", "sensors_log", "secondary"),
    ("*_error.log", "error_log", "auxiliary"),
    ("table_temp.log", "table_temp_log", "secondary"),
    ("*table*temp*.log", "table_temp_log", "secondary"),
    ("*.log", "main_event_log", "primary"),
]

# Names never ingested, and the size above which state logs are skipped.
SKIPPED_NAMES = ["*_burn.log", "*_stateFlowData.log", "table_temp.log", "._*"]

# State column prefix -> subsystem, in match order.
SUBSYSTEM_PREFIXES = [
    ("State", "automation"), ("MotorMove", "motion"), ("Failure", "failure"),
    ("LockLaser", "laser_interlock"), ("FillBunker", "powder"), ("CheckParameters", "parameter_check"),
    ("Heating", "heating"), ("Voltage", "power"), ("Chamber", "chamber"),
    ("ChamberGlove", "glove"), ("ChamberDoor", "door"),
]

# Families a complete print export holds.
EXPECTED_FAMILIES = ["main_event_log", "sensors_log", "time_log"]

# Data-quality penalty per issue kind.
QUALITY_PENALTIES = {
    "missing_log_family": 15.0, "layer_gaps": 20.0, "time_gaps": 12.0,
    "sensor_stuck": 10.0, "sensor_dropout": 10.0, "parse_warnings": 8.0,
}

# Atmosphere readiness weights.
READINESS_WEIGHTS = {"oxygen": 0.5, "pressure": 0.3, "humidity": 0.2}

# Process anomaly scan, group -> (semantic, severity).
ANOMALY_GROUPS = {
    "oxygen": ("кислород", "high"),
    "humidity": ("влажность", "medium"),
    "temperature": ("температура", "medium"),
}

# Consumable -> (label, hours until replacement, warning percent).
CONSUMABLES = {
    "recoater_blade": ("Ракель (нож)", 500.0, 80.0),
    "hepa_filter": ("HEPA-фильтр", 200.0, 85.0),
    "protective_glass": ("Защитное стекло", 500.0, 80.0),
    "laser_fiber": ("Лазерный источник", 5000.0, 90.0),
    "inert_gas_filter": ("Фильтр инертного газа", 300.0, 80.0),
}

# Operator event types that mark maintenance.
MAINTENANCE_TYPES = [
    "seal_replaced", "filter_replaced", "optics_cleaned", "recoater_adjusted", "chamber_cleaned",
    "calibration_performed", "part_accepted", "part_rejected",
]
GAS_EVENT_TYPES = ["gas_cylinder_replaced", "gas_consumption_recorded", "gas_pressure_issue"]
POWDER_EVENT_TYPES = [
    "powder_consumption_recorded", "powder_batch_changed", "powder_reused", "powder_sieved", "powder_dried",
]

# Outcome texts for the two classes.
DEFECT_RESULTS = ["rejected", "defect", "fail", "failed", "scrap", "scrapped", "брак"]
GOOD_RESULTS = ["accepted", "good", "ok", "pass", "passed", "годная", "годен"]

# Risk features and their display names.
RISK_FEATURES = {
    "readiness": "Готовность атмосферы", "anomaly_count": "Аномалии процесса",
    "burn_slope": "Дрейф времени прожига", "data_quality": "Качество данных",
    "o2_mean": "Средний O₂", "o2_std": "Нестабильность O₂",
    "duration_min": "Длительность", "layers": "Число слоёв",
}

# Preset columns that override the global machine parameters.
PRESET_COLUMNS = [
    "hatch_speed_mm_s", "contour_speed_mm_s", "hatch_distance_mm", "layer_thickness_mm",
    "jump_speed_mm_s", "jump_delay_ms",
]
REQUIRED_PARAMS = [
    "hatch_speed_mm_s", "contour_speed_mm_s", "hatch_distance_mm", "layer_thickness_mm", "laser_count",
]

PRIORITY_EVENT_TYPES = ["error", "alarm", "finish", "abort", "restart_attempt", "pause", "resume"]
REAL_PRINT_CLASSES = ["REAL_PRINT", "REAL_PRINT_WITH_RESUME"]
KG_PER_LAYER = 0.05


def signal_dimension(spark: SparkSession) -> DataFrame:
    """One row per dictionary signal: group, limits, alarm thresholds."""
    names = list(dict.fromkeys([*SIGNAL_GROUPS, *SIGNAL_LIMITS]))
    rows = [(n, SIGNAL_GROUPS.get(n), *SIGNAL_LIMITS.get(n, (None,) * 5)) for n in names]
    schema = ("signal string, group string, min_val double, max_val double, nominal double, "
              "alarm_low double, alarm_high double")
    return spark.createDataFrame(rows, schema)


def chart_thresholds(spark: SparkSession) -> DataFrame:
    """First limit set among the member signals of each chart group, else the default."""
    fields = {"min": 0, "max": 1, "nominal": 2, "alarm_low": 3, "alarm_high": 4}
    rows = []
    for group, (members, defaults) in CHART_GROUPS.items():
        found = {f: next((SIGNAL_LIMITS[m][i] for m in members if SIGNAL_LIMITS[m][i] is not None),
                         defaults.get(f)) for f, i in fields.items()}
        rows.append((group, *[found[f] for f in ("alarm_high", "alarm_low", "nominal", "min", "max")]))
    return spark.createDataFrame(
        rows, "group string, alarm_high double, alarm_low double, nominal double, min double, max double")


def consumable_dimension(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in CONSUMABLES.items()]
    return spark.createDataFrame(rows, "component string, label string, max_hours double, warn_pct double")


EVENT_SCHEMA = T.StructType([
    T.StructField("source_file_id", T.StringType()),
    T.StructField("source_line", T.LongType()),
    T.StructField("source_offset", T.LongType()),
    T.StructField("raw_excerpt", T.StringType()),
    T.StructField("line_sha", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("raw_timestamp", T.StringType()),
    T.StructField("ts_uncertainty", T.DoubleType()),
    T.StructField("layer", T.IntegerType()),
    T.StructField("subsystem", T.StringType()),
    T.StructField("phase", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
])
