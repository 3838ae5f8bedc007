"""Canonical schema of the labelled window feature files.

Fixed values: column names and types of the reference's feature files
(``<home>/<home>.ann.features.csv``), in the order recorded by its saved runs.
"""

from __future__ import annotations

from pyspark.sql.types import DataType, DoubleType, IntegerType, StringType, StructField, StructType

# The 11 sensor locations.
LOCATIONS: list[str] = ["Bathroom", "Bedroom", "Chair", "DiningRoom", "Hall", "Ignore",
                        "Kitchen", "LivingRoom", "Office", "OutsideDoor", "WorkArea"]

# The integer columns.
INT_COLUMNS: list[str] = [
    "lastSensorEventHours", "lastSensorEventSeconds", "lastSensorDayOfWeek",
    "prevDominantSensor1", "prevDominantSensor2", "lastSensorID", "lastSensorLocation",
    "lastMotionLocation", "numDistinctSensors",
]

# file order (as recorded in saved runs); the label column is read by name
# The order of the columns.
FEATURE_ORDER: list[str] = (
    ["lastSensorEventHours", "lastSensorEventSeconds", "lastSensorDayOfWeek",
     "windowDuration", "timeSinceLastSensorEvent",
     "prevDominantSensor1", "prevDominantSensor2", "lastSensorID", "lastSensorLocation",
     "lastMotionLocation", "complexity", "activityChange", "areaTransitions", "numDistinctSensors"]
    + [f"sensorCount-{loc}" for loc in LOCATIONS]
    + [f"sensorElTime-{loc}" for loc in LOCATIONS]
)

LABEL_COLUMN = "activity"
GROUP_COLUMN = "home_id"
CONSTANT_FEATURES: list[str] = ["numDistinctSensors"]

# Sentinels kept as values (never turned into NULL): trees split on them.
NO_MOTION = -1
ABSENT_ELAPSED = 86400.0
ABSENT_COUNT = 0.0


def feature_types() -> dict[str, DataType]:
    types: dict[str, DataType] = {c: (IntegerType() if c in INT_COLUMNS else DoubleType()) for c in FEATURE_ORDER}
    types[LABEL_COLUMN] = StringType()
    return types


def feature_schema(with_group: bool = True) -> StructType:
    fields = [StructField(c, t, True) for c, t in feature_types().items()]
    if with_group:
        fields.append(StructField(GROUP_COLUMN, StringType(), True))
    return StructType(fields)
