"""Fixed values and site settings.

Everything that names a physical limit, a parameter or a feature list lives
here; the operators take these as arguments and hold none themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# --- fixed values: daily aggregation per sensor parameter -------------------
PARAM_AGGS = {
    "temperature_C": ("mean", "max", "min"),
    "temperature_max_C": ("max",),
    "temperature_min_C": ("min",),
    "temperature_ground_C": ("mean",),
    "temperature_wet_C": ("mean",),
    "relative_humidity_pct": ("mean",),
    "global_radiation_Wm2": ("mean", "sum"),
    "rainfall_mm": ("sum",),
    "wind_speed_ms": ("mean", "max"),
    "wind_speed_max1min_ms": ("max",),
    "wind_speed_max10min_ms": ("max",),
    "wind_gust_speed_ms": ("max",),
    "wind_dir_deg": ("mean",),
    "wind_gust_dir_deg": ("mean",),
    "wind_dir_std_deg": ("mean",),
}
HHMM_PARAM = "wind_speed_max10min_time"

# --- fixed values: inclusive physical limits per daily metric ----------------
PHYSICAL_BOUNDS = {
    "temperature_C_mean": (-10, 55),
    "temperature_C_max": (-5, 57),
    "temperature_C_min": (-15, 45),
    "temperature_max_C_max": (-5, 57),
    "temperature_min_C_min": (-15, 45),
    "temperature_ground_C_mean": (-10, 60),
    "temperature_wet_C_mean": (-10, 40),
    "relative_humidity_pct_mean": (0, 100),
    "rainfall_mm_sum": (0, 300),
    "wind_speed_ms_mean": (0, 25),
    "wind_speed_ms_max": (0, 40),
    "wind_speed_max1min_ms_max": (0, 45),
    "wind_speed_max10min_ms_max": (0, 40),
    "wind_gust_speed_ms_max": (0, 50),
    "global_radiation_Wm2_mean": (0, 900),
    "global_radiation_Wm2_sum": (0, 129600),
    "global_radiation_MJm2": (0, 40),
}

# --- fixed values: metrics checked for stuck sensors -------------------------
PERSISTENCE_METRICS = (
    "temperature_C_mean",
    "temperature_C_max",
    "temperature_C_min",
    "temperature_max_C_max",
    "temperature_min_C_min",
    "temperature_ground_C_mean",
    "temperature_wet_C_mean",
    "relative_humidity_pct_mean",
    "wind_speed_ms_mean",
)
PERSISTENCE_RUN = 4

SLOTS_PER_DAY = 144
COVERAGE_MIN = 0.70
IQR_MULTIPLIER = 3.0
FILL_LIMIT_DAYS = 3

# --- fixed values: unit conversions ------------------------------------------
SECONDS_PER_DAY = 86400
SECONDS_PER_SLOT = 600
KMH_PER_MS = 3.6
M3_PER_MM3 = 1e6
LAKE_AREA_KM2 = 166.0
MM_KM2_TO_MM3 = 0.001

# --- fixed values: seasonality ------------------------------------------------
RBF_CENTRES = {
    "spring_equinox": 80,
    "summer_solstice": 172,
    "autumn_equinox": 264,
    "winter_solstice": 355,
}
RBF_GAMMA = -math.log(0.05) / 45 ** 2
WINTER_MONTHS = (10, 11, 12, 1, 2, 3)
WET_MONTHS = (11, 12, 1, 2, 3)

# --- fixed values: trailing windows (days, smallest number of values) ---------
RAIN_WINDOWS = ((7, 1), (14, 1), (21, 1), (30, 10), (45, 15))
ET0_WINDOWS = ((7, 3), (14, 5))

# --- fixed values: ensemble, water balance and recession ----------------------
TMAX_CAP = 49.0
HARGREAVES_COEFF = 0.0023
INVERSE_LATENT_HEAT = 0.408
HARGREAVES_SLOPE = 1.0619
HARGREAVES_INTERCEPT = 0.8113
VOLUME_TO_LEVEL = (-3.829620769045569e-07, 0.009169651006627259, -241.43908960277244)
VOLUME_RANGE_MM3 = (2000.0, 6000.0)
RECESSION_FROM_YEAR = 2005
RECESSION_OBS_DAYS = 21
RECESSION_SCALE_RANGE = (0.45, 1.6)
RECESSION_FLAT_RATE = -1e-4
RECESSION_SLOW_FACTOR = 0.82
RECESSION_HORIZON_DAYS = 400
RECESSION_KEEP_DAYS = 25
REDLINE_HORIZONS = (30, 60, 90)
REDLINE_TEST_YEARS = tuple(range(2010, 2025))
BUCKET_S_MAX = 150.0
API_DECAY = 0.9
LEADS = (7, 14, 21, 30)
HEADLINE_LEADS = (14, 21, 30)
TRAIN_ANCHOR_STEP = 2
TEST_ANCHOR_STEP = 7
WET_DAY_MM = 1.0
MODERN_START = "2012-01-01"
OVERLAP = ("2012-01-01", "2024-12-31")
MIN_OVERLAP_ROWS = 30
SUMMARY_PERIODS = (("2010-2030", 2010, 2030), ("2030-2050", 2030, 2050),
                   ("2050-2080", 2050, 2080), ("2080-2100", 2080, 2100))
BOX_HORIZONS = (("2030", 2025, 2035), ("2050", 2045, 2055), ("2100", 2090, 2100))
LEVEL_BAND_M = 0.654 / 300
BUFFER_MM3_PER_M = 220.0

# --- fixed values: forecast folds and model settings --------------------------
HORIZONS = tuple(range(1, 8))
SEQUENCE_LENGTH = 21
CV_TEST_YEARS = (2021, 2022, 2023, 2024)
CV_TRAIN_FROM = 2012
GBT_PARAMS = {"maxDepth": 4, "stepSize": 0.03, "minInstancesPerNode": 10,
              "subsamplingRate": 0.8, "featureSubsetStrategy": "sqrt", "seed": 42}
GBT_TREES_CV = 300
GBT_TREES_FINAL = 500

# --- fixed values: feature lists -----------------------------------------------
SEASON_FEATURES = ("season_sin", "season_cos")
RBF_FEATURES = tuple(f"rbf_{name}" for name in RBF_CENTRES)
RAIN_FEATURES = tuple(f"rainfall_{n}d_mm" for n, _ in RAIN_WINDOWS)

INFLOW_WEATHER = (
    "rainfall_mm", "rainfall_lag1_mm", "rainfall_lag2_mm", "rainfall_lag3_mm",
    *RAIN_FEATURES, "moisture_balance_7d_mm", "moisture_balance_14d_mm",
    "temp_mean_C", "temp_min_C", "humidity_pct", "vpd_kPa", "et0_mm",
)
INFLOW_FEATURES = (*INFLOW_WEATHER, "inflow_lag1_m3", "inflow_lag2_m3",
                   *SEASON_FEATURES, *RBF_FEATURES, "precip_intensity_mm_hr")
INFLOW_DIRECT_FEATURES = (*INFLOW_WEATHER, "inflow_anchor_m3", "horizon_h",
                          *SEASON_FEATURES, *RBF_FEATURES, "precip_intensity_mm_hr")
INFLOW_TARGET = "inflow_m3"

VOLUME_WEATHER = (
    "predicted_inflow_m3", "rainfall_mm", "rainfall_7d_mm", "rainfall_21d_mm",
    "rainfall_30d_mm", "rainfall_45d_mm", "temp_mean_C", "temp_max_C",
    "humidity_pct", "wind_speed_ms", "vpd_kPa", "et0_mm", "et0_7d_mm",
    "radiation_MJm2", *SEASON_FEATURES, "daylength_hrs", *RBF_FEATURES,
    "precip_intensity_mm_hr",
)
VOLUME_FEATURES = (*VOLUME_WEATHER, "level_m", "volume_change_lag1_Mm3",
                   "volume_change_lag2_Mm3")
VOLUME_ANCHOR = ("level_m_anchor", "dvol_lag1_anchor", "dvol_lag2_anchor",
                 "dvol_lag3_anchor", "outflow_lag1_m3", "horizon_h")
VOLUME_DIRECT_FEATURES = (*VOLUME_WEATHER, *VOLUME_ANCHOR)
VOLUME_SINGLE_STAGE_FEATURES = tuple(
    f for f in VOLUME_DIRECT_FEATURES if f != "predicted_inflow_m3")
VOLUME_TARGET = "volume_change_Mm3"

SEQUENCE_FEATURES = (
    "temp_mean_C", "temp_max_C", "temp_min_C", "rainfall_mm", "humidity_pct",
    "wind_speed_ms", "et0_mm", "rainfall_7d_mm", "level_m", "volume_change_Mm3",
    "inflow_m3", "season_sin", "season_cos", "daylength_hrs",
)
LONGRANGE_BASE = ("horizon_h", "season_sin", "season_cos", "level_m", "rainfall_30d_mm")
LONGRANGE_TEMP = (*LONGRANGE_BASE, "mean_cloud_index", "mean_dtr",
                  "mean_tmax_anom_z", "mean_et0_hs")
LONGRANGE_BUCKET = (*LONGRANGE_TEMP, "bucket_S_anchor", "bucket_Q30_anchor")
BUCKET_FEATURES = ("bucket_S", "bucket_Q30")

FORECAST_REQUIRED = ("date", "temp_max_C", "temp_min_C", "rainfall_mm",
                     "humidity_pct", "wind_speed_ms")
FORECAST_COLUMNS = (*FORECAST_REQUIRED, "radiation_MJm2")
GOLD_TARGETS = ("level_m", "volume_Mm3", "level_change_m", "volume_change_Mm3",
                "volume_change_2d_Mm3", "volume_change_3d_Mm3")


@dataclass(frozen=True)
class SiteConfig:
    """What is particular to a lake: where it lies, its stations and its lines."""

    latitude: float = 32.82
    elevation_m: float = -212.0
    priority_station: str = "main"
    radiation_station: str = "main"
    inflow_station: str = "inflow"
    outflow_station: str = "outflow"
    lower_line_m: float = -213.0
    upper_line_m: float = -208.9
    volume_to_level: tuple[float, ...] = VOLUME_TO_LEVEL
    station_names: dict[str, str] = field(default_factory=dict)
    excluded_stations: tuple[str, ...] = ()
