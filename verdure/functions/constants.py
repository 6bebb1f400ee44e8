"""Fixed values that results must agree on.

FIXED VALUES — labels, thresholds, advice texts, crop lists, filter taps and
literature comparison numbers, stated plainly and in natural order.  Nothing
here is derived; everything else in the package is computed from these.
"""

# --- FIXED VALUES: severity labels, from worst to best -----------------------
EXTREME = "Extreme Drought"
SEVERE = "Severe Drought"
MODERATE = "Moderate Drought"
MILD = "Mild Drought"
NONE = "No Drought"
SEVERITY_LABELS = [EXTREME, SEVERE, MODERATE, MILD, NONE]

# --- FIXED VALUES: VHI (0-1) thresholds; class 4 = extreme ... 0 = none -------
VHI_THRESHOLDS = [0.20, 0.35, 0.50, 0.65]
# same ladder on a 0-100 scale
VHI100_THRESHOLDS = [20.0, 35.0, 50.0, 65.0]
# risk score (0-100) ladder: >=75 extreme, >=55 severe, >=35 moderate, >=20 mild
RISK_THRESHOLDS = [75.0, 55.0, 35.0, 20.0]
HIGH_RISK = 55.0

# --- FIXED VALUES: advice text per severity ---------------------------------
RECOMMENDATIONS = {
    EXTREME: "Activate emergency irrigation scheduling, crop advisories, and local administration alerts.",
    SEVERE: "Prioritize water allocation, monitor crop stress weekly, and advise drought-tolerant practices.",
    MODERATE: "Increase field monitoring and recommend supplemental irrigation where available.",
    MILD: "Watch rainfall trends and notify farmers about early moisture stress.",
    NONE: "Continue routine monitoring.",
}

# --- FIXED VALUES: crop lists ------------------------------------------------
DRYLAND_CROPS = ["Millets", "Sorghum/Jowar", "Pearl millet/Bajra", "Pulses", "Sesame"]
MODERATE_CROPS = ["Groundnut", "Cotton", "Pigeon pea/Tur", "Chickpea", "Sunflower"]
MILD_CROPS = ["Maize", "Soybean", "Chickpea", "Mustard", "Vegetables with drip irrigation"]
NORMAL_CROPS = ["Rice", "Maize", "Wheat", "Soybean", "Vegetables"]
STATE_CROPS = {
    "Punjab": ["Wheat", "Maize", "Mustard"],
    "Haryana": ["Wheat", "Mustard", "Pearl millet/Bajra"],
    "Rajasthan": ["Pearl millet/Bajra", "Moth bean", "Cluster bean/Guar"],
    "Gujarat": ["Groundnut", "Cotton", "Castor"],
    "Maharashtra": ["Jowar", "Pigeon pea/Tur", "Cotton"],
    "Karnataka": ["Ragi", "Groundnut", "Pigeon pea/Tur"],
    "Tamil Nadu": ["Ragi", "Black gram", "Groundnut"],
    "Kerala": ["Coconut", "Tapioca", "Banana"],
    "West Bengal": ["Rice", "Jute", "Pulses"],
    "Assam": ["Rice", "Mustard", "Tea"],
}
SEVERITY_CROPS = {
    EXTREME: DRYLAND_CROPS,
    SEVERE: DRYLAND_CROPS,
    MODERATE: MODERATE_CROPS,
    MILD: MILD_CROPS,
    NONE: NORMAL_CROPS,
}
MAX_CROPS = 6

# --- FIXED VALUES: crop suitability (crop, hardy score, other score, water, reason)
CROP_SUITABILITY = [
    ("Sorghum", 91, 78, "Low", "Strong heat tolerance and low irrigation demand."),
    ("Millet", 88, 75, "Low", "Performs reliably under dry Sindh conditions."),
    ("Mung bean", 74, 84, "Medium", "Short growing cycle and useful soil nitrogen contribution."),
]
HARDY_SEVERITIES = ["severe", "severe drought", "extreme", "extreme drought"]
HARDY_RAIN_BELOW = 15.0
HARDY_TEMP_ABOVE = 39.0

# --- FIXED VALUES: advisory texts (risk >= 55 vs below) ---------------------
ADVICE_HIGH = "Use deficit irrigation and prioritize fields at flowering or grain-filling stages."
ADVICE_LOW = "Maintain scheduled irrigation and monitor soil moisture weekly."
WARNINGS_HIGH = ["High evapotranspiration may accelerate crop stress", "Rainfall deficit can reduce VHI next month"]
WARNINGS_LOW = ["Risk is manageable with normal monitoring"]
MITIGATION_TIPS = ["Mulch exposed soil", "Use drought-tolerant crop varieties", "Avoid fertilizer application during peak heat stress"]

# --- FIXED VALUES: literature comparison point -------------------------------
LITERATURE = {"r2": 0.964, "rmse": 0.021, "mae": 0.023}

# --- FIXED VALUES: evaluation protocol names and their honesty notes ---------
SAME_MONTH_PROTOCOL = "C_same_month_estimation"
PROTOCOL_NOTES = {
    "A_strict_chronological_future_forecasting": "This is strict future forecasting with no target-month VHI leakage.",
    "B_paper_comparable_random_split": "This is paper-comparable random split evaluation, not chronological deployment forecasting.",
    "C_same_month_estimation": "This is same-month VHI estimation/reconstruction, not future forecasting.",
    "D_spatial_holdout": "This is unseen grid-cell spatial holdout evaluation.",
    "E_rolling_origin_validation": "This is rolling-origin future validation averaged across folds.",
}

# --- FIXED VALUES: raw -> canonical column names ------------------------------
RENAME_MAP = {
    "system:index": "grid_id",
    "NDVI": "ndvi",
    "LST": "lst",
    "Precipitation": "rainfall",
    "Temperature": "temperature",
    "Humidity": "humidity",
    "Soil_Moisture": "soil_moisture",
    "Evapotranspiration": "evapotranspiration",
    "ET": "evapotranspiration",
    "SPEI_03_month": "spei",
}

# --- FIXED VALUES: feature export layout and fill value ----------------------
FILL_VALUE = -9999.0
SENTINELS = [-9999.0, -10272.15]
EXPORT_COLUMNS = [
    "grid_id", "longitude", "latitude", "date", "year", "month",
    "soil_moisture", "temperature", "humidity", "evapotranspiration", "wind_speed",
    "solar_radiation", "evi", "modis_ndvi", "modis_lst", "chirps_rainfall", "mndwi",
    "has_smap", "has_era5", "has_sentinel2", "has_modis", "has_chirps",
]

# --- FIXED VALUES: signal catalogues ------------------------------------------
BASE_SIGNALS = ["ndvi", "lst", "rainfall", "temperature", "humidity", "evapotranspiration",
                "soil_moisture", "vci", "tci", "vhi", "spi", "spei"]
LAGS = [1, 2, 3, 6]
ROLLING_WINDOWS = [3, 6, 12]
HORIZONS = [1, 2, 3, 6]
LEAKAGE_BLOCKED = ["target_vhi_h1", "same_month_vhi", "severity_class", "vhi_next_month", "vhi", "vci", "tci"]

# --- FIXED VALUES: Daubechies-4 decomposition low-pass taps (public filter) --
DB4_DEC_LO = [
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
]
WAVELET_WINDOW = 12

# --- FIXED VALUES: payload ranges (data-quality predicates) ------------------
PAYLOAD_RANGES = {
    "latitude": (6.0, 38.0),
    "longitude": (68.0, 98.0),
    "ndvi": (-1.0, 1.0),
    "rainfall": (0.0, None),
    "humidity": (0.0, 100.0),
    "wind_speed": (0.0, None),
    "soil_moisture_proxy": (0.0, 1.0),
}

# --- FIXED VALUES: payload defaults for a lone forecast observation ----------
FORECAST_DEFAULTS = {
    "ndvi": 0.35, "lst": 36.0, "rainfall": 35.0, "temperature": 34.0, "humidity": 38.0,
    "solar_radiation": 24.0, "wind_speed": 3.5, "soil_moisture": 0.24,
}

# --- FIXED VALUES: soil defaults (sand, clay, soc) ---------------------------
SOIL_DEFAULTS = {"sand": 350.0, "clay": 220.0, "soc": 80.0}

# --- FIXED VALUES: climate parameter names -> canonical columns ---------------
CLIMATE_PARAMS = {
    "T2M": "temperature",
    "RH2M": "humidity",
    "WS2M": "wind_speed",
    "ALLSKY_SFC_SW_DWN": "solar_radiation",
}
