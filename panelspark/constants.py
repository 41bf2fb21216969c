"""Names, ranges and fixed values shared by every operator."""

from __future__ import annotations

SERIES = ["country", "brand_name"]
MONTH = "months_postgx"
ROW_KEY = [*SERIES, MONTH]
EPS = 1e-6

# Scenario -> (first month hidden from features, first target month, last target month).
SCENARIOS = {1: (0, 0, 23), 2: (6, 6, 23)}

# Columns that never enter a feature matrix.
NEVER_FEATURES = ["country", "brand_name", "volume", "y_norm", "mean_erosion", "bucket"]

# Accepted (low, high) per column; None is unbounded.
VALUE_RANGES = {
    "months_postgx": (-24, 23),
    "volume": (0, None),
    "n_gxs": (0, 50),
    "hospital_rate": (0, 100),
    "y_norm": (0, 5),
}

# Bucket 1 holds series whose mean erosion is at most this.
BUCKET_THRESHOLD = 0.25

# Month names in calendar order.
MONTH_NAMES = "JanFebMarAprMayJunJulAugSepOctNovDec"

# Package words.
INJECTION_WORDS = ["injection", "injectable", "syringe", "vial", "iv", "infusion"]
ORAL_WORDS = ["tablet", "capsule", "oral", "pill"]

# Macro indicators and the columns they fill.
MACRO_COLUMNS = {
    "gdp_growth": "ext_gdp_growth",
    "unemployment": "ext_unemployment",
    "inflation": "ext_inflation",
    "healthcare_spend": "ext_healthcare_spend",
}

# Event types that count as promotion or as policy.
PROMO_TYPES = ["price_cut", "marketing_campaign", "competitor_launch"]
POLICY_TYPES = ["patent_expiry", "formulary_change", "regulatory_approval"]

# Month windows of the reports and of the calibration.
REPORT_WINDOWS = {1: [("early", 0, 5), ("mid", 6, 11), ("late", 12, 23)],
                  2: [("early", 6, 11), ("mid", 12, 17), ("late", 18, 23)]}
CALIBRATION_WINDOWS = {1: [(0, 5), (6, 11), (12, 23)], 2: [(6, 11), (12, 17), (18, 23)]}
RESIDUAL_WINDOWS = {1: [(0, 5), (6, 11)], 2: [(6, 11)]}

VISIBILITY_COLUMNS = [
    "vis_avg_inventory", "vis_avg_days_of_supply", "vis_avg_stock_out_risk", "vis_fill_rate",
    "vis_avg_lead_time", "vis_supplier_reliability", "vis_on_time_delivery", "vis_capacity_utilization",
]


def scenario_window(scenario) -> tuple[int, int, int]:
    """Accepts 1, 2, "1", "2", "scenario1" or "scenario2"."""
    number = int(str(scenario).removeprefix("scenario"))
    if number not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario!r}")
    return SCENARIOS[number]


def require(df, columns, what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
