"""Schemas of the input tables. Text files are read with these, never inferred."""

from __future__ import annotations

RAW = {
    "volume": "country STRING, brand_name STRING, month STRING, months_postgx INT, volume DOUBLE",
    "generics": "country STRING, brand_name STRING, months_postgx INT, n_gxs INT",
    "medicine_info": "country STRING, brand_name STRING, ther_area STRING, hospital_rate DOUBLE, main_package STRING, "
                     "biological BOOLEAN, small_molecule BOOLEAN",
}
RAW_KEYS = {
    "volume": ["country", "brand_name", "months_postgx", "volume"],
    "generics": ["country", "brand_name", "months_postgx", "n_gxs"],
    "medicine_info": ["country", "brand_name"],
}
HOLIDAYS = "date DATE, country STRING, holiday_name STRING, holiday_type STRING"
EPIDEMICS = ("start_date DATE, end_date DATE, country STRING, event_name STRING, severity INT, "
             "affected_ther_areas STRING")
MACRO = "date DATE, country STRING, indicator_name STRING, value DOUBLE, unit STRING"
PROMO_POLICY = ("start_date DATE, end_date DATE, country STRING, event_type STRING, event_description STRING, "
                "affected_brands STRING, impact_magnitude DOUBLE")
INVENTORY = ("date DATE, country STRING, brand_name STRING, location_type STRING, inventory_units DOUBLE, "
             "days_of_supply DOUBLE, stock_out_risk DOUBLE")
ORDERS = ("date DATE, country STRING, brand_name STRING, order_quantity DOUBLE, filled_quantity DOUBLE, "
          "lead_time_days DOUBLE, order_type STRING")
SUPPLIERS = ("date DATE, country STRING, brand_name STRING, supplier_id STRING, reliability_score DOUBLE, "
             "on_time_delivery_rate DOUBLE, quality_score DOUBLE")
DISTRIBUTION = ("date DATE, country STRING, distribution_center_id STRING, capacity_utilization DOUBLE, "
                "throughput_units DOUBLE, backlog_units DOUBLE")
PREDICTIONS = "country STRING, brand_name STRING, months_postgx INT, volume DOUBLE"
AUXILIARY = "country STRING, brand_name STRING, avg_vol DOUBLE, bucket INT"
METRIC_LOG = ("run_id STRING, timestamp STRING, phase STRING, split STRING, scenario INT, model STRING, metric STRING, "
              "value DOUBLE, step INT, bucket INT, series_id STRING, extra STRING")
SUBMISSION_LOG = ("version STRING, timestamp STRING, n_rows BIGINT, n_series BIGINT, volume_mean DOUBLE, "
                  "volume_std DOUBLE, volume_min DOUBLE, volume_max DOUBLE, validation_score DOUBLE, "
                  "model_info STRING, notes STRING")
