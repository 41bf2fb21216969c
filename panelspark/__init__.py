"""Panel forecasting analytics as Spark DataFrame operators."""
