"""Multi-rate vehicle telemetry on Spark: control-transition events, labels, samples, splits, GPS features and metrics."""
