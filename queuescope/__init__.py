"""Event-log analytics on Spark: request state at arrival, estimate errors, latency models."""
