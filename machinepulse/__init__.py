"""Equipment-health analytics over sensor readings and anomaly verdicts, on Spark."""
