"""Host-security telemetry analytics as PySpark DataFrame operators."""
