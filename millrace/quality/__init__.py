"""Data quality: contracts, checks in one pass, gates, quarantine, anomalies, validators."""
