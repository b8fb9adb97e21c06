"""DataFrame operators: statistics, features, metrics, models, anomaly, drift."""
