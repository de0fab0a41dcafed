"""DataFrame to DataFrame operators: metrics, signal preparation, splits, models, contracts."""
