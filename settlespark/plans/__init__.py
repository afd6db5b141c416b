"""Jobs composed of operators: datasets, training, forecasts, logs, reports."""
