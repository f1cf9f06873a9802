"""tidewheel: DataFrame-first analytics operators for time series, tables and text corpora."""
