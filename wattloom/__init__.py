"""wattloom: cleaning, enriching and forecasting many time series as Spark jobs."""
