"""Competition analytics on Spark: DataFrame operators for league tables, features, ratings, forecasts and their evaluation."""
