"""Evaluation of predictors over run-to-failure series, as Spark DataFrame jobs."""
