"""Cross-sectional analytics over (date, ticker) panels, written as Spark DataFrame operators."""
