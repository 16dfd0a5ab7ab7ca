"""Cross-sectional equity factor research as Spark DataFrame operators."""
