"""Curriculum data preparation and analysis as Spark DataFrame operators."""
