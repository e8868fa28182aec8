"""Ripplegraph: information-cascade analytics as Spark DataFrame operators."""
