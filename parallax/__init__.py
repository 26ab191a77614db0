"""Structural comparison of two versions of a body of material, as Spark DataFrame operators."""
