"""Labelled time spans at scale: assemble, clean, score and compare them with Spark."""
