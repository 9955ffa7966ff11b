"""Trajectory and observation analytics on Spark."""
