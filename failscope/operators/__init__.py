"""Operators over trajectories, steps and events."""
