"""Micro-batch form of a run."""
