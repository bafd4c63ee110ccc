"""Whole jobs: train a detector, reconcile two files, report and export a stored job."""
