"""Tests and regressions: distributed sums on the executors, small solves on the driver."""
