"""Supplier-risk analytics on Spark DataFrames."""

from keelson.plans.risk_queue import run_risk_pipeline

__all__ = ["run_risk_pipeline"]
