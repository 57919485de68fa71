"""Billing-document analytics on Spark DataFrames."""
