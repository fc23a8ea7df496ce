"""Tidewater: replication, reconciliation and export analytics on Spark DataFrames."""
