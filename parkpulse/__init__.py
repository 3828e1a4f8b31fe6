"""Parking-sensor analytics on Spark: raw device messages to stays, occupancy and reports."""
