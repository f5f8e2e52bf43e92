"""Tallyloom: table cleaning, profiling, KPIs and text-table analytics as lazy Spark DataFrame jobs."""
