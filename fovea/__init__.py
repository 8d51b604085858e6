"""Spark DataFrame operators for reading-behaviour records and other event sequences."""
