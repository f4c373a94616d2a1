"""Restartable batch runs on Structured Streaming."""
