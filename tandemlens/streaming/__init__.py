"""Evaluators and metric logs on Structured Streaming."""
