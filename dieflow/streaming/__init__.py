"""Structured Streaming: detection, holds, emulation."""
