"""Streams: log lines and clicks."""

from .clicks import burst_stream
from .logs import classify_logs, log_stream, write_logs

__all__ = ["burst_stream", "classify_logs", "log_stream", "write_logs"]
