"""Column expressions; nothing here runs a job."""

from .logs import classify_line, line_port, strip_prefix
from .records import default_value, envelope, error_envelope, is_ready, nth_word, severity_colour, status_message, status_title, text_after_last

__all__ = ["classify_line", "default_value", "envelope", "error_envelope", "is_ready", "line_port", "nth_word", "severity_colour", "status_message", "status_title", "strip_prefix", "text_after_last"]
