"""Rule checks on streams: windowed counts that tolerate late rows, and their history."""

from lensdq.streaming.history import history, key_counts, record, unique_results, windowed_completeness
from lensdq.streaming.rules import windowed_results

__all__ = ["history", "key_counts", "record", "unique_results", "windowed_completeness", "windowed_results"]
