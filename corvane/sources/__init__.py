"""Reading and writing of record tables."""

from corvane.sources.records import read_records, write_records
from corvane.sources.shared import removed, shared_path

__all__ = ["read_records", "removed", "shared_path", "write_records"]
