"""Operators on record tables."""

from corvane.operators.records import count_records, envelope, enveloped_records, json_document, list_records, record_json

__all__ = ["count_records", "envelope", "enveloped_records", "json_document", "list_records", "record_json"]
