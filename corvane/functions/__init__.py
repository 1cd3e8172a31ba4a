"""Schemas and column expressions."""

from corvane.functions.columns import json_of, record_of
from corvane.functions.schemas import USER

__all__ = ["USER", "json_of", "record_of"]
