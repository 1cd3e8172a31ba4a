"""Whole jobs made of sources and operators."""

from corvane.plans.listing import list_job, written_job

__all__ = ["list_job", "written_job"]
