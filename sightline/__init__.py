"""Security-evidence analytics as Spark DataFrame and stream operators."""

from sightline.session import build_session, cut_lineage

__all__ = ["build_session", "cut_lineage"]
