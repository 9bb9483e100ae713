"""All queries of the panel library; importing the modules fills the registry."""

from tidemark.plans import analytics, calibration, compositions, data, evaluation, events, features, files, history, identity, models, reports, storage
from tidemark.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analytics", "calibration", "compositions", "data", "evaluation", "events", "features", "files", "history", "identity", "models", "reports", "storage"]
