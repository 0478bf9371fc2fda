"""Every operator as a runnable query over the star tables, with its SQL counterpart."""

from countcast.queries import models, profiles, rollups, scoring, tuning
from countcast.queries.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "models", "profiles", "rollups", "scoring", "tuning"]
