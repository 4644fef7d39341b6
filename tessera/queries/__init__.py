"""All registered queries but those of the training-text subpackage."""

from tessera.queries import fronts, models, relational, scalars, shapes, surface
from tessera.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "fronts", "models", "relational", "scalars", "shapes", "surface"]
