"""The queries that __spark_entry__.py registers, with their SQL twins."""

from cargolens.plans import containers, relational  # noqa: F401  (they register their queries)
from cargolens.plans.base import ORACLES, QUERIES  # noqa: F401
