"""All queries and their SQL."""

from tallyworks.plans import reports, weights  # noqa: F401  they register their queries
from tallyworks.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
