"""Named queries over the tables, with SQL for the same rows."""

from tessera.plans import changes, formats, library, records, texts  # noqa: F401  they register themselves
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
