"""All registered queries."""

from sitewright.plans import learning, links, rows, texts  # noqa: F401
from sitewright.plans.registry import JOBS, SQL  # noqa: F401
