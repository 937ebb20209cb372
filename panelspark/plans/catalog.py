"""All registered queries; importing a module registers its queries."""

from panelspark.plans import chain, cleaning, models, portfolio, reports, signals, storage, texts, universe  # noqa: F401
from panelspark.plans.registry import ORACLES, QUERIES  # noqa: F401
