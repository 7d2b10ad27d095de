"""All registered queries: importing the query modules fills the registry."""

from blockloom.plans import entity_queries, fee_queries, forecast_queries, ledger_queries, stream_queries, whale_queries  # noqa: F401
from blockloom.plans.registry import QUERIES  # noqa: F401
