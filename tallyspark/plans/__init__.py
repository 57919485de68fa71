"""All named queries; importing the package registers them."""

from tallyspark.plans import job_tables, ledgers, page_texts, parties, quality, reports, requests, usage  # noqa: F401
from tallyspark.plans.registry import ORACLES, QUERIES  # noqa: F401
