"""The registered queries of the training-data operators."""

from crawlens.llm import chat, chunk_dedup, decontaminate, licenses, merkle, packing, periodic, pii, quality, simhash, toxicity, url_filter, warc  # noqa: F401
from crawlens.llm.common import ORACLES, QUERIES  # noqa: F401
