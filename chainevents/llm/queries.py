"""All registered queries of this package."""

from chainevents.llm import bpe, centroids, exact_dedup, html_text, jaccard, minhash, packing, quality, resampling, suffix_dedup, token_files, topk, toxicity  # noqa: F401
from chainevents.llm.common import QUERIES

__all__ = ["QUERIES"]
