"""All queries of this subpackage."""

from . import block_search, line_dedup, lm_scoring, minhash_dedup, packing, pii_disclosure, quality_rules, ranked_search, source_mixing, substring_dedup, token_files, warc_index, whitening  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
