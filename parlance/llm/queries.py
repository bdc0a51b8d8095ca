"""Imports every operator module so that its queries are registered."""

from parlance.llm import centroid_lang, cost_packing, entropy_mix, golay, hash_tree, level_products, line_quality, oph, quotes, spelling, suffixes, token_counts, url_models  # noqa: F401
from parlance.llm.common import ORACLES, QUERIES  # noqa: F401
