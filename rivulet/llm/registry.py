"""All queries of this subpackage and their oracles."""

from . import chat, counting, decontaminate, lines, neardup, packing, quality, sharding, suffix, topk

_MODULES = [lines, quality, counting, packing, suffix, neardup, chat, topk, sharding, decontaminate]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
