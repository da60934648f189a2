"""All queries of this package and the SQL of those that SQL can express."""

from loomspan.llm import bpe, embeddings, langid, lexical, mixing, pii, quality, sharding, simhash, substring, suffix, toxicity, vectorcodes

MODULES = (embeddings, toxicity, simhash, bpe, pii, suffix, mixing, substring, quality, langid, sharding, vectorcodes, lexical)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
