"""All queries of this subpackage, and the SQL of those that SQL can express."""

from opslens.llm import (chat, fill_middle, html_text, kmeans, mixing, packing, quality_classifier, quality_rules, secrets, simhash, sketches, suffix_dedup,
                         toxicity)

MODULES = (quality_classifier, simhash, mixing, secrets, chat, html_text, toxicity, packing, quality_rules, sketches, fill_middle, kmeans, suffix_dedup)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
