"""All registered queries with the SQL that states the same result."""

from propspark.catalog import assay, domain, evaluation, folds, measure, modelling, rows, text

MODULES = (rows, measure, assay, text, domain, folds, evaluation, modelling)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
