"""All registered queries and the DuckDB SQL that they are held against."""

from quern.catalogue import context, evaluation, naming, retrieval, serving, texts
from quern.catalogue.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "context", "evaluation", "naming", "retrieval", "serving", "texts"]
