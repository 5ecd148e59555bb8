"""All queries of this subpackage and their SQL."""

from lavka.llm import dataset_queries, table_queries, text_queries  # noqa: F401
from lavka.llm.registry import ORACLE, QUERIES  # noqa: F401
