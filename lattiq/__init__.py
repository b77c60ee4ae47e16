"""Declarative object queries over related tables, as Spark plans."""

from .catalog import Catalog, Field, Model, Relation, sales_catalog
from .config import Options, limits, reset_limits, set_limits
from .errors import LimitExceeded, QueryError, UnsupportedQuery
from .plans.client import Compiled, Engine, compiler
from .sources.tables import FrameTables, ParquetTables

__all__ = ["Catalog", "Compiled", "Engine", "Field", "FrameTables", "LimitExceeded", "Model", "Options", "ParquetTables", "QueryError", "Relation", "UnsupportedQuery", "compiler", "limits", "reset_limits", "sales_catalog", "set_limits"]
