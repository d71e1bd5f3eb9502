"""All queries of the engine's own operators."""

from __future__ import annotations

from .q_extract import BOOK as EXTRACT
from .q_mining import BOOK as MINING
from .q_rest import BOOK as REST
from .q_series import BOOK as SERIES

ALL = MINING | SERIES | REST | EXTRACT
QUERIES = ALL.queries
ORACLE_SQL = ALL.sql
