from playlens.oracle.sql import ORACLE_SQL  # noqa: F401
