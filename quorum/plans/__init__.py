"""The read side: queries over the event log and the dimension tables."""

from . import activity, bills, civics, eventlog, landed, lobby, scalars, stores, streams, traffic  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
