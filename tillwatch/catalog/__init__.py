"""The query catalog; importing it registers everything."""

from . import features, learning, ledger, rules, streaming  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
