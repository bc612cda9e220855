"""Named queries over the test tables with their SQL counterparts."""

from . import base


def load():
    """Import every family once and return (queries, oracles)."""
    from . import (q_aggregates, q_clean, q_derivatives, q_factors, q_indicators,  # noqa: F401
                   q_joins, q_ledger, q_ml, q_plans, q_portfolio, q_regime, q_robust, q_streaming)

    return dict(base.QUERIES), dict(base.ORACLES)
