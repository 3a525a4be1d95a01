"""Registered queries, one module per family of the operator inventory."""

from . import (  # noqa: F401
    a_sources,
    b_scalars,
    c_grid,
    d_detection,
    e_correction,
    f_geography,
    g_calendar,
    h_transform,
    j_features,
    k_statistics,
    l_models,
    m_benchmarks,
    n_evaluation,
    o_chains,
)
