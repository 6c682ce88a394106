"""Panel operators: one module per stage of cross-sectional research."""
