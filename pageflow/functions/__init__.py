"""Column functions and the small per-row helpers behind them."""
