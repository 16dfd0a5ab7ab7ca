import numpy as np
import pandas as pd


def panel(codes=12, days=60, seed=0, gaps=0.0):
    """Random bars: code, date, OHLC, volume, amount, turnover."""
    rng = np.random.default_rng(seed)
    frames = []
    dates = pd.bdate_range("2020-01-01", periods=days)
    for i in range(codes):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, days)))
        open_ = close * (1 + rng.normal(0, 0.01, days))
        frames.append(
            pd.DataFrame(
                {
                    "code": f"{i:06d}", "date": dates, "open": open_,
                    "high": np.maximum(open_, close) * 1.01, "low": np.minimum(open_, close) * 0.99,
                    "close": close, "volume": rng.integers(1, 50, days).astype(float),
                    "amount": rng.uniform(1e3, 1e5, days), "turnover": rng.integers(1, 50, days) / 1024.0,
                }
            )
        )
    df = pd.concat(frames, ignore_index=True)
    if gaps:
        df = df[rng.uniform(size=len(df)) > gaps].reset_index(drop=True)
    df["date"] = df["date"].dt.date
    return df


def rows(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def same(a, b, columns, tol=1e-9):
    for c in columns:
        x, y = a[c].to_numpy(), b[c].to_numpy()
        if x.dtype.kind in "fiu" and y.dtype.kind in "fiu":
            np.testing.assert_allclose(x.astype(float), y.astype(float), rtol=tol, atol=tol, equal_nan=True, err_msg=c)
        else:
            assert list(x) == list(y), c
