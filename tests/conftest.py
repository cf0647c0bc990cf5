import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from panelwright.session import local_session

    s = local_session(4, "panelwright-tests", str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def noise(i, t):
    """Deterministic 32-bit noise."""
    x = (i * 2654435761 + t * 40503 + (i + 1) * (t + 7) * 97) % (1 << 32)
    x ^= x >> 16
    x = (x * 0x45D9F3B) % (1 << 32)
    return x ^ (x >> 16)


def shock(i, t):
    return (noise(i, t) % 1000) / 1000 - 0.5


def trajectory(i, n_times, coefs, p=1, action=None):
    """Rows (subject, t, s1..sp, a) of one subject; ``coefs(t)`` gives (c0, cA, cS, cAS)."""
    s = np.array([shock(i + 1000 * j, 9999) for j in range(p)])
    out = []
    for t in range(n_times):
        a = (noise(i, t) >> 8) & 1 if action is None else action
        out.append((i, t, *[float(v) for v in s], int(a)))
        c0, ca, cs, cas = coefs(t)
        s = np.array([c0 + ca * a + cs * s[j] + cas * a * s[j] + shock(i + 1000 * j, t + 5000) for j in range(p)])
    return out


def changed(t):
    return (0, 0.5, 0.3, -0.5) if t < 25 else (0, -0.5, 0.3, 0.5)


def steady(t):
    return (0.2, 0.3, 0.5, 0.1)


def panel_frame(subjects, n_times, coefs, p=1, action=None):
    rows = [r for i in subjects for r in trajectory(i, n_times, coefs, p, action)]
    return pd.DataFrame(rows, columns=["subject", "t", *[f"s{j + 1}" for j in range(p)], "a"])


@pytest.fixture(scope="session")
def change_panel():
    return panel_frame(range(12), 51, changed)


@pytest.fixture(scope="session")
def steady_panel():
    return panel_frame(range(100, 112), 51, steady)


def design(a, s):
    """[1, A, S, A*S]; s is (n, p)."""
    a = np.asarray(a, float)[:, None]
    return np.hstack([np.ones_like(a), a, s, a * s])


def step_arrays(pdf, p=1):
    """Plain transition arrays from a pandas panel: subject, t, a, S, Y."""
    cols = [f"s{j + 1}" for j in range(p)]
    pdf = pdf.sort_values(["subject", "t"])
    nxt = pdf.groupby("subject")[["t", *cols]].shift(-1)
    ok = nxt["t"] == pdf["t"] + 1
    return (pdf.loc[ok, "subject"].to_numpy(), pdf.loc[ok, "t"].to_numpy(), pdf.loc[ok, "a"].to_numpy(),
            pdf.loc[ok, cols].to_numpy(float), nxt.loc[ok, cols].to_numpy(float))


def sse(x, y, w=None):
    if len(x) == 0:
        return 0.0
    sw = np.ones(len(x)) if w is None else np.sqrt(w)
    c = np.linalg.lstsq(x * sw[:, None], y * sw[:, None], rcond=None)[0]
    return float((((y - x @ c) * sw[:, None]) ** 2).sum())
