"""Information criterion, its penalties and its reported parameters, as SQL expressions.

Names available to a penalty: ``k`` (clusters), ``n`` (subjects), ``t`` (time
points), ``c`` (constant), ``sum_len`` (sum over subjects of T-1-tau),
``mean_len`` (its mean) and ``loss``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

PENALTIES: dict[str, str] = {
    "log": "k * ln(sum_len)",
    "sqrt": "k * sqrt(sum_len)",
    "logN": "k * ln(n)",
    "Nlog(NT)/T": "c * k * n * ln(n * t) / t",
    "sqrt{Nlog(NT)/T}": "c * k * sqrt(n * ln(n * t) / t)",
    "sqrtN": "c * k * sqrt(n)",
    "BIC": "k * ln(n)",
}


def register_penalty(name: str, expression: str) -> None:
    """Add a penalty; the expression may use the names listed above."""
    PENALTIES[name] = expression


def criterion(penalty: str, dynamic_t: bool = False) -> F.Column:
    """loss - penalty. ``dynamic_t`` puts the mean segment length in place of T.

    ``penalty`` is a registered name, or an expression over the names above.
    """
    text = PENALTIES.get(penalty, penalty)
    if dynamic_t:
        import re

        text = re.sub(r"\bt\b", "mean_len", text)
    # The loss is a negated sum of squares, so BIC takes the log of its size.
    loss = "-n * ln(-loss / n)" if penalty == "BIC" else "loss"
    return F.expr(f"({loss}) - ({text})")


def bonus(sum_len: F.Column, form: str = "1") -> F.Column:
    """M / ln M, or its square root, with M the summed segment length."""
    h = sum_len / F.ln(sum_len)
    return F.sqrt(h) if form == "sqrt" else h


def size_weight(weighted_len: F.Column, n: F.Column, t: F.Column) -> F.Column:
    """Cluster sizes times segment lengths, over N * T."""
    return weighted_len / (n * t)
