"""Fitting of the weights by which ``stuffing`` judges a text's rank-frequency curve.

Labelled rows are the different texts of at most ``ROWS`` pages, labelled by reading them unit by unit (``is_stuffed``). The
weights are a logistic regression on the driver. ``python -m millrace.llm.stuffing_fit DIR`` prints them for DIR's tables.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import stuffing as S
from millrace.sources.staging import staged

#: Labelled rows at most, steps of the descent.
ROWS, STEPS = 100_000, 3000


def labelled(pages: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Figures and labels (1 stuffed) of the different texts of at most ``ROWS`` of ``pages``."""
    firsts = staged(S.different(pages.limit(ROWS)), "fit-texts")
    counts = staged(S.word_counts(pages, firsts), "fit-counts")
    core = S.prose_core(counts, firsts)
    shares: dict[str, dict[str, float]] = {}
    for r in core.select("word", F.explode("shares").alias("lang", "share")).collect():
        shares.setdefault(r.lang, {})[r.word] = r.share

    @F.pandas_udf("boolean")
    def read(fit, text):
        import pandas as pd
        import regex

        find = regex.compile(S.WORD_PYTHON).findall
        return pd.Series([S.is_stuffed(t, shares.get(f, {}), find) for f, t in zip(fit, text, strict=True)], index=fit.index)

    rows = S.compared(S.curves(counts, core)).where(F.col("words") >= S.LEAST)
    got = rows.join(pages.select("page", "text"), "page").select(*S.FIGURES, read("fit", "text").alias("y")).toPandas()
    return got[S.FIGURES].to_numpy(), got.y.to_numpy().astype(float)


def fit(v: np.ndarray, y: np.ndarray) -> list[float]:
    terms = np.stack([v, v * v], axis=2).reshape(len(v), -1)
    x = np.concatenate([terms, terms * v[:, -1:]], axis=1)
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], axis=1)
    w, m, u = (np.zeros(z.shape[1]) for _ in range(3))
    for t in range(1, STEPS + 1):
        g = z.T @ (1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - y) / len(y) + 1e-5 * w
        m, u = 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.999**t)) + 1e-8)
    plain = w[:-1] / sd
    return [float(f"{a:.5g}") for a in [*plain, w[-1] - (plain * mean).sum()]]


def main(folder: str) -> None:
    from millrace.llm.queries import _pages
    from millrace.sources.session import build_session

    spark = build_session("local[8]", "fit", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    v, y = labelled(_pages(spark, folder))
    w = fit(v, y)
    terms = np.stack([v, v * v], axis=2).reshape(len(v), -1)
    p = 1 / (1 + np.exp(-np.clip(np.concatenate([terms, terms * v[:, -1:], np.ones((len(v), 1))], axis=1) @ np.array(w), -30, 30)))
    print(w)
    print(len(y), y.sum(), "decided", ((p <= S.NO) | (p >= S.YES)).mean(), "wrongly", ((p >= S.YES) & (y == 0)).sum(), ((p <= S.NO) & (y == 1)).sum())


if __name__ == "__main__":
    main(sys.argv[1])
