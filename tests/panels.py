"""Generated panels and brute-force helpers shared by the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

YEARS = [*range(2001, 2020), *range(2022, 2026)]
GROUPS = ["3-4", "5-6", "7-8", "9-10", "11-13"]


def generated_panel(slope: float, seed: int = 1, drop: int = 0) -> pd.DataFrame:
    """Long panel: five exam groups over 23 years, human mean an affine function of the
    ensemble. ``drop`` removes rows of whole exams to make it unbalanced."""
    rng = np.random.default_rng(seed)
    rows = []
    for g, exam in enumerate(GROUPS):
        for year in YEARS:
            visual = rng.uniform(0.2, 0.7)
            models = {f"m{i}": 55 + 5 * g + 30 * visual + rng.normal(0, 2) for i in range(4)}
            ensemble = float(np.mean(list(models.values())))
            facts = {
                "year": year,
                "exam": exam,
                "human_pct": 30 + 4 * g + slope * (ensemble - 60),
                "multimodal_share": visual,
                "associated_image_share": 0.8 * visual + 0.02 * rng.normal(),
                "option_image_share": 0.3 * visual + 0.02 * rng.normal(),
            }
            for series, pct in {**models, "ensemble": ensemble}.items():
                rows.append({**facts, "series": series, "model_pct": pct})
    frame = pd.DataFrame(rows)
    if drop:
        exams = frame[["year", "exam"]].drop_duplicates().sample(drop, random_state=seed)
        gone = set(map(tuple, exams.to_numpy()))
        frame = frame[[(y, e) not in gone for y, e in zip(frame.year, frame.exam)]]
    return frame.reset_index(drop=True)


def noisy(frame: pd.DataFrame, seed: int = 7) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    noise = {
        key: rng.normal(0, 3)
        for key in sorted(set(zip(frame.year, frame.exam)))
    }
    shift = [noise[key] for key in zip(frame.year, frame.exam)]
    return frame.assign(human_pct=frame.human_pct + np.array(shift))


def design(frame: pd.DataFrame, predictors: list[str], factors: list[str]) -> np.ndarray:
    parts = [np.ones((len(frame), 1)), frame[predictors].to_numpy(float)]
    for factor in factors:
        levels = sorted(frame[factor].astype(str).unique())[1:]
        parts.append(
            np.column_stack([(frame[factor].astype(str) == x).to_numpy(float) for x in levels])
            if levels
            else np.empty((len(frame), 0))
        )
    return np.column_stack(parts)


def ols(frame: pd.DataFrame, outcome: str, predictors: list[str], factors: list[str]):
    """(coefficients of the predictors, r²) of the full dummy design."""
    x, y = design(frame, predictors, factors), frame[outcome].to_numpy(float)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rest = y - x @ beta
    r2 = 1 - (rest @ rest) / np.sum((y - y.mean()) ** 2)
    return dict(zip(predictors, beta[1:])), float(r2)
