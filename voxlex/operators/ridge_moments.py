"""Ridge from second moments, for blocks of response series (runs inside tasks).

Everything a ridge fit and its score need about the stimulus are the count,
the sums and the cross products of its rows, per *row set* (training part, test
part, each bootstrap's held-out rows); about a series they are ``X_s^T y``, the
sum and the sum of squares of ``y``, per row set.  Both physical plans produce
these moments (``ridge``: from packed series and a broadcast stimulus,
``ridge_stats``: from aggregates) and share the algebra here.

For a fit set with cross products ``G = V diag(L) V^T`` the prediction weights
at penalty ``a`` are ``V u`` with ``u = z / (L + a^2)``, ``z = V^T X^T y``.  On a
scoring set with covariance ``C`` (in the basis ``V``) the covariance of
prediction and response is a scalar product with ``u`` and the variance of the
prediction the form ``u^T C u``; no prediction is formed and no loop over
penalties is needed.

Directions whose singular value is at most ``cutoff`` or ``ROW_TOL`` times the
largest do not take part.  At penalty 0 the result is therefore that of the
pseudo-inverse, in every plan.  The fit set's directions come from its rows or
from a triangular factor of them (``factor``), not from its cross products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TRAIN, TEST = -1, -2
#: Relative size below which a singular value counts as zero, taken from rows or
#: a triangular factor, and from cross products (doubles resolve no smaller ones).
ROW_TOL, RANK_TOL = 1e-12, 1e-7
#: Bytes of a block of the stimulus or of responses as it is shuffled, and of the
#: arrays that a task makes of a block of series at a time.
BLOCK_BYTES, SCRATCH_BYTES = 64 << 20, 16 << 20


@dataclass
class RowMoments:
    """Count, sums and cross products of a row set's stimulus rows."""
    n: int
    total: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> "RowMoments":
        return cls(len(x), x.sum(0), x.T @ x)

    def less(self, other: "RowMoments") -> "RowMoments":
        return RowMoments(self.n - other.n, self.total - other.total, self.cross - other.cross)


@dataclass
class SeriesMoments:
    """Per row set: ``X_s^T y`` (features x series), sums and square sums."""
    cross: dict
    total: dict
    square: dict

    @property
    def width(self) -> int:
        return self.cross[TRAIN].shape[1]


class Basis:
    """The eigenbasis of a fit set with one scoring set expressed in it."""

    def __init__(self, fit: RowMoments, score: RowMoments, cutoff: float = 0.0, rows: np.ndarray | None = None):
        """``rows``: the fit set's stimulus, or a triangular factor of it; its
        singular vectors are more exact than those of the cross products."""
        if rows is not None and len(rows):
            _, sing, vt = np.linalg.svd(rows, full_matrices=False)
            v = vt.T
        else:
            lam, v = np.linalg.eigh(fit.cross)
            sing, v = np.sqrt(np.clip(lam[::-1], 0.0, None)), v[:, ::-1]
        self.top = float(sing[0]) if len(sing) else 0.0
        keep = sing > max(cutoff, (RANK_TOL if rows is None else ROW_TOL) * self.top)
        self.v, self.strength = v[:, keep], sing[keep] ** 2
        self.n = score.n
        n = max(score.n, 1)
        self.mean = self.v.T @ (score.total / n)
        spread = self.v.T @ (score.cross / n) @ self.v - np.outer(self.mean, self.mean)
        lam, e = np.linalg.eigh(spread)
        live = lam > 1e-15 * max(lam.max(initial=0.0), 0.0)
        self.root = np.sqrt(lam[live])[:, None] * e[:, live].T     # root^T root = spread

    def damped(self, penalties) -> np.ndarray:
        """1 / (L + a^2), penalties x directions (or directions x series)."""
        return 1.0 / (self.strength + np.asarray(penalties, dtype=float)[..., None] ** 2)

    def project(self, fit_cross: np.ndarray, score_cross: np.ndarray, score_total: np.ndarray):
        """(z, covariance of every direction with y), directions x series."""
        n = max(self.n, 1)
        cov = self.v.T @ (score_cross / n) - np.outer(self.mean, score_total / n)
        return self.v.T @ fit_cross, cov

    def all_penalties(self, z, cov, penalties):
        """Covariance and variance of the predictions, penalties x series."""
        d = self.damped(penalties)
        var = np.empty((len(d), z.shape[1]))
        step = max(1, SCRATCH_BYTES // (8 * max(1, d.size + 2 * len(d) * len(self.root))))
        for a in range(0, z.shape[1], step):
            u = d[:, :, None] * z[None, :, a:a + step]
            var[:, a:a + step] = np.square(self.root @ u).sum(1)
        mean = (d * self.mean) @ z
        return d @ (z * cov), var, mean

    def own_penalty(self, z, cov, penalties):
        """The same with one penalty per series."""
        u = z * self.damped(penalties).T
        return (u * cov).sum(0), np.square(self.root @ u).sum(0), self.mean @ u


def rate(cov, var_p, mean_p, n, total, square, use_corr: bool, blended: bool):
    """Correlation, or signed root of R^2, of responses and predictions.

    A series or prediction that does not vary has no correlation (NaN).
    ``blended``: R^2 relative to the mean of the response's variance and 1.
    """
    mean = total / max(n, 1)
    var = square / max(n, 1) - mean ** 2
    flat = var <= 1e-12 * np.maximum(square / max(n, 1), 1e-300)
    var = np.where(flat, 0.0, var)
    with np.errstate(divide="ignore", invalid="ignore"):
        if use_corr:
            r = cov / np.sqrt(var * var_p)
            still = var_p <= 1e-24 * np.maximum(mean_p ** 2, 1e-280)
            return np.where(flat | still, np.nan, r)
        gone = 1.0 - (var - 2 * cov + var_p) / ((1.0 + var) / 2.0 if blended else var)
        return np.sqrt(np.abs(gone)) * np.sign(gone)


class Solver:
    """All bases of one stimulus: one per bootstrap and the final one."""

    def __init__(self, sets: dict, nboots: int, cutoff: float, keep_small: bool, rows: dict | None = None):
        """``sets``: row set -> RowMoments.  ``keep_small``: the final fit
        ignores the cut-off (it does where weights are asked for).  ``rows``:
        fit set -> stimulus rows or their factor, keyed by bootstrap and TRAIN."""
        rows = rows or {}
        width = len(sets[TRAIN].total)
        none = RowMoments(0, np.zeros(width), np.zeros((width, width)))
        self.boots = []
        for b in range(nboots):
            held = sets.get(b, none)
            self.boots.append(Basis(sets[TRAIN].less(held), held, cutoff, rows.get(b)) if held.n else None)
        self.final = Basis(sets[TRAIN], sets.get(TEST, none), 0.0 if keep_small else cutoff, rows.get(TRAIN))
        # the grid over the test part always applies the cut-off
        self.grid = self.final if not keep_small else Basis(sets[TRAIN], sets.get(TEST, none), cutoff, rows.get(TRAIN))

    def held_out(self, m: SeriesMoments, penalties, normalpha: bool, use_corr: bool) -> np.ndarray:
        """Scores of every bootstrap and penalty, boots x penalties x series."""
        out = np.zeros((len(self.boots), len(penalties), m.width))
        for b, basis in enumerate(self.boots):
            if basis is not None:
                z, cov = basis.project(m.cross[TRAIN] - m.cross[b], m.cross[b], m.total[b])
                out[b] = self._grid(basis, z, cov, m, b, penalties, normalpha, use_corr)
        return out

    def on_test(self, m: SeriesMoments, penalties, normalpha: bool, use_corr: bool) -> np.ndarray:
        """Scores of every penalty on the test part, penalties x series."""
        z, cov = self.grid.project(m.cross[TRAIN], m.cross[TEST], m.total[TEST])
        return self._grid(self.grid, z, cov, m, TEST, penalties, normalpha, use_corr)

    @staticmethod
    def _grid(basis, z, cov, m, s, penalties, normalpha, use_corr):
        a = np.asarray(penalties, dtype=float) * (basis.top if normalpha else 1.0)
        got = rate(*basis.all_penalties(z, cov, a), basis.n, m.total[s], m.square[s], use_corr, True)
        return np.nan_to_num(got, nan=0.0, posinf=np.inf, neginf=-np.inf)

    def fit(self, m: SeriesMoments, penalties, normalpha: bool, use_corr: bool, weights: bool):
        """(score on the test part, weights as series x features or None)."""
        f = self.final
        a = np.asarray(penalties, dtype=float) * (f.top if normalpha else 1.0)
        z, cov = f.project(m.cross[TRAIN], m.cross[TEST], m.total[TEST])
        score = rate(*f.own_penalty(z, cov, a), f.n, m.total[TEST], m.square[TEST], use_corr, not weights)
        if weights and use_corr:
            score = np.where(np.isnan(score), 0.0, score)
        return score, (f.v @ (z * f.damped(a).T)).T if weights else None


def pick_alpha(cv_mean: np.ndarray, digits: int | None) -> np.ndarray:
    """First index of the maximum over axis 0 (alphas)."""
    s = cv_mean if digits is None else np.round(cv_mean, digits)
    return np.argmax(s, axis=0)
