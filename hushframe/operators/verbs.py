"""Statistical verbs by name, as methods of private frames and as the ``safe`` handle."""

from __future__ import annotations

import functools

from ..errors import DisclosureError
from ..policy import Policy
from .frame import PrivateFrame
from .models import causal, hypothesis, panel, regression, survival
from .models.design import Formula


def ols(frame, y, x): return regression.by_names(frame, y, x, "ols").summary()
def logit(frame, y, x): return regression.by_names(frame, y, x, "logit").summary()
def poisson(frame, y, x): return regression.by_names(frame, y, x, "poisson").summary()
def cox(frame, duration, event, x): return survival.Cox(frame, duration, event, frame._names(x)).summary_rows()
def weibull_aft(frame, duration, event, x): return survival.Aft(frame, duration, event, frame._names(x), "weibull").summary_rows()
def lognormal_aft(frame, duration, event, x): return survival.Aft(frame, duration, event, frame._names(x), "lognormal").summary_rows()
def loglogistic_aft(frame, duration, event, x): return survival.Aft(frame, duration, event, frame._names(x), "loglogistic").summary_rows()


def feols(frame, y, x, fe=(), cluster=None):
    f = Formula(y, [(c,) for c in frame._names(x)], True, [(c,) for c in frame._names(list(fe) if not isinstance(fe, str) else fe)])
    return panel.feols(frame, f, {"CRV1": cluster} if cluster else "hetero").summary()


def iv(frame, y, x, endog, instruments, fe=(), cluster=None):
    as_list = lambda v: [v] if isinstance(v, str) else list(v)
    return panel.iv(frame, y, as_list(x), as_list(endog), as_list(instruments), as_list(fe), cluster).summary()


def _on_supported_rows(verb):
    """A verb that takes rows one by one refuses those that stand for too few."""

    @functools.wraps(verb)
    def run(frame, *args, **named):
        frame._need_support()
        return verb(frame, *args, **named)

    return run


VERBS = {
    f.__name__: _on_supported_rows(f)
    for f in (
        ols, logit, poisson, cox, weibull_aft, lognormal_aft, loglogistic_aft, feols, iv,
        hypothesis.ttest, hypothesis.anova, hypothesis.mannwhitney, hypothesis.chisq, hypothesis.corr_test,
        survival.kaplan_meier, survival.logrank, survival.rmst,
        causal.ate, causal.refute_ate, causal.propensity, causal.synthetic_control,
    )
}


class Safe:
    """``safe.group_agg(df, by, value, agg)`` and every verb as a function of a frame."""

    def __init__(self, policy: Policy):
        self._policy = policy

    @staticmethod
    def _frame(df) -> PrivateFrame:
        if not isinstance(df, PrivateFrame):
            raise DisclosureError("a private frame is needed")
        return df

    def group_agg(self, df, by, value=None, agg="mean", min_n=None, round=None):
        from . import tables
        from .release import check_stat

        df = self._frame(df)
        return tables.group_agg(df, df._names(by), value, check_stat(agg), min_n, round)

    def group_agg_multi(self, df, by, value, aggs, min_n=None, round=None):
        df = self._frame(df)
        return df.groupby(by)[value].agg(list(aggs), min_n, round)

    def value_counts(self, df, column, min_n=None, round=None): return self._frame(df).value_counts(column, min_n, round)
    def crosstab(self, df, row, col, min_n=None, round=None): return self._frame(df).crosstab(row, col, min_n, round)
    def pivot_table(self, df, values, index, columns=None, aggfunc="mean", min_n=None, round=None): return self._frame(df).pivot_table(values, index, columns, aggfunc, min_n, round)

    def __getattr__(self, name):
        if name in VERBS:
            return lambda df, *a, **k: VERBS[name](self._frame(df), *a, **k)
        raise DisclosureError(f"safe.{name} is not available")


for _name, _verb in VERBS.items():
    setattr(PrivateFrame, _name, _verb)
