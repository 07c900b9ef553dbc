"""Charts of released aggregates: a specification, and text, SVG and plotly forms of it."""

from __future__ import annotations

from html import escape

from ..errors import DisclosureError
from .release import Released

KINDS = ("bar", "barh", "line", "area", "pie")


class ReleasedPlot:
    """``released.plot.bar()`` and the like."""

    def __init__(self, released: Released):
        self._released = released

    def __call__(self, kind: str = "bar") -> Released:
        if kind not in KINDS:
            raise DisclosureError(f"'{kind}' charts need single rows; choose from {', '.join(KINDS)}")
        p = self._released.payload
        if not isinstance(p, dict) or p.get("type") not in ("series", "frame"):
            raise DisclosureError("only released tables can be drawn")
        if p["type"] == "series":
            series = [{"name": p["name"], "y": p["values"]}]
        else:
            series = [{"name": c, "y": [row[i] for row in p["data"]]} for i, c in enumerate(p["columns"])]
        made = {"type": "chart", "kind": kind, "x": p["index"], "y": series[0]["y"] if series else [], "series": series, "name": p.get("name", "")}
        return Released("plot", dict(self._released.audit), made=made)

    def bar(self): return self("bar")
    def barh(self): return self("barh")
    def line(self): return self("line")
    def area(self): return self("area")
    def pie(self): return self("pie")

    def __getattr__(self, name):
        raise DisclosureError(f"'{name}' charts need single rows; choose from {', '.join(KINDS)}")


class ColumnPlot:
    """A private column draws its suppressed histogram or its box."""

    def __init__(self, column):
        self._column = column

    def hist(self, bins=10, percent=False): return self._column.hist(bins, percent)
    def box(self): return self._column.boxplot()

    def __call__(self, kind="hist"):
        return getattr(self, kind)()

    def __getattr__(self, name):
        raise DisclosureError(f"'{name}' charts need single rows; a column has hist and box")


def render(chart: dict, form: str = "spec"):
    """A chart's payload as ``spec``, ``plotly`` (a dict), ``html``, ``svg`` or ``ascii``."""
    if form == "spec":
        return chart
    x, y = chart["x"], chart["y"]
    if form == "ascii":
        top = max((abs(v) for v in y if v is not None), default=0) or 1
        width = max((len(str(v)) for v in x), default=0)
        return "\n".join(f"{str(a):<{width}} | " + ("(suppressed)" if b is None else "#" * round(40 * abs(b) / top) + f" {b:g}") for a, b in zip(x, y))
    if form == "plotly":
        series = chart.get("series") or [{"name": chart["name"], "y": y}]
        kind = {"bar": "bar", "barh": "bar", "hist": "bar", "pie": "pie"}.get(chart["kind"], "scatter")
        if kind == "pie":
            return {"data": [{"type": "pie", "labels": x, "values": y}], "layout": {}}
        turned = chart["kind"] == "barh"
        data = [{"type": kind, "name": s["name"], ("y" if turned else "x"): x, ("x" if turned else "y"): s["y"], **({"orientation": "h"} if turned else {}), **({"fill": "tozeroy"} if chart["kind"] == "area" else {})} for s in series]
        return {"data": data, "layout": {"title": chart["name"]}}
    if form in ("svg", "html"):
        top = max((abs(v) for v in y if v is not None), default=0) or 1
        size = 560 / max(1, len(x))
        bars = "".join(f'<rect x="{20 + i * size:.1f}" y="{220 - 200 * abs(b or 0) / top:.1f}" width="{size * 0.8:.1f}" height="{200 * abs(b or 0) / top:.1f}" fill="#4477aa"><title>{escape(str(a))}: {"suppressed" if b is None else f"{b:g}"}</title></rect>' for i, (a, b) in enumerate(zip(x, y)))
        labels = "".join(f'<text x="{20 + i * size:.1f}" y="235" font-size="9">{escape(str(a))}</text>' for i, a in enumerate(x))
        svg = f'<svg xmlns="http://www.w3.org/2000/svg" width="600" height="250">{bars}{labels}</svg>'
        return svg if form == "svg" else f"<!doctype html><title>{escape(str(chart['name']))}</title>{svg}"
    raise DisclosureError("render is spec, ascii, svg, html or plotly")
