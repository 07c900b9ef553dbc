"""Formulas and design matrices: terms become lists of double columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...errors import DisclosureError
from ..frame import PrivateFrame, is_numeric

NAME = re.compile(r"^[A-Za-z_]\w*$")
LEVELS = 200


@dataclass
class Formula:
    y: str
    terms: list[tuple[str, ...]]  # each a tuple of factors, "C(x)" or "x"
    intercept: bool = True
    fe: list[tuple[str, ...]] = field(default_factory=list)
    endog: list[str] = field(default_factory=list)
    instruments: list[str] = field(default_factory=list)


def _factor(text: str) -> str:
    text = text.strip()
    m = re.fullmatch(r"C\(\s*([A-Za-z_]\w*)\s*\)", text)
    if m:
        return f"C({m[1]})"
    if not NAME.match(text):
        raise DisclosureError("formula: a term is a column, C(column), a:b or a*b")
    return text


def _terms(text: str) -> tuple[list[tuple[str, ...]], bool]:
    terms, intercept = [], True
    for part in re.findall(r"[+-]?[^+-]+", text):
        sign, body = ("-", part[1:]) if part.startswith("-") else ("+", part.lstrip("+"))
        body = body.strip()
        if body in ("0", "1"):
            intercept = body == "1" and sign == "+" if not (body == "0") else False
            if body == "1" and sign == "-":
                intercept = False
            continue
        if sign == "-":
            raise DisclosureError("formula: only '- 1' can be taken away")
        if "*" in body:
            own = [_factor(f) for f in body.split("*")]
            if len(own) != 2:
                raise DisclosureError("formula: a*b joins two columns")
            terms += [(own[0],), (own[1],), tuple(own)]
        else:
            terms.append(tuple(_factor(f) for f in body.split(":")))
    return list(dict.fromkeys(terms)), intercept


def parse(text: str, panel: bool = False) -> Formula:
    if not isinstance(text, str) or text.count("~") < 1 or len(text) > 2000:
        raise DisclosureError("formula: 'outcome ~ terms' is needed")
    parts = [p.strip() for p in text.split("|")]
    if len(parts) > 1 and not panel:
        raise DisclosureError("formula: '|' is not available here")
    if parts[0].count("~") != 1:
        raise DisclosureError("formula: one '~' is needed")
    y, right = parts[0].split("~")
    if not NAME.match(y.strip()):
        raise DisclosureError("formula: the outcome is a column")
    terms, intercept = _terms(right)
    out = Formula(y.strip(), terms, intercept)
    for part in parts[1:]:
        if "~" in part:
            left, inst = part.split("~")
            out.endog, out.instruments = ([_factor(x) for x in side.split("+")] for side in (left, inst))
        elif part != "0":
            out.fe = [tuple(_factor(x) for x in f.split("^")) for f in part.split("+")]
    if len(parts) > 3:
        raise DisclosureError("formula: too many parts")
    return out


@dataclass
class Design:
    df: DataFrame  # rows without missing values
    y: Column
    names: list[str]
    columns: list[Column]
    support: dict[str, int]  # rows behind each term
    n: int
    frame: PrivateFrame


def build(frame: PrivateFrame, y: str, terms: list[tuple[str, ...]], intercept: bool = True, extra: list[str] = (), drop_small: bool = False) -> Design:
    """Text and C() factors get treatment coding, the first level being the reference."""
    used = [y, *extra, *{re.sub(r"^C\((.*)\)$", r"\1", f) for t in terms for f in t}]
    frame._need(*used)
    frame._need_support()
    df = frame._df
    for c in dict.fromkeys(used):
        df = df.where(F.col(f"`{c}`").isNotNull())
    k = frame._policy.min_n
    coded: dict[str, list[tuple[str, Column, int]]] = {}
    n = df.count()

    def factor(f: str) -> list[tuple[str, Column, int]]:
        if f not in coded:
            name = re.sub(r"^C\((.*)\)$", r"\1", f)
            c = F.col(f"`{name}`")
            if f == name and (is_numeric(frame._kind(name)) or frame._kind(name).typeName() == "boolean"):
                coded[f] = [(name, c.cast("double"), n)]
            else:
                levels = [tuple(r) for r in df.groupBy(name).count().orderBy(name).limit(LEVELS + 1).collect()]
                if len(levels) > LEVELS:
                    raise DisclosureError(f"column {name} has more than {LEVELS} levels")
                own = levels if intercept or len(coded) else levels
                coded[f] = [(f"C({name})[T.{v}]", (c == F.lit(v)).cast("double"), m) for v, m in own[1:] if not (drop_small and m < k)]
        return coded[f]

    names, columns, support = [], [], {}
    if intercept:
        names.append("Intercept")
        columns.append(F.lit(1.0))
        support["Intercept"] = n
    for t in terms:
        made = [("", F.lit(1.0), n)]
        for f in t:
            made = [((a + ":" + b) if a else b, x * z, min(s, m)) for a, x, s in made for b, z, m in factor(f)]
        if len(t) > 1 and made:  # rows in which an interaction is not zero
            counts = df.agg(*[F.count_if(x != 0) for _, x, _ in made]).first()
            made = [(a, x, min(s, c)) for (a, x, s), c in zip(made, counts)]
        for name, x, s in made:
            names.append(name)
            columns.append(x)
            support[name] = s
    yc = F.col(f"`{y}`").cast("double")
    return Design(df, yc, names, columns, support, n, frame)
