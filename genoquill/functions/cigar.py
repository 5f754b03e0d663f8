"""Edit paths between reference and alternate texts as CIGAR strings."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPS = re.compile(r"(\d+)([MXID=])")


def edit_path(ref: str, alt: str) -> str:
    """M, X, D and I of a cheapest global alignment; matches come first from the left."""
    n, m = len(ref), len(alt)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0], cost[0, :] = np.arange(n + 1), np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (ref[i - 1] != alt[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i > j and i and cost[i, j] == cost[i - 1, j] + 1:
            out.append("D")
            i -= 1
        elif j > i and j and cost[i, j] == cost[i, j - 1] + 1:
            out.append("I")
            j -= 1
        elif i and j and cost[i, j] == cost[i - 1, j - 1] + (ref[i - 1] != alt[j - 1]):
            out.append("M" if ref[i - 1] == alt[j - 1] else "X")
            i, j = i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            out.append("D")
            i -= 1
        else:
            out.append("I")
            j -= 1
    return "".join(reversed(out))


def generate(ref: str, alt: str) -> str:
    return "".join(f"{len(m[0])}{m[1]}" for m in re.finditer(r"(.)\1*", edit_path(ref, alt)) for m in [(m.group(0), m.group(1))])


def parse(text: str) -> list[tuple[int, str]]:
    """(count, operation) items; ValueError for other text."""
    items = [(int(n), op) for n, op in _OPS.findall(text)]
    if "".join(f"{n}{op}" for n, op in items) != text:
        raise ValueError(f"not a CIGAR: {text}")
    return items


def valid(text: str, ref: str, alt: str) -> bool:
    """Whether the operations use up ref and alt, and M and X say what the letters say."""
    i = j = 0
    try:
        items = parse(text)
    except ValueError:
        return False
    for n, op in items:
        if op in "MX=":
            a, b = ref[i : i + n], alt[j : j + n]
            if len(a) != n or len(b) != n or any((x == y) != (op != "X") for x, y in zip(a, b, strict=True)):
                return False
        i += n * (op in "MX=D")
        j += n * (op in "MX=I")
    return i == len(ref) and j == len(alt)


def edit_offset(text: str) -> int:
    """Letters of the reference before the first edit."""
    out = 0
    for n, op in parse(text):
        if op not in "M=":
            break
        out += n
    return out


def edits(text: str) -> int:
    """Letters that are exchanged, inserted or deleted."""
    return sum(n for n, op in parse(text) if op in "XID")


def is_snp(text: str) -> bool:
    items = [x for x in parse(text) if x[1] not in "M="]
    return items == [(1, "X")]


@F.pandas_udf(T.StringType())
def cigar(ref: pd.Series, alt: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], str] = {}
    out = []
    for r, a in zip(ref, alt, strict=True):
        if r is None or a is None:
            out.append(None)
            continue
        if (r, a) not in known:
            known[r, a] = generate(r, a)
        out.append(known[r, a])
    return pd.Series(out, dtype=object)
