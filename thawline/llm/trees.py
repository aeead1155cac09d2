"""Fitted MLlib trees as plain values: split nodes, paths, column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A split ``feature <= at`` (yes, no) or a leaf with a value."""

    value: float = 0.0
    feature: int = -1
    at: float = 0.0
    yes: "Node | None" = None
    no: "Node | None" = None


def parse(debug: str) -> list[tuple[float, Node]]:
    """(weight, root) of each tree in the ``toDebugString`` of an ensemble or of one tree."""
    lines = [x.strip() for x in debug.splitlines() if x.strip()]
    at = 0

    def read() -> Node:
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.match(r"Predict: (\S+)", line):
            return Node(value=float(m[1]))
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        yes = read()
        at += 1  # Else
        return Node(feature=int(m[1]), at=float(m[2]), yes=yes, no=read())

    trees, weight = [], 1.0
    while at < len(lines):
        if m := re.match(r"Tree \d+ \(weight (\S+)\):", lines[at]):
            weight, at = float(m[1]), at + 1
        elif lines[at].startswith(("If", "Predict")):
            trees.append((weight, read()))
        else:
            at += 1
    return trees


def paths(node: Node, so_far: tuple = ()) -> list[tuple]:
    """Every path from the root, inner ones too, as ((feature, is_at_most, at), ...)."""
    if node.yes is None:
        return []
    out = []
    for branch, is_at_most in ((node.yes, True), (node.no, False)):
        path = (*so_far, (node.feature, is_at_most, node.at))
        out += [path, *paths(branch, path)]
    return out


def expression(node: Node, features: list[Column]) -> Column:
    if node.yes is None:
        return F.lit(node.value)
    return F.when(features[node.feature] <= node.at, expression(node.yes, features)).otherwise(expression(node.no, features))


def boosted(trees: list[tuple[float, Node]], features: list[Column]) -> Column:
    """Probability of the positive class of a gradient-boosted classifier."""
    margin = F.lit(0.0)
    for weight, root in trees:
        margin = margin + weight * expression(root, features)
    return 1.0 / (1.0 + F.exp(-2.0 * margin))
