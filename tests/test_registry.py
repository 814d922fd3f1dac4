"""The registry's own helpers: no name stands for two functions."""

import ast
from collections import Counter
from pathlib import Path


def test_no_name_is_defined_twice():
    tree = ast.parse((Path(__file__).resolve().parents[1] / "ratingloom/plans/registry.py").read_text())
    names = Counter(n.name for n in tree.body if isinstance(n, ast.FunctionDef | ast.ClassDef))
    assert [n for n, k in names.items() if k > 1] == []
