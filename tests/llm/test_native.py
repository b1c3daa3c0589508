"""The native operators run no Python; the package is imported by nothing outside."""

import contextlib
import io
import re
from pathlib import Path

import pytest

from rubrica.llm import queries

from .data import SF


@pytest.mark.parametrize("name", ["op5_chat_format", "op10_exact_dedup"])
def test_no_python_in_the_plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries.queries()[name](spark, SF).explain("formatted")
    assert not re.search("EvalPython|PythonUDF|InPandas|InArrow", out.getvalue())


def test_nothing_else_imports_it():
    root = Path(queries.__file__).resolve().parents[1]
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p for p in others if re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text())]


def test_every_operator_has_its_query():
    found = queries.queries()
    assert [sum(k.startswith(f"op{n}_") for k in found) for n in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(found)
