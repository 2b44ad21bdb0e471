"""The README names every problem's query and its method, and every core operator module."""

import re
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


def test_every_problem_has_a_row():
    text = (REPO / "README.md").read_text()
    rows = dict(re.findall(r"^\| (\d) [^|]*\| (\S+) \|", text, re.M))
    assert sorted(rows) == list("12345678")
    known = __spark_entry__.queries()
    if any(n.startswith("p8_") for n in known):  # the optional subpackage is there
        assert set(rows.values()) <= set(known)


def test_swapped_methods_are_stated():
    text = (REPO / "README.md").read_text()
    assert "chosen by its content" in text and "innovation variance" in text


def test_modules_are_named():
    text = (REPO / "README.md").read_text()
    for module in (REPO / "granary" / "operators").glob("[a-z]*.py"):
        assert f"operators/{module.name}" in text
