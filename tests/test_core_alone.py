"""The core does not import the optional subpackage."""

import re
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_no_module_outside_names_it():
    for path in [*(REPO / "granary").rglob("*.py"), REPO / "bench.py"]:
        if "llm" not in path.relative_to(REPO / "granary").parts if path.is_relative_to(REPO / "granary") else True:
            assert not re.search(r"^\s*(?:from|import)\s+granary\.llm", path.read_text(), re.M), path
