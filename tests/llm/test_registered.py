from __future__ import annotations

import re

import __spark_entry__ as registered


def test_nothing_is_missing():
    """A broken import in the package would leave its queries out without a word."""
    names = registered.queries()
    numbers = {int(found[1]) for found in (re.match(r"op(\d+)_", name) for name in names) if found}
    assert numbers == set(range(1, 14)) and "pipeline" in names
    assert set(registered.oracle_sql()) <= set(names)
