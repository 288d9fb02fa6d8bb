import pytest

from dhwanika.llm import queries

COLUMNS = {
    "p1_found": ["utt_id", "lang"], "p2_found": ["tab", "rec_id", "canon"], "p3_found": ["term", "group_term"], "p4_found": ["src", "token", "mark"],
    "p6_found": ["tab", "id_a", "id_b"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.count() > 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]


def test_nothing_else_imports_this_package():
    import pathlib
    import re

    root = pathlib.Path(queries.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p
