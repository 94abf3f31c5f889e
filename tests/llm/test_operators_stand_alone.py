"""The subpackage is a leaf: nothing outside it and its pipeline names it."""

from pathlib import Path

REPO = Path(__file__).resolve().parents[2]


def test_nothing_else_imports_the_subpackage():
    named = [
        str(p.relative_to(REPO))
        for p in REPO.rglob("*.py")
        if "tessera.llm" in p.read_text() and not p.is_relative_to(REPO / "tessera/llm") and not p.is_relative_to(REPO / "tests/llm")
    ]
    assert sorted(named) == ["__spark_entry__.py", "corpus_pipeline.py"]


def test_no_local_checkpoint_and_no_cross_join():
    for p in [*(REPO / "tessera").rglob("*.py"), REPO / "corpus_pipeline.py"]:
        text = p.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text, p
