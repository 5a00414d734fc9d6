"""Registered queries against DuckDB at the smallest scale; ``check_oracle.py`` runs all of them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_oracle import connect, difference

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "chunk_flat_offsets", "chunk_dispatch", "chunk_hierarchical", "chunk_hierarchical_html", "compare_query_to_document",
    "compare_pairs", "diagnostic_summary", "similarity_rank_hot", "section_summary", "content_signals", "readiness_score",
    "action_plan",
)
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 80


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_corpus_operators(tmp_path, pipeline):
    """The rest works in a copy without the optional parts, and where only their folder is gone."""
    here, copy = Path(entry.__file__).parent, tmp_path / "copy"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", "" if pipeline else "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    paths = [p for p in sys.path if p and Path(p).resolve() != here.resolve()]
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": os.pathsep.join(paths)}, capture_output=True, text=True, check=True)
    n, corpus, consistent = out.stdout.split()
    assert int(n) >= 80 and corpus == "0" and consistent == "True"


@needs_data
def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "max_similarity" in rows.columns


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    expected = connect(SF).execute(entry.oracle_sql()[name]).df()
    assert difference(entry.queries()[name](spark, SF), expected) is None
