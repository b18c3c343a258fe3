"""A fast share of the registered queries against their SQL; all of them:
``python tests/oracle_check.py /root/testdata/sf0.01``."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare

FAST = (
    "skip_paths", "explode_lines", "tiered_matches", "matches_by_rule", "high_entropy_strings",
    "transition_entropy", "string_literals", "urls", "block_context", "classified_groups", "stratified_folds",
    "fp_flags", "suppression_reasons", "scan_documents", "document_risk", "change_gate", "patch_added_lines", "first_exposures",
    "category_confusion", "scenario_outcomes", "detector_metrics", "stream_scan", "stream_first_exposures",
    "stream_daily_counts",
)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir) is None


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    without = {"train_text_classifier", "cv_metrics"}
    own = {name for name in set(queries) - set(oracles) if name != "pipeline" and not name.startswith("op")}
    assert own == without


def test_entry_without_the_text_operators():
    """The driver's entry imports, with the other queries, where that subpackage is gone."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("credscan.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
assert len(entry.queries()) > 50 and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)


def test_entry_keeps_clean_texts(spark):
    assert entry.entry(spark).where("n_matches = 0").count() > 0
