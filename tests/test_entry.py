import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "pronouns_per_post" in rows.columns


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 28


def test_imports_without_the_corpus_operators(tmp_path):
    """The reports stand without the corpus subpackage and the pipeline."""
    (tmp_path / "feedprofile").mkdir()
    for part in ("functions", "operators", "plans", "sources", "streaming", "__init__.py"):
        (tmp_path / "feedprofile" / part).symlink_to(ROOT / "feedprofile" / part)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'language_stats' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
