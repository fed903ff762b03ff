"""The rest stands without the text operators and their pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).parents[1]
ASK = "import __spark_entry__ as e; q = e.queries(); assert 'knn_ied' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op1_')], list(q); assert set(e.oracle_sql()) <= set(q)"


def test_imports_without_the_text_operators(tmp_path):
    for pipeline_too in (False, True):
        top = tmp_path / str(pipeline_too)
        shutil.copytree(TOP, top, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *(["corpus_pipeline.py"] if pipeline_too else [])))
        done = subprocess.run([sys.executable, "-c", ASK], cwd=top, capture_output=True, text=True, check=False)
        assert not done.returncode, done.stderr
