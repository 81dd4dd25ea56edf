"""The registered queries without the corpus folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()))"


def names_of(folder):
    out = subprocess.run([sys.executable, "-c", CODE], cwd=folder, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    number, corpus = out.stdout.split()[-2:]
    return int(number), corpus == "True"


def test_entry_imports_without_corpus_folders(tmp_path):
    """With the operators' folder gone, with or without the pipeline file, the rest is complete."""
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git")
    shutil.copytree(os.path.join(ROOT, "sievework"), tmp_path / "sievework", ignore=skip)
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    alone, corpus = names_of(tmp_path)
    assert alone > 100 and not corpus
    if os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
        assert names_of(tmp_path) == (alone, False)
