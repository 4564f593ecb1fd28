"""The library lives without its llm subpackage and the pipeline; a broken one isn't hidden."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
RUN = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), len(e.oracle_sql()))"


def _copy(to: Path) -> Path:
    shutil.copytree(HERE / "shelfmark", to / "shelfmark", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (HERE / name).exists():
            shutil.copy(HERE / name, to / name)
    return to


def _run(at: Path):
    return subprocess.run([sys.executable, "-c", RUN], cwd=at, capture_output=True, text=True)


@pytest.mark.parametrize("left_over", [False, True])
def test_without_llm(tmp_path, left_over):
    at = _copy(tmp_path)
    shutil.rmtree(at / "shelfmark" / "llm", ignore_errors=True)
    if left_over:
        (at / "shelfmark" / "llm" / "__pycache__").mkdir(parents=True)
    (at / "corpus_pipeline.py").unlink(missing_ok=True)
    done = _run(at)
    assert done.returncode == 0, done.stderr
    every, of_llm, sql = map(int, done.stdout.split())
    assert every > 100 and of_llm == 0 and sql > 100


def test_a_broken_one_fails(tmp_path):
    at = _copy(tmp_path)
    if not (at / "shelfmark" / "llm").is_dir():
        pytest.skip("the subpackage isn't there")
    (at / "shelfmark" / "llm" / "queries.py").write_text("import no_such_module_anywhere")
    assert _run(at).returncode != 0
