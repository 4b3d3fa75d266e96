"""Every core query runs on the smallest tables and equals its SQL; the library stands without the
optional subpackage."""

import importlib
import math
import subprocess
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def core():
    return importlib.import_module("plumbline.plans.registry")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(core().oracle_sql()))
def test_equals_sql(spark, db, name):
    df = core().queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = db.execute(core().oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(normal(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_stands_without_the_optional_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k[0] == 'p' and k[1].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_names():
    q, s = core().queries(), core().oracle_sql()
    assert set(s) <= set(q) and len(q) > 150


def test_a_missing_library_of_the_subpackage_keeps_nothing_else_out(tmp_path):
    import shutil

    shutil.copytree(ROOT / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "plumbline" / "llm").mkdir()
    (tmp_path / "plumbline" / "llm" / "__init__.py").write_text("")
    (tmp_path / "plumbline" / "llm" / "registry.py").write_text("import a_library_that_is_not_there\n")
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_core_tests_need_neither_folder(tmp_path):
    """Without the subpackage and its tests everything else imports, and the tests of the core collect."""
    import shutil

    shutil.copytree(ROOT / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / f, tmp_path)
    out = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stdout[-2000:]


def test_staged_tables_of_a_scope_are_deleted(spark):
    from plumbline.plans import staging

    outside = staging.stage(spark.range(3), "kept")
    with staging.scope():
        inside = staging.stage(spark.range(5), "dropped")
        path = Path(inside.inputFiles()[0].removeprefix("file://"))
        assert inside.count() == 5 and path.exists()
    assert not path.exists() and outside.count() == 3
