"""The entry points with and without the optional parts."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(block: str) -> list[str]:
    code = f"import sys; {block}\nimport __spark_entry__ as e; print('NAMES', *e.queries(), '|', *e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split("NAMES ")[1].split()


def test_queries_without_the_text_operators():
    found = names("sys.modules['gridloom.llm'] = None; sys.modules['corpus_pipeline'] = None")
    assert "inspect_frame" in found and not any(n.startswith("op") and n[2:3].isdigit() for n in found) and "pipeline" not in found


def test_every_oracle_has_a_query():
    found = names("pass")
    queries, oracles = found[: found.index("|")], found[found.index("|") + 1 :]
    assert set(oracles) <= set(queries) and len(set(queries)) == len(queries)


def test_flagship(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
