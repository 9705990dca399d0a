import subprocess
import sys

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_text_subpackage():
    code = "import importlib.util as u; real=u.find_spec; u.find_spec=lambda n,*a: None if n=='tessera.llm' else real(n,*a); import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')]; import sys; assert 'tessera.llm' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True)
