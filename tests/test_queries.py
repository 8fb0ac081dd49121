"""Every query with SQL, against DuckDB."""

import pytest
from meander.queries import QUERIES, SQL

from .comparing import oracle, same

SF = "/root/testdata/sf0.001"
#: Queries whose result changes its kind with the size of the tables (grids, ranges, rounds) are compared on more of them, too.
LARGER = ("a3_raw_frames", "b11_dense_frames", "c12_repaired_mask", "c5_selection_order", "d12_nearest_valid_cell", "e3_max3_mean", "e1_single_level", "i3_grid", "i10_fingerprints", "m1_gauge_overlay", "m4_windowed_overlays", "j1_managed_steps")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", LARGER)
def test_query_on_more_rows(spark, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.01"), oracle("/root/testdata/sf0.01"), SQL[name])


def test_entry_imports_without_the_optional_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['corpus_pipeline'] = None\ntry:\n    import __spark_entry__ as e\n    print(len(e.queries()))\nexcept ModuleNotFoundError as x:\n    print(x.name, len(__import__('meander.queries').queries.QUERIES))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) >= len(SQL), out.stderr
