"""Every query of the subpackage runs on the smallest tables, with the columns asked for, and equals its SQL where it has one."""

import pytest

from stridelake.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import differences

COLUMNS = {
    "p2_found": ["line_id"], "p3_found": ["code_pattern"], "p4_found": ["seg_a", "seg_b"], "p5_found": ["code", "mark"], "p6_found": ["seg_id", "start_pos", "run_len"],
    "p7_found": ["seg_a", "win_a", "seg_b", "win_b"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    if name in ORACLE_SQL:
        more, less = differences(df, ORACLE_SQL[name], data)
        assert not more and not less
    else:
        rows = df.collect()
        assert len(rows) == len(set(map(str, rows)))
