import pytest

from quillspark.llm import queries

COLUMNS = {"p1_found": ["id_a", "id_b"], "p2_found": ["tbl", "row_id", "defect"], "p3_found": ["tbl", "key_a", "key_b"], "p4_found": ["id", "cut_at"], "p5_found": ["id_a", "id_b"], "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id", "lang"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert len(set(map(str, rows))) == len(rows)
