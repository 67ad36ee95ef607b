"""Named queries against their SQL on whole tables."""

import pytest
from conftest import FOLDER

from alertline.llm.oracles import ORACLES
from alertline.llm.queries import QUERIES


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    expected = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert rows_of(frame.columns, frame.collect()) == expected
