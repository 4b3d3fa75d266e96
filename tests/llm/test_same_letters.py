"""Records read as different fields with the same letters and digits in the same order are one group."""

from plumbline.llm import duplicates

ROWS = [
    (1, "a: 1\nb: 2\nc: 3"), (2, "a: 1\nb: 2 c: 3"), (3, "a 1 b 2 c 3"), (4, "c=3; b=2; a=1"), (5, "b: 2 | a: 1 | c: 3"),
    (6, "x: 1\ny: 2"), (7, "y=2; x=1"), (8, "other words"), (9, None), (10, "c 3 b 2 a 1"),
]


def test_groups_span_layouts(spark):
    df = spark.createDataFrame(ROWS, "row_id long, text string")
    got = {tuple(r) for r in duplicates.copies(df).collect()}
    # 1, 2 and 3 by their letters; 4 and 5 by their fields; 10 by the letters of 4
    assert got == {(1, 2), (1, 3), (1, 4), (1, 5), (1, 10), (6, 7)}
    assert {r.first_row_id: r.copies for r in duplicates.collapsed(df).collect()} == {1: 6, 6: 2, 8: 1}
