"""What a review of round 4 found, held by small tests."""

import pytest

from loomgate.operators import ordered, ranges
from loomgate.sources import split
from tests.test_books import database, header, read
from tests.test_findings_r03 import _against_sql


def test_books_of_empty_texts(spark, same, tmp_path):
    """a link's target behind which no text stands is in its section; one on the first byte of a page break is in the section that begins there."""
    documents = "SELECT i::BIGINT AS doc_id, t AS text, 's' AS source, 'en' AS lang FROM (VALUES (1, ''), (2, 'x'), (3, ''), (4, chr(3)), (5, 'é' || chr(3) || chr(3)), (6, chr(10)), (7, chr(3) || 'y'), (8, repeat('é', 1000))) d(i, t)"
    _against_sql(spark, same, tmp_path, "book_sections", documents=documents)
    text = b"abc<mbp:pagebreak/>s<a filepos=3>x</a>"
    assert read(spark, database([header(1), text]))[1] == ["abc", '<a id="filepos3"></a>s<a filepos=3>x</a>']


@pytest.mark.parametrize("texts", [["", None, "a", r"\N", r"\\N", "N", "\\", " ", "\n", "\r\n", '"', '""', ",", "\ufeff", "x\\", "\\N\n", "é\r"], ["", "007", "1"], [None, "true"], [""]])
def test_csv_of_odd_texts(spark, same, tmp_path, texts):
    """empty texts, nulls, what stands for null, and texts that look like numbers come back as they are."""
    df = spark.createDataFrame([(i, t, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    _against_sql(spark, same, tmp_path, "csv_quoted_lines", documents=f"SELECT * FROM read_parquet('{tmp_path}/in/*.parquet')")


def test_quoted_empty_cells(spark, tmp_path):
    """with a text for null, quoted empty cells are empty texts and unquoted ones null, whatever is inferred."""
    (tmp_path / "x.csv").write_text('i,a,n\n1,"",""\n2,,3\n,"-",4\n')
    rows = lambda **options: sorted(map(tuple, split.read_quoted(spark, str(tmp_path), **options).collect()), key=str)
    assert rows(null="-") == [(1, "", None), (2, None, 3), (None, None, 4)]
    assert rows() == [(1, None, None), (2, None, 3), (None, "-", 4)]


def test_leads_of_equal_offsets(spark, same, tmp_path, monkeypatch):
    """documents without a text begin where the next one does, and end there; the same in windows and in ranges."""
    documents = "SELECT i::BIGINT AS doc_id, 's' || i % 2 AS source, (CASE WHEN i % 7 < 5 THEN 0 ELSE i END)::BIGINT AS n_chars FROM range(300) r(i) ORDER BY hash(i)"
    for limit in (200_000, 0):
        monkeypatch.setattr(ranges, "WINDOW_ROWS", limit)
        _against_sql(spark, same, tmp_path, "lead_ranges", documents=documents)
    rows = [(s, i, sum(n for j, n in lengths if j < i), n) for s, lengths in (("a", [(i, i % 3 % 2) for i in range(60)]), (None, [(i, 0) for i in range(9)])) for i, n in lengths]
    df = spark.createDataFrame(rows[::-1], "k string, i long, at long, n long").repartition(3)
    for limit in (200_000, 0):
        monkeypatch.setattr(ranges, "WINDOW_ROWS", limit)
        ends = {(r["k"], r["i"]): r["end"] for r in ordered.lead_ranges(df, ["k"], "at", ("i",)).collect()}
        assert ends == {(k, i): None if i == {"a": 59, None: 8}[k] else at + n for k, i, at, n in rows}
