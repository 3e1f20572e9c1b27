"""Routes of several stages, planned and gone."""

import pytest

from loomgate.plans import routing
from tests.test_books import database, exth, header


def test_shortest(spark):
    """Against a breadth-first search in plain Python."""
    edges = [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "a"), ("b", "b")]
    found = {(r["source"], r["target"]): list(r["stages"]) for r in routing.shortest(spark.createDataFrame(edges, "source string, target string"), 3).collect()}
    wanted = {}
    for s in {s for s, _ in edges}:
        level = {t: [t] for a, t in sorted(edges) if a == s and t != s}
        for _ in range(3):
            wanted |= {(s, t): p for t, p in level.items() if (s, t) not in wanted}
            following = {}
            for t, p in level.items():
                for a, b in edges:
                    if a == t and b != s and (s, b) not in wanted:
                        following[b] = min(following.get(b, [*p, b]), [*p, b])
            level = following
    assert found == wanted and found["a", "c"] == ["b", "c"] and ("a", "f") not in found


def test_far_conversions(spark, tmp_path):
    cues = tmp_path / "talk.srt"
    cues.write_text("1\n00:00:01,000 --> 00:00:02,000\nHello <b>there</b>\n\n2\n00:00:03,000 --> 00:00:04,000\nSecond\n")
    assert routing.plan_for(spark, str(cues), "md") == ["html", "md"]
    (name, content), = [tuple(r) for r in routing.convert_far(spark, str(cues), "markdown").collect()]
    assert name == "talk.md" and "Second" in bytes(content).decode() and "<html" not in bytes(content).decode()
    book = tmp_path / "b.mobi"
    book.write_bytes(database([header(1, metadata=exth((503, b"Title"))), b"<h2>One</h2><p>text</p>"]))
    (name, content), = [tuple(r) for r in routing.convert_far(spark, str(book), "md").collect()]
    assert name == "b.md" and "# Title" in bytes(content).decode() and "## One" in bytes(content).decode()
    table = tmp_path / "t.csv"
    table.write_text("a,b\n1,x\n")
    assert len(routing.plan_for(spark, str(table), "docx")) == 2
    (name, content), = [tuple(r) for r in routing.convert_far(spark, str(table), "docx").collect()]
    assert name == "t.docx" and bytes(content)[:2] == b"PK"


def test_no_route(spark):
    with pytest.raises(ValueError, match="No route"):
        routing.plan_for(spark, "/x/a.csv", "mp3")
    with pytest.raises(ValueError, match="Unsupported file"):
        routing.plan_for(spark, "/x/a.nothing", "md")
