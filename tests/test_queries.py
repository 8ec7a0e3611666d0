"""Every registered core query against its SQL, those without SQL against plain Python."""

import re
from collections import Counter

import pytest

from studyloom.plans import registry
from tests.oracle import same, tables

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return tables(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, SQL[name])


def test_the_queries_without_sql_are_known():
    assert set(QUERIES) - set(SQL) == {"clean_names", "hashed_embeddings", "topic_pieces"}


def test_clean_names(spark, sf, con):
    def clean(x):
        x = re.sub(r"[\x00-\x1f\x7f]", " ", x)
        x = re.sub(r"(?<=\b[A-Z]) (?=[A-Z]\b)", "", x)
        return re.sub(r"\s+", " ", re.sub(r"\s+([,.;:!?])", r"\1", x)).strip()

    want = Counter(clean(r[0]) if r[0] is not None else None for r in con.execute("SELECT chapter FROM chunk").fetchall())
    assert {r.chapter: r.n for r in QUERIES["clean_names"](spark, sf).collect()} == dict(want)


def test_hashed_embeddings(spark, sf):
    rows = QUERIES["hashed_embeddings"](spark, sf).collect()
    again = {(r.chunk_id, r.v) for r in QUERIES["hashed_embeddings"](spark, sf).collect()}
    assert len(rows) > 10 and {(r.chunk_id, r.v) for r in rows} == again
    for r in rows:
        v = [float(x) for x in r.v.split(",")]
        assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 0.01


def test_topic_pieces(spark, sf, con):
    """No character of a topic but white space at the cuts is lost, and cut topics stay under the limit by lines."""
    text = con.execute(
        "SELECT class, subject, source_file, chapter, topic_number, topic, STRING_AGG(text, chr(10) ORDER BY chunk_index, chunk_id) FROM (SELECT DISTINCT ON (chunk_id) * FROM chunk) GROUP BY ALL"
    ).fetchall()
    pieces = {}
    for r in QUERIES["topic_pieces"](spark, sf).collect():
        pieces.setdefault((r["class"], r.subject, r.source_file, r.chapter, r.topic_number, r.topic), {})[r.chunk_index] = r
    assert pieces.keys() == {t[:6] for t in text}
    for t in text:
        own = [pieces[t[:6]][n] for n in sorted(pieces[t[:6]])]
        assert "".join("".join(p.text for p in own).split()) == "".join((t[6] or "").split())
        whole = len(t[6] or "") <= 3000 or not t[4]
        assert whole == (own[0].split_method == "none") and (not whole or len(own) == 1)
