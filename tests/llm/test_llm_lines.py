import os
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from data import LINES, ROWS, documents, with_clashes  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from kestrel.llm import lines  # noqa: E402
from kestrel.llm.queries import ORACLE, op3_line_dedup  # noqa: E402


def brute(rows):
    """rows (id, text) in order of id -> {(id, text): text without covered lines}."""
    first, seen, gone = {}, [], defaultdict(set)
    for i, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        held = [k for k, x in enumerate(text.split("\n")) if any(c not in " \t\n\v\f\r" for c in x)]
        for p in range(len(held) - 2):
            body = tuple(text.split("\n")[k] for k in held[p:p + 3])
            seen.append(((i, text), p, body, held[p:p + 3]))
            first.setdefault(body, ((i, text), p))
    for doc, p, body, held in seen:
        at = first[body]
        if doc != at[0] or p >= at[1] + 3:
            gone[doc].update(held)
    return {(r[0], r[1] or ""): "\n".join(x for k, x in enumerate((r[1] or "").split("\n"))
                                          if k not in gone[r[0], r[1] or ""]) for r in rows}


def test_equals_sql_and_brute_force(spark, sf_small):
    got = op3_line_dedup(spark, sf_small).toPandas()
    ok, why = compare(got, duck(sf_small).execute(ORACLE["op3_line_dedup"]).df())
    assert ok, why
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = {k[0]: v for k, v in brute(docs).items()}
    assert dict(zip(got.doc_id, got.text)) == want
    assert (got.n_removed > 0).any()


def test_edge_rows(spark):
    rows = [r for r in ROWS if r[0] not in (7,)]  # one id with two texts is ordered by hash
    got = lines.dedup(with_clashes(documents(spark, rows))).collect()
    want = brute(rows)
    assert sorted((repr(r.doc_id), r.text) for r in got) == sorted((repr(r[0]), want[r[0], r[1] or ""]) for r in rows)
    by = {r.doc_id: r for r in got}
    assert by[1].text == "\n".join(LINES) and by[2].text == "" and by[2].n_removed == 8
    assert by[3].text == "before it\nafter it" and by[4].text == "" and by[4].n_lines == 0
    assert by[9].text == "tie tie tie tie\n" * 3 and by[9].n_removed == 6
    assert got[0].id == "clash"


def test_repeated_rows_get_the_same_result(spark):
    got = [r.text for r in lines.dedup(documents(spark)).where("doc_id = 7 and length(text) > 100").collect()]
    assert len(got) == 2 and got[0] == got[1]


def test_empty_table(spark):
    assert lines.dedup(documents(spark, [])).collect() == []
