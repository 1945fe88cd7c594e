"""Registered queries on small tables made to be odd."""

import duckdb

from millrace.operators import automaton
from millrace.plans import registry


def _repeated_pages(spark, folder):
    """Three pages of one address, the one of least id last, and one of another."""
    pages = [(4, "https://e.com/a", "late"), (3, "https://e.com/a", "middle"), (2, "https://e.com/a", "early"), (8, "https://e.com/b", "own")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")


def test_the_page_of_least_id_answers_for_an_address(spark, tmp_path):
    _repeated_pages(spark, tmp_path)
    got = {r.source: (r.classification, r.status) for r in registry.probe_classify(spark, str(tmp_path)).collect()}
    assert got == {"https://e.com/a": ("unreachable", 410), "https://e.com/b": ("reachable-current", 200)}
    assert {r.classification: r.n for r in registry.probe_counts(spark, str(tmp_path)).collect() if r.n} == {"unreachable": 1, "reachable-current": 1}
    assert {r.line: r.n for r in registry.audit_markdown(spark, str(tmp_path)).where("part = 5 AND line LIKE '%/a |%'").collect()} == {"| url | https://e.com/a | unreachable | 410 |  |  |": 1}


def test_a_link_document_is_the_page_of_least_id(spark, tmp_path):
    _repeated_pages(spark, tmp_path)
    got = {r.source: (r.classification, r.status, r.detail, r.matches) for r in registry.link_documents(spark, str(tmp_path)).collect()}
    assert got == {"https://e.com/a": ("probe-error", 200, "malformed-extracted-url", ""), "https://e.com/b": ("unreachable", 404, None, "")}


def test_link_documents_without_text_or_id(spark, tmp_path):
    """Pages without text, without an id, and with negative ones; a page with an id comes before one without."""
    pages = [(3, "https://e.com/a", None), (2, "https://e.com/b", None), (None, "https://e.com/c", "x"), (None, "https://e.com/d", "x"), (9, "https://e.com/d", "x"), (-10, "https://e.com/e", "x"), (-9, "https://e.com/f", "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.link_documents(spark, str(tmp_path)).collect()
    view = f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'"
    with duckdb.connect() as db:
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, db.execute(view).execute(registry.ORACLES["link_documents"]).fetchall()))
    never = "https://never.example.com/x"
    assert {r.source[-1]: (r.classification, r.status, r.matches) for r in got} == {
        "a": ("linked", 200, never), "b": ("probe-error", 200, ""), "c": ("reachable-current", 200, ""), "d": ("linked", 200, never), "e": ("reachable-current", 200, ""), "f": ("linked", 200, never),
    }


def _python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("+- ArrowEvalPython")


def test_lines_visit_python_once(spark, tmp_path):
    texts = [(1, "the Straße and  the\nx"), (2, ""), (3, None), (4, "a@b.co &amp; AND​ the\n"), (5, "none")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    found = registry.phrase_rules(spark, str(tmp_path))
    assert _python_steps(found) == _python_steps(registry.gate_rollup(spark, str(tmp_path))) == 1
    assert sorted((r.path, r.line_number) for r in found.collect()) == [("doc-1", 1), ("doc-4", 1)]
    rows = registry.report_rows(spark, str(tmp_path))
    assert _python_steps(rows) == 0  # ranges are drawn from what is kept, not from a second scan
    assert [(r.row, r.path, r.detector) for r in rows.orderBy("row").collect()] == [(1, "doc-1", "phrase[0]"), (2, "doc-4", "phrase[0]"), (3, "doc-4", "email_address")]
    assert sorted((r.path, r.line_number, r.line) for r in registry.line_explode(spark, str(tmp_path)).where("path <> 'doc-4'").collect()) == [("doc-1", 1, texts[0][1].split("\n")[0]), ("doc-1", 2, "x"), ("doc-5", 1, "none")]


def test_findings_of_keys_are_dealt_before_they_are_made_distinct(spark, tmp_path):
    spark.createDataFrame([(k, f"n{k}") for k in range(20)] + [(3, "n3")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    found = registry.json_key_alias(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "HashAggregate" not in plan.split("Exchange hashpartitioning(")[1]
    assert found.count() == found.distinct().count() == 2 * (1 + 1 + 3 + 7 * 5)


def test_grams_are_cut_once(spark):
    texts, needles = spark.createDataFrame([(1, "abcdefgh"), (2, None)], "_row long, _text string"), spark.createDataFrame([(7, "cdefgh"), (8, "zz")], "rule_id long, phrase string")
    met = automaton.candidates(texts, needles)
    assert "size(" not in met._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in met.collect()] == [(1, 7)]
