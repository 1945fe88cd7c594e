"""Rule tables against unrolled rules and plain forms; bags, counts and stale evidence; the defects that were probed."""

import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import audit, automaton, bags, links, rule_tables, shapes, structured
from millrace.plans import reports, validation


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)


@pytest.mark.parametrize("max_bytes", [automaton.MAX_RULE_BYTES, 0])
def test_many_phrases_are_found_as_one_by_one(spark, max_bytes):
    rng = random.Random(1)
    words = ["alpha", "beta", "Straße", "STRASSE", "café", "x", "\U0001f600"]
    lines = [("p", i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(120)] + [("p", 500, "ten​  Commandments &amp; more"), ("q", 1, None)]
    phrases = [(i, " ".join(rng.choices(words, k=2))) for i in range(30)] + [(100, "strasse"), (101, ""), (102, "x"), (103, "Ten commandments &"), (104, "\U0001f600 x")] + [(1000 + i, f"never {i} there") for i in range(300)]
    fold = lambda t: " ".join(shapes.match_text(t or "").casefold().split())
    want = sorted((p, n, r) for p, n, t in lines for r, x in phrases if fold(x) and fold(x) in fold(t))
    got = automaton.phrase_hits(spark.createDataFrame(lines, "path string, line_number int, line string"), spark.createDataFrame(phrases, "rule_id long, phrase string"), max_bytes)
    assert sorted(map(tuple, got.collect())) == want
    assert automaton.phrase_hits(spark.createDataFrame(lines, "path string, line_number int, line string"), spark.createDataFrame([], "rule_id long, phrase string"), max_bytes).count() == 0


def test_ten_thousand_phrases_need_no_larger_plan(spark):
    lines = spark.createDataFrame([("p", i, f"line with number {i} in it") for i in range(50)], "path string, line_number int, line string")
    size = lambda n: len(automaton.phrase_hits(lines, spark.range(n).selectExpr("id AS rule_id", "concat('number ', id, ' ') AS phrase"))._jdf.queryExecution().optimizedPlan().toString())
    assert size(10_000) <= size(10) + 50
    assert automaton.phrase_hits(lines, spark.range(10_000).selectExpr("id AS rule_id", "concat('number ', id, ' in') AS phrase")).count() == 50


def test_folding_of_phrases(spark):
    lines = spark.createDataFrame([("a", 1, "in der Straße"), ("a", 2, "IN DER STRASSE"), ("a", 3, "none")], "path string, line_number int, line string")
    for phrase in ("STRASSE", "straße"):
        found = shapes.line_findings(lines, (phrase,), (), names={"phrase": "policy.forbidden_phrases"})
        assert rows(found, "line_number", "detector") == [(1, "policy.forbidden_phrases[0]"), (2, "policy.forbidden_phrases[0]")]
    pages = spark.createDataFrame([("p", "große STRASSE")], "page string, text string")
    rules = spark.createDataFrame([("p", "GROSSE", True, True), ("p", "straße", False, True)], "page string, phrase string, required boolean, folded boolean")
    assert rows(validation.page_faults(pages, rules)) == [("p", "straße", "forbidden")]


def test_odd_pages_are_findings(spark):
    rng = random.Random(3)
    marks = ["<![foo[x", "<![", "<!--", "<a href='/x'>", "</", "&#x;", "<script>", "</script>", "<?", "<!doctype", "]]>", "<![CDATA[", "\x00", "text ", "<a href=", '"']
    pages = [(0, "<![foo[x"), (1, '<a href="/ok">t</a>')] + [(2 + i, "".join(rng.choices(marks, k=rng.randint(1, 8)))) for i in range(300)]
    got = links.html_links(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert ("/ok", "navigation", None) in {tuple(r)[1:] for r in got if r.page_id == 1} and {r.error for r in got if r.page_id == 0} == {"invalid_html"}


def test_keys_over_empty_containers_and_other_records(spark):
    texts = {"a": {"secret": {}, "content": [], "a": {"token": []}}, "b": {"x": [{"Spec": "RAPP-x"}]}, "c": {"fine": {}, "spec": "other"}, "d": {"payload": {}}}
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()], "id string, text string")
    got = structured.unsafe_evidence(structured.json_leaves(docs, "id", "text", empties=True), "rapp-X")
    assert rows(got) == [("a", "$.a.token", "private_material_field"), ("a", "$.content", "private_material_field"), ("a", "$.secret", "private_material_field"), ("b", "$.x[0].Spec", "frame_material"), ("d", "$.payload", "frame_material")]


def test_lines_share_one_count_of_items(spark):
    line = json.dumps([1] * 6)
    docs = spark.createDataFrame([("a.jsonl", f"{line}\n{line}"), ("b.jsonl", line)], "path string, text string")
    got = structured.json_leaves(docs, "path", "text", max_items=10, lines=F.lit(True)).where("kind LIKE 'maximum%'")
    assert rows(got, "key", "kind") == [("a.jsonl", "maximum_collection_items")]


ITEMS = st.lists(st.tuples(st.sampled_from([None, "a", "b"]), st.sampled_from([None, 1, 2])), max_size=8)


@settings(max_examples=8, deadline=None)
@given(ITEMS, ITEMS)
def test_bags(spark, left, right):
    schema = "s string, n int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    ours, theirs = Counter(left), Counter(right)
    want = sorted(((*k, ours[k], theirs[k]) for k in ours | theirs if ours[k] != theirs[k]), key=repr)
    assert rows(bags.bag_differences(a, b, buckets=3)) == want
    assert bags.bag_equal(a, b).first()[0] is (not want)


def test_equal_bags_are_not_shuffled_whole(spark):
    a = spark.range(20_000).selectExpr("id % 700 AS k", "id AS v")
    differ = bags.bag_differences(a, a.repartition(5))
    assert differ.count() == 0
    one = a.unionByName(spark.createDataFrame([(1, 1)], "k long, v long"))
    assert rows(bags.bag_differences(a, one)) == [(1, 1, 1, 2)] and bags.open_buckets(a, one, ["k", "v"]).count() == 1


def test_stale_evidence_and_counts(spark):
    found = spark.createDataFrame([("r", "a.md", 1), ("r", "a.md", 1), ("q", "b.md", None)], "rule string, path string, line int")
    told = [{"rule": "r", "path": "a.md", "line": 1}, {"rule": "q", "path": "b.md", "line": None}, {"rule": "z", "path": "c.md", "line": 3}]
    report = spark.createDataFrame([("e", json.dumps({"findings": told, "counts": {"a": 2, "b": "3", "c": 1.5, "d": 4}}))], "id string, text string")
    assert rows(validation.stale_parts(report, {"findings": found})) == [("findings", '{"rule":"r","path":"a.md","line":1}', 1, 2), ("findings", '{"rule":"z","path":"c.md","line":3}', 1, 0)]
    counted = spark.createDataFrame([("e", "a", 2), ("e", "b", 3), ("e", "d", 5), ("e", "x", 1)], "key string, name string, n long")
    assert rows(validation.count_faults(validation.declared_counts(report, "id", "text", "$.counts"), counted)) == [("e", "b", "no number"), ("e", "c", "unexpected"), ("e", "d", "mismatch"), ("e", "x", "missing")]


def test_host_rules_take_the_longest_domain(spark):
    hosts = spark.createDataFrame([("A.b.Example.com",), ("xexample.com",), ("example.com",), (None,), ("",), ("10.0.0.1",)], "host string")
    rules = spark.createDataFrame([(".Example.com", "block"), ("b.example.com", "allow"), ("com", "top"), ("b.example.com", "zzz")], "domain string, verdict string")
    assert rows(rule_tables.host_verdicts(hosts, rules, "none")) == sorted([("A.b.Example.com", "b.example.com", "allow"), ("xexample.com", "com", "top"), ("example.com", "example.com", "block"), (None, None, "none"), ("", None, "none"), ("10.0.0.1", None, "none")], key=repr)


def test_globs_by_table_are_those_unrolled(spark):
    from millrace.operators.inventory import categories

    globs = {"docs/**": "d", "docs/*.md": "m", "*.md": "top", "a?b/c+d.(x)": "odd", "**/z": "deep", "docs": "self"}
    paths = ["docs/a.md", "docs/x/y.md", "r.md", "axb/c+d.(x)", "axb/ccd.(x)", "q/z", "docs", "a.b"]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    got = rule_tables.glob_classes(table, spark.createDataFrame([*globs.items()], "glob string, class string"))
    want = table.select("path", F.explode(categories(F.col("path"), globs)).alias("class"))
    assert rows(got) == rows(want)


def test_folders(spark):
    declared = spark.createDataFrame([("a/b/c.md",), ("d.md",)], "path string")
    present = spark.createDataFrame([("a",), ("e",)], "folder string")
    assert rows(rule_tables.folder_faults(declared, present)) == [("a/b", "missing"), ("e", "extra")]


@pytest.mark.parametrize("max_bytes", [automaton.MAX_RULE_BYTES, 0])
def test_forbidden_addresses_by_table_are_those_by_tuple(spark, max_bytes):
    docs = spark.createDataFrame([(1, "see HTTPS://Never.example.com:443/x?a=1&amp;b=2#f."), (2, "https://never.example.com/x?a=1&b=2"), (3, "https://other.example.com/ and http://b.co/p/"), (4, None), (5, "")], "doc_id long, text string")
    forbidden = ("https://never.example.com/x?a=1&b=2", "http://b.co/p", "https://unseen.example.com/")
    table = spark.createDataFrame([(u,) for u in forbidden], "url string")
    assert rows(audit.forbidden_by_table(docs, table, max_bytes)) == rows(audit.forbidden_links(docs, forbidden))


def test_sharded_reports_are_in_order(spark, tmp_path):
    rng = random.Random(4)
    found = [(rng.choice(["b", "A", "a", "c"]), rng.choice([None, 1, 2, 3]), rng.choice("xy"), rng.choice("mn"), rng.choice([None, 5])) for _ in range(400)]
    df = spark.createDataFrame(found, "path string, line_number int, rule string, detector string, column int").repartition(5)
    key = lambda r: (r.path.lower(), r.path, r.line_number or 0, r.column or 0, r.rule, r.detector)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reports.write_shards(df, str(tmp_path / "shards"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["_shard"] for r in spark.read.parquet(str(tmp_path / "shards")).select("_shard").collect()}) > 1
    got = sorted(reports.read_shards(spark, str(tmp_path / "shards")).collect(), key=lambda r: r.row)
    assert [r.row for r in got] == [*range(1, 401)] and [*map(key, got)] == sorted(map(key, got))
    assert sorted((r.row, key(r)) for r in reports.numbered(df).collect()) == [(r.row, key(r)) for r in got]
