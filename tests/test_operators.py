"""Links, inventories, audit, JSON, records, sources and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import text, urls
from millrace.operators import audit, inventory, links, records, structured
from millrace.plans import reports, validation
from millrace.sources import readers
from millrace.streaming import signups


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_structured_keys():
    cases = {"pass%77ord": "password", "api&#95;key": "api_key", "customerId": "customer_id", "A B": "a_b", "%zz": "zz"}
    assert {k: text.structured_key(k) for k in cases} == cases


def test_urls(spark):
    rows = ["HTTPS://User:pw@Ex.com:443/a?q=1#f", "http://ex.com:8080", "https://ex.com/a%zz", "ftp://ex.com/", "https://[::1]/x", "https://ex.com:99999/"]
    got = spark.createDataFrame([(r,) for r in rows], "u string").select("u", urls.display_url(F.col("u")).alias("d"), urls.canonical_url(F.col("u")).alias("c"), urls.link_error(F.col("u")).alias("e"), urls.host(F.col("u")).alias("h")).collect()
    by = {r.u: r for r in got}
    assert by[rows[0]].d == "https://ex.com:443/a" and by[rows[0]].c == "https://ex.com/a?q=1" and by[rows[0]].e == "credentialed_link"
    assert by[rows[1]].d == "http://ex.com:8080/" and by[rows[1]].e is None
    assert [by[r].e for r in rows[2:]] == ["invalid_link", "invalid_link", None, "invalid_link"]
    assert by[rows[4]].h == "::1"


def test_phones_mails_and_names(spark):
    row = spark.createDataFrame([("(212) 555-0199", "1 212 555 0199", "", " A@B.c ", " Ann  Lee")], "a string, b string, c string, m string, n string")
    got = row.select(*(text.normal_phone(F.col(c)) for c in "abc"), text.normal_email(F.col("m")), text.first_word(F.col("n"))).first()
    assert tuple(got) == ("+12125550199", "+12125550199", "", "a@b.c", "Ann")


def test_links_of_a_page(spark):
    page = """<a href="/x">t</a><img SRC=y><meta property="og:url" content="https://e.com/o"><meta http-equiv=refresh content="0; url=/r">
    <script type="application/ld+json">{"url": "/s", "b": ["https://e.com/j."], "name": "/n"}</script> https://e.com/o)."""
    rows = [(1, page), (2, '<script type="application/ld+json">{'), (3, None), (4, '<script type="application/ld+json">{"a":</script>')]
    got = links.html_links(spark.createDataFrame(rows, "page_id long, html string"))
    assert values(got.where("page_id = 1"), "raw", "context")[:4] == [("/r", "navigation"), ("/s", "structured"), ("/x", "navigation"), ("https://e.com/j", "structured")]
    assert {r.page_id for r in got.where("error IS NOT NULL").collect()} == {2, 4}
    best = {r.target: r.context for r in links.one_per_target(got.where("page_id = 1")).collect()}
    assert best["https://e.com/o"] == "navigation" and best["y"] == "navigation"


def test_link_classes(spark):
    cases = {
        "/a": "internal-artifact-link", "b/": "internal-artifact-link", "/none": "missing_internal_link_target", "/../x": "missing_internal_link_target", "https://u:p@e.com/": "credentialed_link",
        "https://e.com/%zz": "invalid_link", "http://localhost/x": "forbidden_host_link", "https://x.internal/": "forbidden_host_link", "https://github.com/own/repo/tree": "allowed-public-repository",
        "https://github.com/other/repo": "unverified_repository_link", "https://ok.com/z": "allowlisted-external-origin", "https://no.com/": "unverified_external_link", "mailto:x": "invalid_link",
    }
    rows = spark.createDataFrame([(1, t, "navigation") for t in cases] + [(2, "/none", "text")], "page_id long, target string, context string")
    files = spark.createDataFrame([("a.html",), ("a/index.html",), ("b/index.html",)], "path string")
    got = links.classify(rows, F.lit("https://site.com/index.html"), ("site.com",), files, ("https://ok.com",), ("own/repo",)).collect()
    assert {r.target: r.classification for r in got if r.page_id == 1} | {"/../x": cases["/../x"]} == cases
    assert [r.classification for r in got if r.page_id == 2] == ["documented-internal-url"]


def test_inventories(spark):
    paths = spark.createDataFrame([("Alias.txt",), ("alias.TXT",), ("café.txt",), ("café.txt",), ("one.txt",)], "path string")
    assert inventory.collisions(paths, "path", text.fold(F.col("path"))).count() == 4
    items, members = (spark.createDataFrame(r, s) for r, s in (([(1,), (2,), (3,)], "k int"), ([(1, "a"), (2, "a"), (2, "b"), (4, "b")], "k int, g string")))
    assert values(inventory.partition_faults(items, members, "k", "g")) == [(2, "overlap"), (3, "unassigned"), (4, "unknown")]
    e, o = (spark.createDataFrame(r, "k int, a int, b string") for r in ([(1, 1, None), (2, 1, "x"), (3, 1, "x")], [(1, 1, None), (2, 2, "x"), (4, 1, "x")]))
    assert values(inventory.drift(e, o, "k", ["a", "b"])) == [(2, "a"), (3, "a"), (3, "b"), (4, "a"), (4, "b")]
    assert values(inventory.reconcile(e, o, "k")) == [(3, "missing"), (4, "extra")]


def test_two_kinds_of_glob(spark):
    row = spark.createDataFrame([("/a/B.txt",)], "p string")
    fits = lambda g: row.select(F.col("p").rlike(g)).first()[0]
    assert fits(inventory.name_glob("*.TXT")) and not fits(inventory.path_glob("/*.txt")) and fits(inventory.path_glob("/**.txt")) and fits(inventory.path_glob("/?/*"))
    assert row.select(inventory.single_class(F.col("p"), {"*.txt": "t"}, "o")).first()[0] == "t"
    with pytest.raises(Exception, match="several classes"):
        row.select(inventory.single_class(F.col("p"), {"*.txt": "t", "/a*": "u"}, "o")).collect()


def test_probes(spark):
    asked = spark.createDataFrame([(f"https://e.com/{k}",) for k in ("ok", "gone", "odd", "err", "miss")] + [("https://127.0.0.1/",)], "url string")
    rows = [("https://e.com/ok", 200, b"x", None), ("https://e.com/gone", 404, b"x", None), ("https://e.com/odd", 500, b"x", None), ("https://e.com/err", None, None, "DNS_ERROR"), ("https://127.0.0.1/", 200, b"x", None)]
    got = {r.source: r for r in audit.classify_probes(asked, spark.createDataFrame(rows, "url string, status int, body binary, error string")).collect()}
    assert got["https://e.com/ok"].sha256 and not got["https://e.com/gone"].sha256 and got["https://e.com/gone"].classification == "unreachable"
    assert {k[-4:]: r.detail for k, r in got.items() if r.classification == "probe-error"}.items() >= {"/odd": "http-error", "/err": "dns-error", "miss": "fixture-miss"}.items()
    assert [r.detail for k, r in got.items() if k.startswith("redacted-url:")] == ["invalid-url"]


def test_search_results(spark, tmp_path):
    items = [{"link": "https://e.com/1", "cached_url": "x"}, {"html_url": "https://e.com/2", "repository": {"fork": True}}, {"url": "http://127.0.0.1/"}, {"url": "https://e.com/4"}]
    (tmp_path / "r.json").write_text(json.dumps({"results": items}))
    got = audit.classify_search(readers.search_items(spark, str(tmp_path / "r.json")), ("https://bad.com/",))
    assert [r.classification for r in got.orderBy("n").collect()] == ["cached-indicator", "fork-indicator", "probe-error", "reachable-current"]


def test_search_signals_are_those_of_values(spark):
    never = "https://never.com/"
    items = {1: {"Cached": True}, 2: {"cached": "false"}, 3: {"cached": 0}, 4: {"is_cached": ""}, 5: {"a": [{"b": f"x {never} y"}]}, 6: {never: 1}, 7: {"link": 5, "url": "https://e.com/"}, 8: {"fork": "true"}}
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in items.items()], "n int, t string").select("n", F.parse_json("t").alias("item"))
    got = {r.n: r for r in audit.classify_search(rows, (never,)).collect()}
    assert {k for k, r in got.items() if r.classification == "cached-indicator"} == {1, 2, 5} and got[7].source == "https://e.com/"
    assert {r.classification for r in audit.classify_search(rows, ()).collect()} == {"cached-indicator"}


def test_link_documents_and_repositories(spark):
    asked = spark.createDataFrame([(f"https://e.com/{k}",) for k in "abcd"] + [("http://localhost/",)], "url string")
    bodies = {"a": b"x HTTPS://Bad.com:443/x?a=1&amp;b=2 y", "b": b"https://bad.com/x?a=1&b=2 https://e.com:99999/", "c": b"\xff https://bad.com/other"}
    answers = spark.createDataFrame([(f"https://e.com/{k}", 200, v, None) for k, v in bodies.items()] + [("https://e.com/d", 404, b"https://bad.com/x?a=1&b=2", None)], "url string, status int, body binary, error string")
    rows = audit.classify_link_documents(asked, answers, ("https://bad.com/x?a=1&b=2",)).collect()
    got = {r.source[-1]: r for r in rows if r.detail != "invalid-url"}
    assert len(rows) == 5
    assert {k: got[k].classification for k in "abcd"} == {"a": "linked", "b": "probe-error", "c": "reachable-current", "d": "unreachable"}
    assert got["a"].matches == got["b"].matches == ["https://bad.com/x"] and got["b"].detail == "malformed-extracted-url" and got["d"].matches == []
    names = {"own/repo": "own/repo", " https://github.com/own/repo.git/ ": "own/repo", "https://gitlab.com/own/repo": None, "own": None, "own/r p": None, "a/b/c": None}
    rows = spark.createDataFrame([(k,) for k in names], "v string")
    assert {r.v: r.n for r in rows.select("v", urls.repository_name(F.col("v")).alias("n")).collect()} == names


def test_forbidden_links(spark):
    rows = [(1, "see HTTPS://Bad.com:443/x/ there"), (2, "https://good.com/x"), (3, "https://bad.com/x")]
    assert values(audit.forbidden_links(spark.createDataFrame(rows, "doc_id long, text string"), ("https://bad.com/x",)), "doc_id") == [(1,), (3,)]


def test_json(spark):
    doc = {"pass%77ord": "p", "nested": [{"api&#95;key": "k", "customer": {"name": "n", "phones": ["1"], "customerId": "c"}}], "n": 1, "none": None}
    rows = [(1, json.dumps(doc)), (2, '{"key":1,"key":2}'), (3, '{"value":NaN}'), (4, None)]
    leaves = structured.json_leaves(spark.createDataFrame(rows, "id long, t string"), "id", "t", 8)
    assert {r.key for r in leaves.where("kind = 'invalid'").collect()} == {2, 3, 4}
    assert {(r.path, r.detector) for r in structured.key_findings(leaves).where("path IS NOT NULL").collect()} == {
        ("$.pass%77ord", "passwords"), ("$.nested[0].api&#95;key", "api_tokens"), ("$.nested[0].customer.name", "submitted_names"), ("$.nested[0].customer.phones[0]", "phone_number_values"), ("$.nested[0].customer.customerId", "customer_or_account_identifiers"),
    }
    assert {(r.key, r.rule) for r in structured.key_findings(leaves).where("path IS NULL").collect()} == {(k, "invalid_structured_data") for k in (2, 3, 4)}
    deep = structured.json_leaves(spark.createDataFrame([(1, '{"a":{"b":{"c":1}}}')], "id long, t string"), "id", "t", 2)
    assert values(deep, "path", "kind") == [("$.a.b.c", "maximum_nesting_depth")]


def test_json_keys_at_any_depth_and_limits(spark):
    text = '{"a":{"b":{"c":{"d":{"password":"p","empty":{}}}}},"list":[[[[[{"email":"e"}]]]]]}'
    rows = [(1, text), (2, '{"x":' * 31 + '{"ssn":"s"}' + "}" * 31), (3, '{"x":' * 32 + '{"ssn":"s"}' + "}" * 32), (4, json.dumps([{"ssn": "s"}, list(range(20_000)), {"ssn": "s"}])), (5, "[" * 100_000)]
    leaves = structured.json_leaves(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    assert {(r.key, r.path, r.detector) for r in structured.key_findings(leaves).collect()} == {
        (1, "$.a.b.c.d.password", "passwords"), (1, "$.list[0][0][0][0][0].email", "email_address_values"), (2, "$" + ".x" * 31 + ".ssn", "government_identifiers"),
        (3, "$" + ".x" * 32 + ".ssn", "maximum_nesting_depth"), (4, "$[0].ssn", "government_identifiers"), (4, "$[1]", "maximum_collection_items"), (4, "$[2]", "maximum_collection_items"), (5, None, "strict_json_parser"),
    }


def test_json_values_siblings_and_allowances(spark):
    docs = {
        "a.json": {"x": "a@b.co", "y": "2125550199", "z": "AccountKey=1", "ok": "words"}, "b.json": {"submission_id": 1, "phone": "p", "other": "o"}, "c.json": {"name": "n", "note": ""}, "d.json": {"lead": {"name": "n", "notes": "m"}},
        "terms/e.json": {"contract": "c"}, "f.json": {"contract": "c"}, "g.json": {"access_token": "<TOKEN>", "password": None, "pwd": ""},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()] + [("h.jsonl", '{"ssn":1}\n\n{"ssn":true}'), ("i.jsonl", '{"ssn":1}\n{')], "path string, text string")
    leaves = structured.json_leaves(rows, "path", "text", lines=F.col("path").endswith("l"))
    allowances = (structured.Allowance(("access_tokens",), ("/g.*",), ("<[A-Z]+>",)),)
    assert {(r.key, r.path, r.detector) for r in structured.key_findings(leaves, allowances=allowances).collect()} == {
        ("a.json", "$.x", "email_address_values"), ("a.json", "$.y", "phone_number_values"), ("a.json", "$.z", "connection_strings"), ("b.json", "$.phone", "phone_number_values"),
        ("b.json", "$.submission_id", "waitlist_submission_records"), ("b.json", "$.phone", "waitlist_submission_records"), ("b.json", "$.other", "waitlist_submission_records"),
        ("d.json", "$.lead.name", "submitted_names"), ("d.json", "$.lead.notes", "customer_notes"), ("f.json", "$.contract", "contracts_not_intentionally_published_as_customer_facing_terms"),
        ("h.jsonl", "$.ssn", "government_identifiers"), ("i.jsonl", None, "strict_json_parser"),
    }


def test_chains(spark):
    rows = [("s", 0, None, "h0"), ("s", 1, "h0", "h1"), ("s", 3, "h1", "h3"), ("t", 0, None, "g0"), ("t", 1, "x", "g1"), ("t", 1, "x", "g1"), ("u", 2, None, "k")]
    df = spark.createDataFrame(rows, "stream string, seq long, prev string, own string")
    assert values(records.chain_faults(df, "stream", "seq", "prev", "own"), "stream", "fault") == [("s", "gap"), ("t", "link"), ("t", "repeat"), ("u", "start")]
    assert values(records.head(df, "stream", "seq", "own"))[0] == ("s", 3, "h3", 3)


def test_chains_go_on_across_batches(spark, tmp_path):
    source, seen = tmp_path / "in", []
    schema = "stream_id string, seq long"
    for rows in ([("s", 0), ("s", 1), ("t", 0)], [("s", 2), ("s", 3), ("t", 2), ("u", 1)], [("s", 3), ("t", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        signups.run_chain_check(stream, str(tmp_path / "ck"), lambda df: seen.append(values(df)), "stream_id", "seq").awaitTermination()
    assert seen == [[], [("t", 2, "gap"), ("u", 1, "start")], [("s", 3, "repeat")]]
    heads = records.head(spark.createDataFrame([("s", 0, None, "h0")], "stream string, seq long, prev string, own string"), "stream", "seq", "own")
    more = spark.createDataFrame([("s", 1, "h0", "h1"), ("s", 2, "x", "h2")], "stream string, seq long, prev string, own string")
    assert values(records.chain_faults(more, "stream", "seq", "prev", "own", heads), "seq", "fault") == [(2, "link")]


def test_callbacks_mark_every_row_of_an_address(spark, tmp_path):
    rows = [("1", "A", "a@x.co", "+1", ""), ("2", "B", "A@x.co ", "+2", "old"), ("3", "C", "c@x.co", "+3", ""), ("4", "D", "d@x.co", "", "")]
    table = spark.createDataFrame(rows, "ts string, name string, email string, phone string, texted_at string")
    assert values(records.pending_texts(table), "name") == [("A",), ("C",)]
    table.write.parquet(str(tmp_path / "list/batch=-1"))
    for k, told in enumerate((" a@X.co", "nobody@x.co")):
        spark.createDataFrame([(told, f"t{k}")], "texted string, at string").coalesce(1).write.mode("append").json(str(tmp_path / "calls"))
        signups.run_callbacks(spark, str(tmp_path / "calls"), str(tmp_path / "list"), str(tmp_path / "ck")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "list/batch=1"))
    assert values(last, "name", "texted_at") == [("A", "t0"), ("B", "t0"), ("C", ""), ("D", "")] and values(records.pending_texts(last), "name") == [("C",)]


def test_markdown_of_an_audit(spark, tmp_path):
    rows = [("url", "https://e.com/a|b", "linked", 200, "h", None, ["m", "n"]), ("url", "https://e.com/b", "unreachable", None, None, "line\nbreak", [])]
    found = spark.createDataFrame(rows, "kind string, source string, classification string, status int, sha256 string, detail string, matches array<string>")
    reports.write_pair(found, audit.CLASSES, "Audit", str(tmp_path))
    lines = [r.value for r in spark.read.text(str(tmp_path / "markdown")).collect()]
    assert lines[:6] == ["# Audit", "", "Artifacts audited: **2**", "", "| Classification | Count |", "| --- | ---: |"] and "| linked | 1 |" in lines and "| probe-error | 0 |" in lines
    assert lines[-2:] == ["| url | https://e.com/a\\|b | linked | 200 | h | matches: m, n |", "| url | https://e.com/b | unreachable |  |  | line break |"]
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_evidence_that_holds_and_single_faults(spark):
    paths = ["a.md", "b.md"]
    truth = spark.createDataFrame([(p, "0" * 64, 3) for p in paths], "path string, sha256 string, size long")
    record = {c: "x" for c in validation.SOURCE_FIELDS} | {"sha256": "0" * 64, "size": 3, "git_blob_id": "a" * 40, "git_mode": "100644"}
    good = {"result": "pass", "finding_count": 0, "coverage_records": [record | {"path": p} for p in paths]}
    expected = {"result": F.lit("pass"), "finding_count": F.lit("0")}

    def faults(change):
        document = json.loads(json.dumps(good))
        change(document)
        report = spark.createDataFrame([("e", json.dumps(document))], "id string, text string")
        return {(r.check, r.field, r.fault) for r in validation.evidence_faults(report, tuple(good), expected, truth, ["sha256", "size"]).collect()}

    own = lambda d: d["coverage_records"][0]
    assert faults(lambda d: None) == set()
    assert faults(lambda d: d.update(result="deny")) == {("values", "result", "mismatch")}
    assert faults(lambda d: d.pop("finding_count")) == {("schema", "finding_count", "missing"), ("values", "finding_count", "mismatch")}
    assert faults(lambda d: own(d).update(sha256="1" * 64)) == {("truth", "sha256", "mismatch")}
    assert faults(lambda d: own(d).update(git_mode="120000", size=4)) == {("record form", "git_mode", "malformed"), ("truth", "size", "mismatch")}
    assert faults(lambda d: d["coverage_records"].pop(0)) == {("truth", "path", "absent")}
    assert faults(lambda d: own(d).update(path="c.md")) == {("truth", "path", "absent"), ("truth", "path", "unexpected")}
    assert ("record schema", "extra", "unknown") in faults(lambda d: own(d).update(extra=1))
    assert any(check == "private" for check, _, _ in faults(lambda d: own(d).update({"Secret-Value": "s"})))


def test_released_pages(spark):
    pages = spark.createDataFrame([("a", 'Hello <link rel="canonical" href="https://e.com/a/">'), ("b", "x")], "page string, text string")
    rules = spark.createDataFrame([("a", "hello", True, True), ("a", "hello", True, False), ("a", "Hello", False, False), ("b", "y", False, True), ("z", "x", True, False)], "page string, phrase string, required boolean, folded boolean")
    assert values(validation.page_faults(pages, rules)) == [("a", "Hello", "forbidden"), ("a", "hello", "missing"), ("z", "x", "no page")]
    declared = spark.createDataFrame([("a", "https://e.com/a/"), ("b", "https://e.com/b/")], "page string, canonical string")
    listed = spark.createDataFrame([("https://e.com/b/",)], "loc string")
    assert values(validation.canonical_faults(pages, declared, listed)) == [("a", "sitemap"), ("b", "canonical link")]


def test_files_of_every_kind(spark):
    cases = {b"": False, b"plain \xe9": False, b"%PDF-1": True, b"a" * 9000 + b"\0": True, b"\x01\x02\x03ab": True, b"\x01\x02\x1b\x07abcd": False, b"PK\x03\x04": True, b"GIF88a": False}
    got = spark.createDataFrame([(k,) for k in cases], "b binary").select("b", inventory.is_binary(F.col("b")).alias("x")).collect()
    assert {bytes(r.b): r.x for r in got} == cases
    kinds = {"a/b.HTML": "text/html", "x.jsonl": "application/x-ndjson", "CNAME": "text/plain", "a.b/c": "application/octet-stream", ".html": "application/octet-stream", "p.png": "image/png"}
    assert {r.p: r.m for r in spark.createDataFrame([(k,) for k in kinds], "p string").select("p", inventory.media_type(F.col("p")).alias("m")).collect()} == kinds
    entries = spark.createDataFrame([("A.txt", "x"), ("a.TXT", "y")], "path string, class string")
    with pytest.raises(Exception, match="path collision"):
        inventory.one_class_each(entries, text.fold(F.col("path"))).collect()
    assert inventory.one_class_each(entries, F.col("path")).count() == 2


def test_manifests_and_fixtures(spark, tmp_path):
    forms = {"l": "b\na\r\n\nb", "n": "b\0a\0", "j": '["b","a"]', "o": '{"files":["a","b"]}', "p": ' {"paths":["a","b"],"files":["c"]}'}
    for name, body in forms.items():
        (tmp_path / name).write_bytes(body.encode())
        assert [r.path for r in readers.manifest_paths(spark, str(tmp_path / name)).collect()] == ["a", "b"], name
    (tmp_path / "bad").write_text('{"other":1}')
    with pytest.raises(Exception, match="JSON manifest"):
        readers.manifest_paths(spark, str(tmp_path / "bad")).collect()
    answers = {"https://e.com/1": {"status": 200, "body": "é"}, "https://e.com/2": {"status": 200, "body_base64": "AP8="}, "https://e.com/3": {"status": 200, "json": {"b": "é", "a": [1]}}, "https://e.com/4": {"error": "timeout"}}
    (tmp_path / "f.json").write_text(json.dumps({"responses": answers}))
    got = {r.url[-1]: r for r in readers.fixtures(spark, str(tmp_path / "f.json")).collect()}
    assert [bytes(got[k].body) for k in "1234"] == ["é".encode(), b"\0\xff", b'{"a":[1],"b":"\\u00e9"}', b""] and got["4"].error == "timeout"
    (tmp_path / "g.json").write_text(json.dumps({"responses": {"u": {"body": "x", "json": 1}}}))
    with pytest.raises(Exception, match="one body field"):
        readers.fixtures(spark, str(tmp_path / "g.json")).collect()
    (tmp_path / "m.json").write_text(json.dumps({"paths": [{"path": "a\\b", "class": "x"}, {"path": "c", "class": "y"}]}))
    assert values(readers.artifact_classes(spark, str(tmp_path / "m.json")), "path", "class") == [("a/b", "x"), ("c", "y")]


def test_links_of_every_kind(spark):
    rows = [("a.json", '{"Url":"/x","name":"/y","b_uri":["https://e.com/1."]}'), ("b.jsonl", '{"href":"#t"}\n{'), ("c.xml", "<r a='https://e.com/2'>https://e.com/3</r>"), ("d.xml", "<r>"), ("CNAME", "https://e.com/4"), ("e.bin", "")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = links.links_of(df, "path", "text", links.suffix_kind(F.col("path")))
    assert values(got, "path", "raw", "context", "error") == [
        ("CNAME", "https://e.com/4", "text", None), ("a.json", "/x", "structured", None), ("a.json", "https://e.com/1", "structured", None), ("b.jsonl", None, None, "invalid_json"), ("c.xml", "https://e.com/2", "structured", None),
        ("c.xml", "https://e.com/3", "structured", None), ("d.xml", None, None, "invalid_xml"), ("e.bin", None, None, "unsupported_artifact_media_type"),
    ]
    own = links.links_of(df, "path", "text", links.suffix_kind(F.col("path")), ("name",))
    assert "/y" in {r.raw for r in own.collect()} and "/x" not in {r.raw for r in own.collect()}


def test_reports_on_empty_input(spark):
    empty = spark.createDataFrame([], "path string, size int, sha256 string, n_findings long, status string")
    assert json.loads(reports.render(reports.summary(empty))) == {"scanned": 0, "denied": 0, "findings": 0, "bytes": 0, "result": "pass"}
    assert values(reports.gates(spark.createDataFrame([("links",)], "gate string")), "gate", "result")[2] == ("links", "deny")


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_bytes(b"\xef\xbb\xbfhey")
    (tmp_path / "d/b.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "d/c.txt").write_bytes(b"x" * 100)
    got = {r.path[-5:]: r for r in readers.content(spark, str(tmp_path / "d"), 50).collect()}
    assert got["a.txt"].text == "hey" and got["b.bin"].text is None and got["c.txt"].sha256 is None
    (tmp_path / "m.txt").write_text("b\na\nB\na\n")
    assert [r.path for r in readers.manifest_paths(spark, str(tmp_path / "m.txt")).collect()] == ["a", "B", "b"]
    (tmp_path / "m.json").write_text(json.dumps({"source_classes": [{"class": "x", "paths": ["a", "b"]}]}))
    assert values(readers.class_map(spark, str(tmp_path / "m.json"))) == [("a", "x"), ("b", "x")]
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://e.com/</loc><priority>0.5</priority></url></urlset>")
    assert values(readers.sitemap(spark, str(tmp_path / "s.xml"))) == [("https://e.com/", 0.5)]


def test_signups_batch_and_stream(spark, tmp_path):
    rows = [("1", "Ann Lee", "A@x.co", "2125550199", "", "s"), ("2", "Ann", " a@X.co ", "", "", "s"), ("3", "", "b@x.co", "", "", "s"), ("4", "Bob", "bad", "", "", "s"), ("5", "Cy", "c@x.co", None, "n" * 3000, "s")]
    raw = spark.createDataFrame(rows, signups.SCHEMA)
    first = records.first_signups(records.clean_signups(raw), "email", "ts")
    assert values(first, "email", "name", "first_name", "phone") == [("a@x.co", "Ann Lee", "Ann", "+12125550199"), ("c@x.co", "Cy", "Cy", "")]
    assert first.agg(F.max(F.length("note"))).first()[0] == 2000
    assert values(records.pending(first, first.where("name = 'Cy'"), "email"), "email") == [("a@x.co",)]
    raw.coalesce(1).write.json(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        signups.run_signups(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "out")), "email") == [("a@x.co",), ("c@x.co",)]
