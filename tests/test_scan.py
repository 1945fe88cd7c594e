"""The line scan on synthetic content: every shape, its twins, normalisation, order, digests."""

import hashlib
import json
import re

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import shapes, url_scan
from millrace.plans import reports
from millrace.plans import scan as scan_plan

def sample(pattern: str) -> str:
    """A shortest text that a pattern matches, made by walking the pattern, so that no value stands in a file."""
    kinds, wanted = re._constants, "aA1 "

    def fits(parts, char: str) -> bool:
        hit = False
        for kind, value in parts:
            hit |= kind is kinds.LITERAL and ord(char) == value or kind is kinds.RANGE and value[0] <= ord(char) <= value[1]
            hit |= kind is kinds.CATEGORY and (char == "1" if value is kinds.CATEGORY_DIGIT else char == " ")
        return hit != (parts[0][0] is kinds.NEGATE)

    def one(parts) -> str:
        return next(c for c in (*wanted, *map(chr, range(33, 127))) if fits(parts, c))

    def walk(parsed) -> str:
        out = ""
        for kind, value in parsed:
            if kind is kinds.LITERAL:
                out += chr(value)
            elif kind is kinds.IN:
                out += one(value)
            elif kind is kinds.MAX_REPEAT or kind is kinds.MIN_REPEAT:
                out += "".join(walk(value[2]) for _ in range(value[0]))
            elif kind is kinds.SUBPATTERN:
                out += walk(value[3])
            elif kind is kinds.BRANCH:
                out += walk(value[1][0])
        return out

    return walk(re._parser.parse(pattern))


SHAPED = {name: sample(pattern) for name, pattern in shapes.SHAPES.items()}


def scan(spark, rows, **options):
    content = spark.createDataFrame(rows, "path string, text string")
    lines = shapes.normalised(shapes.explode_lines(content, "path", "text"))
    return shapes.line_findings(lines, **options)


def test_every_shape_is_found_and_never_shown(spark):
    found = shapes.with_evidence(scan(spark, [(d, v + "\n") for d, v in SHAPED.items()])).collect()
    assert {(r.path, r.detector) for r in found} >= {(d, d) for d in SHAPED}
    shown = json.dumps([r.asDict() for r in found])
    assert not any(v in shown for v in SHAPED.values())


def test_twins_are_not_found(spark):
    rows = [("a", "(212) " + "555-0199"), ("b", "000" + "-45-6789"), ("c", "666" + "-45-6789"), ("d", "912" + "-45-6789"), ("e", None), ("f", "")]
    assert scan(spark, rows).count() == 0


def test_one_finding_a_line_at_its_code_point(spark):
    mail = SHAPED["email_address"]
    got = scan(spark, [("a", f"\U0001f600 {mail} and {mail}\n\n{mail}")]).collect()
    assert sorted((r.line_number, r.column) for r in got) == [(1, 3), (3, 1)]


def test_an_allowed_first_match_hides_its_line(spark):
    mail = SHAPED["email_address"]
    got = scan(spark, [("a", f"{mail} x{mail}"), ("b", f"x{mail}")], allowed={"email_address": (re.escape(mail),)}).collect()
    assert [r.path for r in got] == ["b"]


def test_obfuscation_changes_nothing(spark):
    rows = [("plain", "Blue Moon"), ("entity", "Blu&#101; Moon"), ("width", "Blue M\u200boon"), ("full", "\uff22lue Moon"), ("space", "blue   moon")]
    got = scan(spark, rows, phrases=("blue moon",), detectors=()).collect()
    assert {r.path for r in got} == {p for p, _ in rows}


def test_ownership_claims_and_contracts(spark):
    rows = [("a", "They own about 51% of it"), ("b", "30 percent of the equity"), ("c", "own goals")]
    assert {r.path for r in scan(spark, rows, detectors=()).collect()} == {"a", "b"}
    assert scan(spark, rows, contract="self-reference-safe", detectors=()).count() == 0


def test_lines_are_those_of_splitlines(spark):
    texts = ["a\nb\n", "a\r\nb", "\n", "", "a\x0bb\x0cc\x85d e", "x\n\ny"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.lines_of(F.col("t")).alias("ls")).collect()
    assert all(r.ls == texts[r.i].splitlines() for r in got)


def test_evidence_id_is_the_digest_of_sorted_json(spark):
    got = shapes.with_evidence(scan(spark, [('q"\\', SHAPED["email_address"])])).first()
    fields = {"detector": got.detector, "path": got.path, "rule": got.rule, "line": got.line_number, "column": got.column}
    told = json.dumps(fields, ensure_ascii=True, separators=(",", ":"), sort_keys=True)
    assert got.evidence_id == hashlib.sha256(told.encode()).hexdigest()[:16]


def test_report_order_does_not_hang_on_input_order(spark):
    rows = [("b", "x" + SHAPED["email_address"]), ("A", SHAPED["us_ssn"]), ("a", SHAPED["email_address"])]
    one, two = (shapes.in_report_order(scan(spark, r)).collect() for r in (rows, rows[::-1]))
    assert one == two and [r.path for r in one] == ["A", "a", "b"]


def test_counts_name_every_value_on_empty_input(spark):
    none = scan(spark, [("a", "x")])
    assert {(r.detector, r.n) for r in shapes.count_over(none, "detector", ("x", "y")).collect()} == {("x", 0), ("y", 0)}


def test_allowances_need_path_detector_and_value(spark):
    mail = SHAPED["email_address"]
    rows = [("docs/a.md", mail), ("docs/b.md", f"x{mail}"), ("src/c.md", mail)]
    by_pattern = shapes.Allowance(("email_address_values",), ("/docs/*",), (re.escape(mail),))
    by_digest = shapes.Allowance(("email_address_values",), ("/DOCS/*",), (), (hashlib.sha256(f"x{mail}".encode()).hexdigest(),))
    assert {r.path for r in scan(spark, rows, allowances=(by_pattern,)).collect()} == {"docs/b.md", "src/c.md"}
    assert {r.path for r in scan(spark, rows, allowances=(by_digest,)).collect()} == {"docs/a.md", "src/c.md"}


def test_patterns_and_repositories(spark):
    rows = [("a", "one   Blue  Moon"), ("b", "see https://GitHub.com/acme/vault/x"), ("c", "git@github.com:ACME/vault"), ("d", "acme&#47;vault"), ("e", "acme vault")]
    got = scan(spark, rows, detectors=(), patterns={"moon": "(?i)blue moon"}, repositories=("https://github.com/Acme/Vault.git", "acme/vault")).collect()
    assert {(r.path, r.detector, r.column) for r in got} == {("a", "moon", 5), ("b", "repository[0]", None), ("b", "repository[1]", None), ("c", "repository[0]", None), ("c", "repository[1]", None), ("d", "repository[1]", None)}
    assert scan(spark, rows, detectors=(), patterns={"moon": "(?i)blue moon"}, contract="synthetic-test-input").count() == 0


def test_a_contract_may_be_a_column(spark):
    lines = spark.createDataFrame([("a", 1, "51% owned", "full"), ("b", 1, "51% owned", "self-reference-safe"), ("c", 1, SHAPED["us_ssn"], "self-reference-safe")], "path string, line_number int, line string, contract string")
    assert {r.path for r in shapes.line_findings(lines, contract=F.col("contract")).collect()} == {"a", "c"}


def test_urls_in_lines(spark):
    policy = url_scan.UrlPolicy(hosts=("bad.com",), host_suffixes=(".corp",), repository_hosts=("github.com",), repositories=("own/repo",), repository_patterns=(("secret", "secret"),), filenames=("*.pem",), filename_patterns=("(?i)^plan[0-9]",))
    cases = {
        "x https://ok.com/a": set(), "\U0001f600 https://bad.com/a": {("forbidden_url_host", 3)}, "https://x.corp https://x.corp.": {("forbidden_url_host", 1)}, "https:%2F%2Fbad.com%2Fx": {("forbidden_url_host", 1)},
        "https://ok.com/%zz": {("malformed_url", 1)}, "https://ok.com:99999/": {("malformed_url", 1)}, "https://[::1/": {("malformed_url", 1)}, "ssh://u@bad.com/x/y": {("sensitive_data_shape", 1), ("forbidden_url_host", 1)},
        "https://github.com/own/repo.git/tree": set(), "https://github.com/own/secret": {("private_repository_link", 1)}, "git@github.com:o/r": {("private_repository_link", 1)}, "https://github.com/own": set(),
        "https://ok.com/d/KEY%2Epem": {("forbidden_downloadable_document", 1)}, "//ok.com/Plan1.txt/": {("forbidden_downloadable_document", 1)}, "a//ok.com/Plan1": set(), "https://b&#97;d.com": {("forbidden_url_host", 1)},
    }
    lines = shapes.normalised(shapes.explode_lines(spark.createDataFrame([(k, k) for k in cases], "path string, text string"), "path", "text"))
    found = url_scan.url_findings(lines, policy).collect()
    assert {k: {(r.rule, r.column) for r in found if r.path == k} for k in cases} == cases
    assert {r.detector for r in found if r.rule == "private_repository_link"} == {"secret", "repository_visibility_default_deny"}
    assert url_scan.url_findings(lines, policy, "synthetic-test-input").count() == 0


def test_a_source_scan_from_bytes_to_verdicts(spark):
    mail = SHAPED["email_address"]
    rows = [
        ("a.md", f"hi\n{mail}".encode()), ("b.json", b'{"password":"x","password":"y"}'), ("c.json", b'{"pass%77ord":"x"}'), ("d.bin", b"PK\x03\x04"), ("e.md", b"\xff blue moon"), ("keys/F.PEM", b"x"), ("g.md", b"https://bad.com/"),
        ("H.md", b"ok"), ("h.MD", b"ok"), ("big.md", b"x" * 300), ("../i.md", b"ok"), ("ok.jsonl", b'{"a":1}\n{"b":2}'),
    ]
    policy = scan_plan.Policy(phrases=("Blue Moon",), filenames=("*.pem",), urls=url_scan.UrlPolicy(hosts=("bad.com",)), max_bytes=200)
    found, covered = scan_plan.scan_source(spark.createDataFrame(rows, "path string, data binary"), policy)
    got = {(r.path, r.rule) for r in found.collect()}
    hidden = "redacted-path:" + hashlib.sha256(b"keys/F.PEM").hexdigest()[:16]
    assert got == {
        ("a.md", "sensitive_data_shape"), ("b.json", "invalid_structured_data"), ("c.json", "structured_data_violation"), ("d.bin", "unsupported_file_type"), ("e.md", "invalid_utf8"), ("e.md", "forbidden_phrase"),
        (hidden, "forbidden_filename"), ("g.md", "forbidden_url_host"), ("H.md", "path_collision"), ("h.MD", "path_collision"), ("big.md", "file_too_large"), ("../i.md", "path_escape"),
    }
    assert {r.path for r in covered.where("status = 'pass'").collect()} == {"ok.jsonl"} and covered.count() == len(rows)


def test_an_artifact_scan_through_its_gates(spark):
    page = '<a href="/b">b</a><a href="/none">n</a> https://ok.com/x https://no.com/ <a href="https://github.com/own/repo">r</a>'
    rows = [("index.html", page.encode()), ("b.html", b"blue moon"), ("x.json", b"{"), ("rules.txt", b"blue moon https://bad.com/"), ("extra.md", b"")]
    manifest = spark.createDataFrame([(p, "page") for p in ("index.html", "b.html", "x.json", "rules.txt", "gone.md")] + [("priv.md", "private")], "path string, class string")
    policy = scan_plan.Policy(phrases=("blue moon",), urls=url_scan.UrlPolicy(hosts=("bad.com",), repository_hosts=("github.com",), repositories=("own/repo",)))
    found, listed = scan_plan.scan_artifact(spark.createDataFrame(rows, "path string, data binary"), manifest, policy, ("site.com",), ("https://ok.com",), ("private",), ("rules.txt",))
    assert {(r.gate, r.path, r.rule) for r in found.collect()} == {
        ("inventory", "gone.md", "missing_artifact_path"), ("inventory", "priv.md", "missing_artifact_path"), ("inventory", "extra.md", "extra_artifact_path"), ("eligibility", "priv.md", "path_not_public_eligible"), ("parse", "x.json", "invalid_json"),
        ("policy", "x.json", "invalid_structured_data"), ("policy", "b.html", "forbidden_phrase"), ("policy", "rules.txt", "forbidden_url_host"), ("links", "index.html", "missing_internal_link_target"), ("links", "index.html", "unverified_external_link"),
        ("links", "rules.txt", "unverified_external_link"),
    }
    kinds = {(r.source_path, r.classification): r.target for r in reports.link_order(listed).collect()}
    assert kinds["index.html", "internal-artifact-link"] == "https://site.com/b" and kinds["index.html", "allowed-public-repository"] and kinds["index.html", "missing_internal_link_target"] is None
    assert {r.gate: r.result for r in scan_plan.gate_report(found).collect()} == dict.fromkeys(reports.GATES, "deny")
    ordered = reports.artifact_order(found).collect()
    assert ordered[0].path == "b.html" and ordered[-1].path == "x.json"


def test_sealed_files_folders_and_classes(spark):
    rows = [("a/x.md", b"same"), ("a/y.md", b"other"), ("rules.md", b"new rules"), ("b/z.md", b"")]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("a/x.md", "page"), ("a/y.md", "page"), ("rules.md", "page"), ("gone/w.md", "page")], "path string, class string")
    sealed = spark.createDataFrame([("a/x.md", digest(b"same")), ("a/y.md", digest(b"was")), ("rules.md", digest(b"old rules")), ("gone/w.md", digest(b"w"))], "path string, sha256 string")
    folders = spark.createDataFrame([("a",), ("b",), ("gone",)], "folder string")
    found, _ = scan_plan.scan_artifact(spark.createDataFrame(rows, "path string, data binary"), manifest, scan_plan.Policy(), ("site.com",), controls=("rules.md",), folders=folders, sealed=sealed)
    assert {(r.gate, r.rule, r.path) for r in found.collect()} == {
        ("inventory", "missing_artifact_path", "gone/w.md"), ("inventory", "extra_artifact_path", "b/z.md"), ("inventory", "extra_artifact_directory", "b"), ("eligibility", "artifact_commit_blob_mismatch", "a/y.md"),
        ("eligibility", "artifact_commit_blob_mismatch", "rules.md"), ("policy", "publication_control_mismatch", "rules.md"), ("policy", "publication_policy_unscanned", "gone/w.md"),
    }
    classes = spark.createDataFrame([("a/x.md", "must-be-absent"), ("rules.md", "publication-control"), ("b/z.md", "must-be-absent"), ("a/y.md", "deploy")], "path string, disposition string")
    got = scan_plan.class_findings(spark.createDataFrame(rows, "path string, data binary"), classes, manifest)
    assert {(r.rule, r.path) for r in got.collect()} == {("nondeploy_path_in_artifact_manifest", "a/x.md"), ("publication_control_manifest_mismatch", "rules.md")}


def test_the_bytes_are_scanned_once(spark, tmp_path):
    spark.createDataFrame([("a.md", b"x")], "path string, data binary").write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    plan = scan_plan.source_findings(items, scan_plan.Policy(phrases=("x",)))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ReadSchema: struct<path:string,data:binary>", plan)) == 1


def test_what_a_line_is_looked_through_in_is_computed_once(spark, tmp_path):
    rows = [("a.md", b"A@b.co and\r\nThe\tcat and  the\x0bdog\n"), ("b.md", b"\x01\x02\x03ab"), ("c.md", b"a\r\r\n\x01" + b"x" * 9000), ("d.md", "and\u2003THE \u2028a%40b.co GIT%40e.com:o/r".encode())]
    spark.createDataFrame(rows, "path string, data binary").write.parquet(str(tmp_path / "items"))
    found = scan_plan.source_findings(spark.read.parquet(str(tmp_path / "items")), scan_plan.Policy(phrases=("and the",), urls=url_scan.UrlPolicy(repository_hosts=("e.com",))))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(coalesce(") <= 4  # not once for every hint of every shape
    assert {(r.path, r.line_number, r.rule, r.column) for r in found.collect()} == {
        ("a.md", 1, "sensitive_data_shape", 1), ("a.md", 2, "forbidden_phrase", None), ("b.md", None, "unsupported_file_type", None), ("d.md", 1, "forbidden_phrase", None), ("d.md", 2, "private_repository_link", 8),
    }
