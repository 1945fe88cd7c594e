"""Queries over the driver's tables, each with its SQL twin for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence, text, urls
from ..operators import audit, automaton, bags, inventory, links, records, rule_tables, shapes, structured, url_scan
from . import reports, scan, validation

PHRASES = ("and the", "lorem ipsum")
CATEGORIES = {"/en/**": "english", "/de/**": "german", "/*/*.html": "page", "/**": "any"}
SINGLE = {"*.html": "page", "*/": "folder"}
DENIED = (".example.net", "casino-win.example.com")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _content(spark, sf_dir: str) -> DataFrame:
    """Documents as scanned items: a path made of the id."""
    return _t(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("path"), "text")


def _lines(spark, sf_dir: str) -> DataFrame:
    return shapes.normalised(shapes.explode_lines(_content(spark, sf_dir), "path", "text"))


URL_POLICY = url_scan.UrlPolicy(
    host_suffixes=(".example.net",), repository_hosts=("github.com", "api.github.com"), repositories=("Own/Repo.git",), repository_patterns=(("private", "^own/private"),), filenames=("*.PEM",)
)
PATTERNS = {"tion": "(?:and|the) [a-z]+tion[ ,.]"}


def _kind(n: int) -> Column:
    return F.col("page_id") % n


def url_findings(spark, d):
    """Two lines per page: its address twice, and one of six kinds of address."""
    host = urls.part(F.col("url"), 3)
    second = (
        F.when(_kind(6) == 0, F.concat(F.lit("https://github.com/own/private-"), "page_id")).when(_kind(6) == 1, "https://api.github.com/repos/own/repo/issues").when(_kind(6) == 2, F.concat(F.lit("http://user:pw@"), host, F.lit("/")))
        .when(_kind(6) == 3, "x https://a.com/%zz").when(_kind(6) == 4, "get //files.example.com/a%20b.pem,").otherwise("git@github.com:own/other.git")
    )
    text = F.concat(F.lit("see "), "url", F.lit(" and "), "url", F.lit("\n"), second)
    content = _t(spark, d, "pages").select(F.concat(F.lit("page-"), "page_id").alias("path"), text.alias("text"))
    return url_scan.url_findings(shapes.normalised(shapes.explode_lines(content, "path", "text")), URL_POLICY)


def phrase_regex(spark, d):
    return shapes.line_findings(_lines(spark, d), detectors=(), patterns=PATTERNS).where("detector = 'tion'").select("path", "line_number", "detector", "column")


def repository_needles(spark, d):
    """Customers whose text names one private repository in a way of its own."""
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, "see https://GitHub.com/Acme/Vault").when(k % 4 == 1, "git@github.com:acme/vault.git").when(k % 4 == 2, "the ac\u200bme/vault&#33;").otherwise("acme / vault")
    content = _t(spark, d, "customer").select(F.concat(F.lit("c-"), k).alias("path"), text.alias("text"))
    lines = shapes.normalised(shapes.explode_lines(content, "path", "text"))
    return shapes.line_findings(lines, detectors=(), repositories=("https://github.com/Acme/Vault.git", "Acme/Vault")).select("path", "line_number", "rule", "detector")


def filename_rules(spark, d):
    k = F.col("p_partkey")
    end = F.when(k % 4 == 0, ".PEM").when(k % 4 == 1, "/key.pem").when(k % 4 == 2, ".pem.txt").otherwise("\uff0epem")
    paths = _t(spark, d, "part").select(F.concat(F.lit("docs/"), "p_name", F.lit("-"), k, end).alias("path"))
    return inventory.filename_findings(paths, ("*.pem", "key.*"), {"ring": "(?i)ring-[0-9]*[.]"})


def media_types(spark, d):
    k = F.col("p_partkey")
    end = F.element_at(F.array(*map(F.lit, (".html", ".jsonl", ".JSON", ".odd", "", ".d/x"))), (k % 6 + 1).cast("int"))
    data = F.when(k % 7 == 0, F.unhex(F.lit("255044462D31"))).when(k % 7 == 1, F.unhex(F.lit("610062"))).when(k % 7 == 2, F.unhex(F.lit("0102036162"))).when(k % 7 == 3, F.unhex(F.lit(""))).otherwise(F.col("p_name").cast("binary"))
    binary = inventory.is_binary(data)
    return _t(spark, d, "part").select("p_partkey", binary.alias("binary"), inventory.media_type(F.concat(F.lit("a/b"), end), binary).alias("media_type"))


def declared_paths(spark, d):
    k = F.col("p_partkey")
    path = F.element_at(F.array(*map(F.lit, ("a/b.html", "/a", "a/../b", "..", "a\\b", "C:x", "", "./a", ".", "a..b/c"))), (k % 10 + 1).cast("int"))
    return _t(spark, d, "part").select("p_partkey", inventory.path_error(path).alias("error"), inventory.unsafe_path(path).alias("unsafe"))


def _linked(spark, d):
    url, n = F.col("url"), F.col("page_id")
    text = (
        F.when(n % 5 == 0, F.to_json(F.struct(url.alias("url"), F.lit("/rel").alias("about_url"), F.lit("/no").alias("name"))))
        .when(n % 5 == 1, F.concat(F.to_json(F.struct(url.alias("a"))), F.lit("\n\n"), F.to_json(F.struct(F.array(F.lit("./up")).alias("href")))))
        .when(n % 5 == 2, F.concat(F.lit('<r><x a="'), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit('"/></r>'))).when(n % 5 == 3, F.concat(F.lit("see "), url, F.lit(").")))
        .otherwise(F.concat(F.lit('<a HREF="'), url, F.lit('">t</a><img src=/i><meta http-equiv="Refresh" content="0; URL=/r">')))
    )
    kind = F.element_at(F.array(*map(F.lit, ("json", "jsonl", "xml", "txt", "html"))), (n % 5 + 1).cast("int"))
    broken = F.when(n % 50 < 5, F.when(n % 5 < 3, "{<").otherwise('<script type="application/ld+json">{')).otherwise(text)
    return links.links_of(_t(spark, d, "pages").select("page_id", broken.alias("text"), kind.alias("kind")), "page_id", "text", F.col("kind"))


def links_by_kind(spark, d):
    return _linked(spark, d)


def link_contexts(spark, d):
    """One context per target: a page that links to an address also has it in its text."""
    return links.one_per_target(_linked(spark, d).where("error IS NULL"))


def repository_references(spark, d):
    n = F.col("page_id")
    forms = ("https://API.github.com/repos/own/repo/x", "git@github.com:own/repo.git", "https://raw.githubusercontent.com/own/repo/main/f", "https://dev.azure.com/own/proj/_git/repo", "https://github.com/own%2Frepo.git).", "https://github.com/own")
    found = urls.repository_reference(F.element_at(F.array(*map(F.lit, forms)), (n % 6 + 1).cast("int")))
    return _t(spark, d, "pages").select("page_id", found["host"].alias("host"), urls.slug_key(found["slug"]).alias("slug"))


def canonical_spellings(spark, d):
    """Addresses with entities, a port and slashes at the end."""
    spelt = F.concat(F.lit(" "), F.replace(F.regexp_replace("url", "^(https?)://([^/]+)", "$1://$2:443"), F.lit("&"), F.lit("&amp;")), F.lit(" "))
    return _t(spark, d, "pages").select("page_id", urls.canonical_url(spelt).alias("canonical"))


def finding_ids_escaped(spark, d):
    """Identifiers of findings on paths that are not ASCII."""
    content = _t(spark, d, "documents").select(F.concat(F.lit("caf\u00e9\t\U0001f600-"), "doc_id").alias("path"), "text")
    found = shapes.line_findings(shapes.normalised(shapes.explode_lines(content, "path", "text")), detectors=("email_address",)).where("detector = 'email_address'")
    return shapes.with_evidence(found).select(F.regexp_extract("path", "-(.*)$", 1).cast("long").alias("doc_id"), "line_number", "evidence_id")


def record_faults(spark, d):
    """Records of pages, of which some are wrong, missing, twice or of nothing."""
    n = F.col("page_id")
    truth = _t(spark, d, "pages").select(n, F.sha2("html", 256).alias("sha256"), F.octet_length("html").alias("size"))
    told = truth.where(n % 10 != 0).select(F.when(n % 10 == 1, -n).otherwise(n).alias("page_id"), F.when(n % 10 == 2, "x").otherwise(F.col("sha256")).alias("sha256"), F.when(n % 10 == 3, F.lit(None)).otherwise(F.col("size")).alias("size"))
    return validation.record_faults(told.unionByName(told.where(n % 10 == 4)), truth, "page_id", ["sha256", "size"])


def page_phrases(spark, d):
    """Every page against what it must and must not hold."""
    rule = lambda phrase, required, folded: F.struct(F.lit(phrase).alias("phrase"), F.lit(required).alias("required"), F.lit(folded).alias("folded"))
    rules = F.explode(F.array(rule('href="/the"', True, True), rule("track(0)", False, False), rule("<ARTICLE>", True, False), rule("<b>", False, True)))
    pages = _t(spark, d, "pages").select(F.col("page_id").alias("page"), F.col("html").alias("text"))
    return validation.page_faults(pages, pages.select("page", rules.alias("r")).select("page", "r.*"))


def source_scan(spark, d):
    """All documents as files through the whole scan of a source tree, counted by rule."""
    items = _t(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("data"))
    found, _ = scan.scan_source(items, scan.Policy(phrases=PHRASES, urls=URL_POLICY))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


def artifact_gates(spark, d):
    """A site with a file per page, each with a link to the next one, through the five gates."""
    n = F.col("page_id")
    text = F.concat(F.lit('<a href="/p/'), n + 1, F.lit('.html">x</a>'), F.when(n % 7 == 0, " https://no.example.org/").otherwise(""), F.when(n % 11 == 0, " mail a@b.co").otherwise(""))
    named = _t(spark, d, "pages").withColumn("path", F.concat(F.lit("p/"), n, F.lit(".html")))
    manifest = named.where(n % 13 != 0).select("path", F.when(n % 17 == 0, "private").otherwise("page").alias("class"))
    found, _ = scan.scan_artifact(named.select("path", F.encode(text, "UTF-8").alias("data")), manifest, scan.Policy(), ("site.example.com",), excluded=("private",))
    return scan.gate_report(found)


def audit_markdown(spark, d):
    """The audit of pages as lines of Markdown."""
    kinds = probe_classify(spark, d).withColumn("kind", F.lit("url"))
    return reports.markdown(kinds, audit.CLASSES, "Audit").where("part IN (1, 3, 5)").groupBy("part", "line").agg(F.count("*").alias("n"))


def line_explode(spark, d):
    return shapes.explode_lines(_content(spark, d), "path", "text")


def shape_email(spark, d):
    return shapes.line_findings(_lines(spark, d), detectors=("email_address",)).where("detector = 'email_address'").select("path", "line_number", "detector", "column")


def shape_counts(spark, d):
    talk = _t(spark, d, "conversations").select(F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("path"), "text")
    lines = shapes.normalised(shapes.explode_lines(_content(spark, d).unionByName(talk), "path", "text"))
    return shapes.count_over(shapes.line_findings(lines).where("rule = 'sensitive_data_shape'"), "detector", tuple(shapes.SHAPES))


def finding_ids(spark, d):
    found = shapes.line_findings(_lines(spark, d), detectors=("email_address",)).where("detector = 'email_address'")
    return shapes.with_evidence(found).select("path", "line_number", "evidence_id")


def phrase_rules(spark, d):
    return shapes.line_findings(_lines(spark, d), phrases=PHRASES, detectors=()).select("path", "line_number", "rule", "detector", "column")


def doc_coverage(spark, d):
    found = shapes.line_findings(_lines(spark, d), phrases=PHRASES)
    return reports.coverage(_content(spark, d), found, "path", "text")


def report_summary(spark, d):
    return reports.summary(doc_coverage(spark, d))


def report_rows(spark, d):
    """All findings of documents, numbered in the order of a report."""
    return reports.numbered(shapes.line_findings(_lines(spark, d), phrases=PHRASES)).select("row", "path", "line_number", "rule", "detector")


def class_rules(spark, d):
    """Pages as source files whose disposition hangs on their folder, against an artifact's manifest of the pages reached by https."""
    files = _t(spark, d, "pages").select(F.col("url").alias("path"), urls.part(F.col("url"), 5).alias("at"))
    classes = files.select("path", F.when(F.col("at").startswith("/en/"), "must-be-absent").when(F.col("at").startswith("/de/"), "publication-control").otherwise("deploy").alias("disposition")).distinct()
    manifest = files.where("path LIKE 'https:%'").select("path", F.when(F.length("path") % 2 == 0, "publication-control").otherwise("page").alias("class")).distinct()
    return scan.class_findings(files, classes, manifest)


def gate_rollup(spark, d):
    policy = shapes.line_findings(_lines(spark, d), phrases=PHRASES).select(F.lit("policy").alias("gate"))
    declared = inventory.missing(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id").select(F.lit("inventory").alias("gate"))
    return reports.gates(policy.unionByName(declared))


def body_hashes(spark, d):
    return _t(spark, d, "pages").select("page_id", evidence.body_hash(F.col("html")).alias("sha256"))


def redacted_ids(spark, d):
    path = F.concat(F.lit("doc-"), "doc_id")
    return _t(spark, d, "documents").select("doc_id", evidence.redacted_path(path, F.col("lang") == "de").alias("shown"))


def url_display(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.display_url(F.col("url")).alias("shown"))


def url_canonical(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.origin(F.col("url")).alias("origin"))


def html_hrefs(spark, d):
    return links.href_links(_t(spark, d, "pages"))


def html_hrefs_parsed(spark, d):
    found = links.html_links(_t(spark, d, "pages")).where("context = 'navigation'")
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"))


def link_first(spark, d):
    return links.first_by_position(links.href_links(_t(spark, d, "pages")))


def link_dedup_priority(spark, d):
    return links.one_per_target(links.html_links(_t(spark, d, "pages")).where("error IS NULL"))


def link_classify(spark, d):
    """A site whose files are what the even pages link to."""
    found = link_dedup_priority(spark, d)
    raw = links.href_links(_t(spark, d, "pages").where("page_id % 2 = 0"))
    files = raw.select(F.concat(F.regexp_extract("raw", "^/([^?#]*)", 1), F.lit(".html")).alias("path"))
    return links.classify(found, F.lit("https://site.example.com/index.html"), ("site.example.com",), files).select("page_id", "target", "classification", "fingerprint")


def host_suffix_deny(spark, d):
    host = urls.host(F.col("url"))
    denied = F.lit(False)
    for suffix in DENIED:
        denied = denied | host.endswith(suffix)
    return _t(spark, d, "pages").where(denied).select("page_id", host.alias("host"))


def path_collision(spark, d):
    names = _t(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name")).alias("path"))
    return inventory.collisions(names, "path", text.fold(F.col("path")))


def inventory_reconcile(spark, d):
    return inventory.reconcile(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


def inventory_drift(spark, d):
    counted = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_linenumber").cast("long").alias("last"))
    declared = _t(spark, d, "orders").select("o_orderkey", F.lit(4).cast("long").alias("n"), F.lit(4).cast("long").alias("last"))
    return inventory.drift(declared, counted, "o_orderkey", ["n", "last"])


def partition_check(spark, d):
    """Customers with a large order as items; those in credit, by segment, and suppliers of the same number as members."""
    items = _t(spark, d, "orders").where("o_totalprice > 200000").select("o_custkey")
    members = _t(spark, d, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS o_custkey", "c_mktsegment AS part")
    members = members.unionByName(_t(spark, d, "supplier").selectExpr("s_suppkey AS o_custkey", "'supplier' AS part"))
    return inventory.partition_faults(items, members, "o_custkey", "part")


def category_union(spark, d):
    path = urls.part(F.col("url"), 5)
    return _t(spark, d, "pages").select("page_id", F.array_join(inventory.categories(path, CATEGORIES), ",").alias("categories"))


def single_rule(spark, d):
    return _t(spark, d, "pages").select("page_id", inventory.single_class(urls.part(F.col("url"), 5), SINGLE, "other").alias("class"))


def json_walk(spark, d):
    return structured.json_leaves(_t(spark, d, "events"), "event_id", "props").select("key", "path", "name", "value")


def json_key_alias(spark, d):
    """A JSON record per customer: one in ten repeats a key, one is nested too deep, one is a sign-up."""
    nested = '{"a":' * 40 + '"x"' + "}" * 40
    name = F.col("c_name")
    plain = F.concat(F.lit('{"customer":{"name":"'), name, F.lit('","customerId":'), F.col("c_custkey"), F.lit(',"note":"n","phones":["212"],"email":""},"pass%77ord":null,"deep":{"a":{"b":{"c":{"d":{"api&#95;key":"k"}}}}}}'))
    text = (
        F.when(F.col("c_custkey") % 10 == 0, '{"key":1,"key":2}').when(F.col("c_custkey") % 10 == 1, nested)
        .when(F.col("c_custkey") % 10 == 2, F.concat(F.lit('{"waitlist_submission":{"email":"'), F.col("c_custkey"), F.lit('@b.co","created_at":"x"}}'))).otherwise(plain)
    )
    rows = _t(spark, d, "customer").select("c_custkey", text.alias("text"))
    return structured.key_findings(structured.json_leaves(rows, "c_custkey", "text"))


def _first_of_url(pages: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of the page of least id of every address; one without an id comes last."""
    order = F.struct(F.isnull("page_id").alias("last"), "page_id")  # never null itself, so that an address whose pages have no id is answered too
    return pages.groupBy("url").agg(F.min_by(F.struct(*columns), order).alias("_first")).select("url", "_first.*")


def probe_classify(spark, d):
    pages = _t(spark, d, "pages")
    status = F.element_at(F.array(*map(F.lit, (200, 404, 410, 500))), (F.col("page_id") % 4 + 1).cast("int"))
    error = F.when(F.col("page_id") % 7 == 0, F.when(F.col("page_id") % 2 == 0, "TIMEOUT").otherwise("odd"))
    answers = _first_of_url(pages.where("page_id % 5 <> 0"), status.alias("status"), F.col("html").cast("binary").alias("body"), error.alias("error"))
    return audit.classify_probes(pages, answers)


def probe_counts(spark, d):
    return shapes.count_over(probe_classify(spark, d), "classification", audit.CLASSES)


NEVER = "https://never.example.com/x/"


def fork_cache_classify(spark, d):
    """Saved results: forks, copies by a key in another case or with a text for a value, the address in a value, and in a key."""
    n = F.col("page_id")
    fields = {
        "link": F.col("url"), "fork": n % 3 == 0, "Cached": F.when(n % 5 == 0, "false"), "is_cached": F.when(n % 5 == 1, False),
        "more": F.struct(F.when(n % 7 == 0, F.concat(F.lit("at "), F.lit(NEVER))).alias("text"), F.when(n % 7 == 1, "key").alias(NEVER.replace(".", "_"))),
    }
    item = F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    item = F.replace(item, F.lit(NEVER.replace(".", "_")), F.lit(NEVER))
    items = _t(spark, d, "pages").select(n.alias("n"), F.parse_json(item).alias("item"))
    return audit.classify_search(items, (NEVER,))


def link_documents(spark, d):
    """Pages as documents in which a forbidden address stands in another spelling, or one that cannot be read."""
    pages, n = _t(spark, d, "pages"), F.col("page_id")
    more = F.when(n % 3 == 0, " HTTPS://Never.example.com:443/x?a=1&amp;b=2#f ").when(n % 3 == 1, " https://never.example.com/x/y ").when((n % 3 == 2) & (n % 2 == 0), " https://h.example.com:99999/ ").otherwise("")
    body = F.concat(F.coalesce("html", F.lit("")), more).cast("binary")
    answers = _first_of_url(pages, F.when(n % 4 == 0, 404).otherwise(200).alias("status"), body.alias("body"), F.lit(None).cast("string").alias("error"))
    return audit.classify_link_documents(pages, answers, ("https://never.example.com/x?a=1&b=2",)).select("source", "classification", "status", "detail", F.array_join("matches", ",").alias("matches"))


def repositories(spark, d):
    """Suppliers as repositories, named in several ways, with answers of the host's API."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("own/s"), k)
    asked = _t(spark, d, "supplier").select(k, F.when(k % 3 == 0, F.concat(F.lit("https://github.com/"), name, F.lit(".git"))).when(k % 3 == 1, F.concat(F.lit(" "), name, F.lit("/"))).otherwise(F.when(k % 2 == 0, F.concat(name, F.lit("/x"))).otherwise(name)).alias("repository"))
    body = F.when(k % 4 == 0, '{"fork":true}').when(k % 4 == 1, '{"fork":false}').when(k % 4 == 2, '{"fork":"no"}').otherwise("{")
    answers = asked.where(k % 5 != 0).select(F.concat(F.lit("https://api.github.com/repos/"), name).alias("url"), F.when(k % 7 == 0, 410).otherwise(200).alias("status"), body.cast("binary").alias("body"), F.lit(None).cast("string").alias("error"))
    return audit.classify_repositories(asked, answers).select("source", "classification", "status", "detail")


def waitlist_dedup(spark, d):
    signups = _t(spark, d, "events").where("event_type = 'signup'").select("user_id", "event_id", "ts")
    return records.first_signups(signups, "user_id", "ts", "event_id").select("user_id", "event_id")


def waitlist_pending(spark, d):
    """Customers without an order above a price."""
    done = _t(spark, d, "orders").where("o_totalprice > 300000").selectExpr("o_custkey AS c_custkey")
    return records.pending(_t(spark, d, "customer").select("c_custkey", "c_name"), done, "c_custkey")


def _waitlist(spark, d):
    k = F.col("c_custkey")
    return _t(spark, d, "customer").select(
        F.concat(F.lit("t"), k).alias("ts"), F.col("c_name").alias("name"), F.concat(F.lit("c"), k % 400, F.lit("@x.co")).alias("email"), F.when(k % 4 > 0, F.concat(F.lit("+1"), k)).alias("phone"),
        F.lit("").alias("note"), F.lit("s").alias("source"), F.lit("").alias("emailed_at"), F.when(k % 5 == 0, "old").otherwise("").alias("texted_at"),
    )


def waitlist_texts(spark, d):
    """Who is still to be sent a text after callbacks for the addresses of suppliers."""
    k = F.col("s_suppkey")
    told = _t(spark, d, "supplier").select(F.concat(F.lit(" C"), k, F.lit("@X.co ")).alias("texted"), F.concat(F.lit("u"), k).alias("at"))
    return records.pending_texts(records.mark_texted(_waitlist(spark, d), told))


def seq_chain_check(spark, d):
    """All events as one chain per type: their numbers leave gaps."""
    return records.chain_faults(_t(spark, d, "events"), "event_type", "event_id")


def chain_head(spark, d):
    return records.head(_t(spark, d, "conversations").withColumn("digest", F.sha2("text", 256)), "conv_id", "turn", "digest")


def exact_duplicates(spark, d):
    return _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def revenue_by_nation(spark, d):
    """Not of the reference: a star join that shows pruning, pushdown and broadcast by size."""
    orders = _t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    customers = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    items = _t(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    by = joined.groupBy("c_nationkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))
    return by.join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "quantity", "n")


def bag_compare(spark, d):
    """Line items against themselves less one kind of row and with another kind twice: rows of different number, as bags."""
    items = _t(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag")
    made = items.where("NOT (l_returnflag = 'A' AND l_quantity = 50)").unionByName(items.where("l_returnflag = 'N' AND l_quantity = 1"))
    return bags.bag_differences(items, made)


def count_faults(spark, d):
    """Per nation a document with its customers counted by segment, some of them overlooked, against the counts made again."""
    customers = _t(spark, d, "customer")
    count = lambda rows: rows.groupBy(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"))
    told = count(customers.where("c_acctbal > -900")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("m"), F.sum("n").alias("all"))
    text = F.to_json(F.struct(F.map_concat("m", F.create_map(F.lit("all"), F.col("all"))).alias("scan_counts")))
    return validation.count_faults(validation.declared_counts(told.select("key", text.alias("text")), "key", "text", "$.scan_counts"), count(customers))


def phrase_table(spark, d):
    """Lines of documents that hold the beginning of a benchmark text, the beginnings as a table of rules."""
    rules = _t(spark, d, "benchmark").select(F.col("item_id").alias("rule_id"), F.substring("text", 1, 30).alias("phrase"))
    return automaton.phrase_hits(shapes.explode_lines(_content(spark, d), "path", "text"), rules)


def phrase_table_joined(spark, d):
    """The same by the join that holds for rules of any size."""
    rules = _t(spark, d, "benchmark").select(F.col("item_id").alias("rule_id"), F.substring("text", 1, 30).alias("phrase"))
    return automaton.phrase_hits(shapes.explode_lines(_content(spark, d), "path", "text"), rules, max_rule_bytes=0)


def host_rules(spark, d):
    """Hosts of all pages by a table of domains: the hosts that are reached by https, and all top domains."""
    pages = _t(spark, d, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"))
    rules = pages.where("url LIKE 'https:%'").select(F.col("host").alias("domain"), F.lit("block").alias("verdict")).unionByName(pages.select(F.element_at(F.split("host", "[.]"), -1).alias("domain"), F.lit("allow").alias("verdict")))
    return rule_tables.host_verdicts(pages.select("page_id", "host"), rules, "unknown")


def forbidden_table(spark, d):
    """Pages that hold an address of a table: those of all pages, as they are or with a port and in capitals."""
    pages, n = _t(spark, d, "pages"), F.col("page_id")
    host = urls.part(F.col("url"), 3)
    other = F.concat(F.upper(urls.scheme(F.col("url"))), F.lit("://"), F.upper(host), F.when(F.col("url").startswith("https"), ":443").otherwise(":80"), F.substring(F.col("url"), F.length(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)) + 1, F.lit(10_000)))
    documents = pages.select(n.alias("doc_id"), F.concat(F.lit("see "), F.when(F.length("html") % 2 == 0, F.col("url")).otherwise(other), F.lit(" .")).alias("text"))
    return audit.forbidden_by_table(documents, pages.where("url LIKE 'https:%'").select("url"))


def glob_rules(spark, d):
    """Paths of all pages by a table of globs: one per first folder, and two that begin with a wildcard."""
    paths = _t(spark, d, "pages").select(urls.part(F.col("url"), 5).alias("path")).where("path <> ''")
    head = F.regexp_extract("path", "^/([^/]+)/", 1)
    rules = paths.select(F.concat(F.lit("/"), head, F.lit("/**")).alias("glob"), F.concat(F.lit("in "), head).alias("class")).where("class <> 'in '").distinct()
    more = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(g).alias("glob"), F.lit(c).alias("class")) for g, c in (("/*/*.html", "page"), ("/**", "any"))))).alias("r")).select("r.*")
    return rule_tables.glob_classes(paths, rules.unionByName(more))


def folder_faults(spark, d):
    """Folders of a site whose files are all pages against those of the pages that are reached by https, one level deeper."""
    pages = _t(spark, d, "pages").select("url", F.regexp_replace("url", "^[a-z]+://|[?#].*$", "").alias("path"))
    present = rule_tables.folders(pages.where("url LIKE 'https:%'").select(F.concat("path", F.lit("/index/x")).alias("path")))
    return rule_tables.folder_faults(pages.select("path"), present)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        line_explode, shape_email, shape_counts, finding_ids, phrase_rules, doc_coverage, report_summary, gate_rollup, body_hashes, redacted_ids,
        url_display, url_canonical, html_hrefs, html_hrefs_parsed, link_first, link_dedup_priority, link_classify, host_suffix_deny, path_collision,
        inventory_reconcile, inventory_drift, partition_check, category_union, single_rule, json_walk, json_key_alias, probe_classify, probe_counts,
        fork_cache_classify, link_documents, repositories, waitlist_dedup, waitlist_pending, waitlist_texts, seq_chain_check, chain_head, exact_duplicates, revenue_by_nation,
        url_findings, phrase_regex, repository_needles, filename_rules, media_types, declared_paths, links_by_kind, link_contexts, repository_references,
        canonical_spellings, finding_ids_escaped, record_faults, page_phrases, audit_markdown, source_scan, artifact_gates,
        report_rows, class_rules, bag_compare, count_faults, phrase_table, phrase_table_joined, host_rules, glob_rules, folder_faults, forbidden_table,
    )
}

# --- SQL twins ---------------------------------------------------------------------------------------------

_SQL_LINES = """lines AS (SELECT path, CAST(i AS INT) AS line_number, parts[i] AS line FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i
  FROM (SELECT 'doc-' || doc_id AS path, CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS parts FROM documents)))"""
_SQL_EMAIL = "(?i)[A-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?(?:\\.[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?)+"
_SQL_MAIL = f"mails AS (SELECT path, line_number, length(regexp_extract(line, '(?s)^(.*?)(?:{_SQL_EMAIL})', 1)) + 1 AS col FROM lines WHERE regexp_matches(line, '{_SQL_EMAIL}'))"
_SQL_OWN = [p.replace("'", "''") for p in shapes.OWNERSHIP]
_SQL_PHRASES = " UNION ALL ".join(
    [f"SELECT path, line_number, 'forbidden_phrase' AS rule, 'phrase[{i}]' AS detector, NULL AS \"column\" FROM lines WHERE contains(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '{p}')" for i, p in enumerate(PHRASES)]
    + [f"SELECT path, line_number, 'ownership_percentage_claim', 'ownership[{i}]', CAST(length(regexp_extract(line, '(?s)^(.*?)(?:{p})', 1)) + 1 AS INT) FROM lines WHERE regexp_matches(line, '{p}')" for i, p in enumerate(_SQL_OWN)]
)
_SQL_URL = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?', ['s', 'h', 'p', 'q'])"
_SQL_HREFS = "hrefs AS (SELECT page_id, CAST(i - 1 AS INT) AS position, rs[i] AS raw FROM (SELECT page_id, rs, unnest(range(1, len(rs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)\\shref=\"([^\"]*)\"', 1) AS rs FROM pages)))"
_SQL_SSN = "(?:^|[^0-9])(?:00[1-9]|0[1-9][0-9]|[1-578][0-9][0-9]|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9][0-9]|[1-9][0-9]{3})(?:[^0-9]|$)"
_SQL_LINKED = """k AS (SELECT page_id, page_id % 5 AS k, page_id % 50 < 5 AS broken, url FROM pages), linked AS (
  SELECT page_id, CAST(NULL AS VARCHAR) AS raw, CAST(NULL AS VARCHAR) AS context, (['invalid_json', 'invalid_json', 'invalid_xml', NULL, 'invalid_html'])[k + 1] AS error FROM k WHERE broken AND k <> 3
  UNION ALL SELECT page_id, url, CASE k WHEN 3 THEN 'text' WHEN 4 THEN 'navigation' ELSE 'structured' END, NULL FROM k WHERE NOT broken
  UNION ALL SELECT page_id, url, 'text', NULL FROM k WHERE NOT broken AND k = 4
  UNION ALL SELECT page_id, unnest(['/i', '/r']), 'navigation', NULL FROM k WHERE NOT broken AND k = 4
  UNION ALL SELECT page_id, CASE k WHEN 0 THEN '/rel' ELSE './up' END, 'structured', NULL FROM k WHERE NOT broken AND k < 2)"""
# The shapes again, as DuckDB's expressions write them (no look-around).
_SQL_SHAPES = {
    "private_key": "(?i)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", "aws_access_key": "\\b(AKIA|ASIA)[0-9A-Z]{16}\\b", "github_token": "(?i)\\bgh[pousr]_[A-Za-z0-9]{20,255}\\b", "openai_token": "\\bsk-[A-Za-z0-9]{20,200}\\b",
    "google_api_key": "\\bAIza[A-Za-z0-9_-]{30,100}\\b", "stripe_secret_key": "(?i)\\bsk_live_[A-Za-z0-9]{16,200}\\b", "slack_token": "(?i)\\bxox[baprs]-[A-Za-z0-9-]{10,200}\\b", "jwt": "\\beyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}\\b",
    "credential_assignment": "(?i)\\b(api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|secret)\\b\\s*[:=]\\s*[\"'']?[A-Za-z0-9_./+=-]{12,}", "credential_url": "(?i)\\b[a-z][a-z0-9+.-]*://[^/\\s:@]{1,64}:[^/\\s@]{4,128}@",
    "connection_string_secret": "(?i)\\b(AccountKey|SharedAccessKey|ClientSecret)\\s*=\\s*[A-Za-z0-9+/=_-]{12,}", "webhook_secret": "(?i)https://hooks[.]slack[.]com/services/[A-Za-z0-9_-]{6,}/[A-Za-z0-9_-]{6,}/[A-Za-z0-9_-]{12,}",
    "email_address": _SQL_EMAIL, "us_ssn": _SQL_SSN, "phone_number": "(?i)\\b(phone|mobile|cell|tel)\\b\\s*[:=]?\\s*(\\+?1[\\s.-]?)?([(]\\d{3}[)]|\\d{3})[\\s.-]\\d{3}[\\s.-]\\d{4}\\b",
    "postal_address": "(?i)\\b(address|street)\\b\\s*[:=]\\s*[\"'']?\\d{1,6}\\s+[A-Za-z0-9 .''-]{2,80}\\s+(street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr)\\b", "submitted_customer_record": "(?i)[\"''](submitted_at|submission_id|waitlist_submission)[\"'']\\s*:.{0,256}[\"''](email|phone|note|customer_id|account_id)[\"'']\\s*:",
}
_SQL_FOUND = f"found AS ({_SQL_PHRASES} UNION ALL " + " UNION ALL ".join(f"SELECT path, line_number, 'sensitive_data_shape', '{d}', CAST(length(regexp_extract(line, '(?s)^(.*?)(?:{p})', 1)) + 1 AS INT) FROM lines WHERE regexp_matches(line, '{p}')" for d, p in _SQL_SHAPES.items()) + ")"
_SQL_COVER = "cover AS (SELECT 'doc-' || doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256, coalesce(n, 0) AS n_findings, CASE WHEN n > 0 THEN 'deny' ELSE 'pass' END AS status FROM documents LEFT JOIN (SELECT path, count(*) AS n FROM found GROUP BY path) f ON f.path = 'doc-' || doc_id)"
_SQL_PROBE = """probes AS (SELECT DISTINCT ON (url) url, page_id FROM pages ORDER BY url, page_id)"""

ORACLES: dict[str, str] = {
    "line_explode": f"WITH {_SQL_LINES} SELECT * FROM lines",
    "shape_email": f"WITH {_SQL_LINES}, {_SQL_MAIL} SELECT path, line_number, 'email_address' AS detector, CAST(col AS INT) AS \"column\" FROM mails",
    "shape_counts": "WITH all_lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) "
    + " UNION ALL ".join(f"SELECT '{d}' AS detector, count(*) FILTER (WHERE regexp_matches(line, '{p}')) AS n FROM all_lines" for d, p in _SQL_SHAPES.items()),
    "finding_ids": f"""WITH {_SQL_LINES}, {_SQL_MAIL} SELECT path, line_number, substr(sha256('{{"column":' || col || ',"detector":"email_address","line":' || line_number || ',"path":"' || path || '","rule":"sensitive_data_shape"}}'), 1, 16) AS evidence_id FROM mails""",
    "phrase_rules": f"WITH {_SQL_LINES} {_SQL_PHRASES}",
    "doc_coverage": f"WITH {_SQL_LINES}, {_SQL_MAIL}, {_SQL_FOUND}, {_SQL_COVER} SELECT * FROM cover",
    "report_summary": f"WITH {_SQL_LINES}, {_SQL_MAIL}, {_SQL_FOUND}, {_SQL_COVER} SELECT count(*) AS scanned, count(*) FILTER (WHERE status = 'deny') AS denied, CAST(coalesce(sum(n_findings), 0) AS BIGINT) AS findings, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, coalesce(min(status), 'pass') AS result FROM cover",
    "gate_rollup": f"""WITH {_SQL_LINES}, {_SQL_MAIL}, {_SQL_FOUND}, gates AS (SELECT unnest(['inventory', 'eligibility', 'parse', 'policy', 'links']) AS gate),
      hits AS (SELECT 'policy' AS gate FROM found UNION ALL SELECT 'inventory' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
      SELECT gate, count(h.g) AS n, CASE WHEN count(h.g) > 0 THEN 'deny' ELSE 'pass' END AS result FROM gates LEFT JOIN (SELECT gate AS g FROM hits) h ON g = gate GROUP BY gate""",
    "body_hashes": "SELECT page_id, sha256(html) AS sha256 FROM pages",
    "redacted_ids": "SELECT doc_id, CASE WHEN lang = 'de' THEN 'redacted-path:' || substr(sha256('doc-' || doc_id), 1, 16) ELSE 'doc-' || doc_id END AS shown FROM documents",
    "url_display": f"SELECT page_id, lower(u.s) || '://' || lower(u.h) || CASE WHEN u.p = '' THEN '/' ELSE u.p END AS shown FROM (SELECT page_id, {_SQL_URL} AS u FROM pages)",
    "url_canonical": f"SELECT page_id, lower(u.s) || '://' || lower(u.h) || CASE WHEN u.p IN ('', '/') THEN '/' ELSE rtrim(u.p, '/') END || CASE WHEN u.q = '?' THEN '' ELSE u.q END AS canonical, lower(u.s) || '://' || lower(u.h) AS origin FROM (SELECT page_id, {_SQL_URL} AS u FROM pages)",
    "html_hrefs": f"WITH {_SQL_HREFS} SELECT * FROM hrefs",
    "html_hrefs_parsed": f"WITH {_SQL_HREFS} SELECT page_id, count(*) AS n_links FROM hrefs WHERE raw <> '' GROUP BY page_id",
    "link_first": f"WITH {_SQL_HREFS} SELECT page_id, min(position) AS position, raw FROM hrefs GROUP BY page_id, raw",
    "link_dedup_priority": f"WITH {_SQL_HREFS} SELECT DISTINCT page_id, trim(raw) AS target, 'navigation' AS context FROM hrefs WHERE raw <> ''",
    "link_classify": f"""WITH {_SQL_HREFS}, files AS (SELECT DISTINCT regexp_extract(raw, '^/([^?#]*)', 1) AS f FROM hrefs WHERE page_id % 2 = 0), t AS (SELECT DISTINCT page_id, trim(raw) AS target FROM hrefs WHERE raw <> '')
      SELECT page_id, target, CASE WHEN contains(target, '%') THEN 'invalid_link' WHEN regexp_extract(target, '^/([^?#]*)', 1) <> '' AND regexp_extract(target, '^/([^?#]*)', 1) IN (SELECT f FROM files) THEN 'internal-artifact-link' ELSE 'missing_internal_link_target' END AS classification,
        sha256('https://site.example.com' || target) AS fingerprint FROM t""",
    "host_suffix_deny": f"SELECT page_id, lower(u.h) AS host FROM (SELECT page_id, {_SQL_URL} AS u FROM pages) WHERE " + " OR ".join(f"suffix(lower(u.h), '{s}')" for s in DENIED),
    "path_collision": """WITH names AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') ELSE p_name END AS path FROM part)
      SELECT path FROM names QUALIFY count(*) OVER (PARTITION BY lower(path)) > 1""",
    "inventory_reconcile": "SELECT DISTINCT doc_id, 'missing' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "inventory_drift": """WITH c AS (SELECT l_orderkey AS k, count(*) AS n, CAST(max(l_linenumber) AS BIGINT) AS last FROM lineitem GROUP BY 1), b AS (SELECT coalesce(o_orderkey, k) AS o_orderkey, o_orderkey IS NULL OR k IS NULL AS alone, n, last FROM orders FULL JOIN c ON o_orderkey = k)
      SELECT o_orderkey, 'n' AS field FROM b WHERE alone OR n IS DISTINCT FROM 4 UNION ALL SELECT o_orderkey, 'last' FROM b WHERE alone OR last IS DISTINCT FROM 4""",
    "partition_check": """WITH i AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000),
      m AS (SELECT k, count(DISTINCT part) AS n FROM (SELECT c_custkey AS k, c_mktsegment AS part FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey, 'supplier' FROM supplier) GROUP BY k)
      SELECT coalesce(i.k, m.k) AS o_custkey, CASE WHEN i.k IS NULL THEN 'unknown' WHEN m.k IS NULL THEN 'unassigned' ELSE 'overlap' END AS fault FROM i FULL JOIN m ON i.k = m.k WHERE i.k IS NULL OR m.k IS NULL OR n > 1""",
    "category_union": f"""SELECT page_id, concat_ws(',', 'any', CASE WHEN u.p LIKE '/en/%' THEN 'english' END, CASE WHEN u.p LIKE '/de/%' THEN 'german' END, CASE WHEN regexp_matches(u.p, '^/[^/]*/[^/]*[.]html$') THEN 'page' END) AS categories FROM (SELECT page_id, {_SQL_URL} AS u FROM pages)""",
    "single_rule": f"SELECT page_id, CASE WHEN lower(u.p) LIKE '%.html' THEN 'page' WHEN u.p LIKE '%/' THEN 'folder' ELSE 'other' END AS class FROM (SELECT page_id, {_SQL_URL} AS u FROM pages)",
    "json_walk": "SELECT event_id AS key, j.fullkey AS path, j.key AS name, CAST(j.atom ->> '$' AS VARCHAR) AS value FROM events, json_tree(props) j WHERE j.type NOT IN ('OBJECT', 'ARRAY')",
    "json_key_alias": """WITH hits(kinds, path, rule, detector) AS (VALUES ([0], NULL, 'invalid_structured_data', 'strict_json_parser'), ([1], '$' || repeat('.a', 33), 'structured_data_limit', 'maximum_nesting_depth'),
      ([2], '$.waitlist_submission.email', 'structured_data_violation', 'email_address_values'), ([2], '$.waitlist_submission.email', 'structured_data_violation', 'waitlist_submission_records'), ([2], '$.waitlist_submission.created_at', 'structured_data_violation', 'waitlist_submission_records'),
      ([3, 4, 5, 6, 7, 8, 9], '$.customer.name', 'structured_data_violation', 'submitted_names'), ([3, 4, 5, 6, 7, 8, 9], '$.customer.customerId', 'structured_data_violation', 'customer_or_account_identifiers'), ([3, 4, 5, 6, 7, 8, 9], '$.customer.note', 'structured_data_violation', 'customer_notes'),
      ([3, 4, 5, 6, 7, 8, 9], '$.customer.phones[0]', 'structured_data_violation', 'phone_number_values'), ([3, 4, 5, 6, 7, 8, 9], '$.deep.a.b.c.d.api&#95;key', 'structured_data_violation', 'api_tokens'))
      SELECT c_custkey AS key, path, rule, detector FROM customer JOIN hits ON list_contains(kinds, CAST(c_custkey % 10 AS INT))""",
    "probe_classify": f"""WITH {_SQL_PROBE}, answers AS (SELECT DISTINCT ON (url) url, page_id % 4 AS m, html, CASE WHEN page_id % 7 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'timeout' ELSE 'network-error' END END AS error FROM pages WHERE page_id % 5 <> 0 ORDER BY url, page_id),
      j AS (SELECT p.url, {_SQL_URL.replace("(url,", "(p.url,")} AS u, a.* EXCLUDE (url), a.url IS NOT NULL AS there FROM probes p LEFT JOIN answers a ON a.url = p.url)
      SELECT lower(u.s) || '://' || lower(u.h) || CASE WHEN u.p = '' THEN '/' ELSE u.p END AS source,
        CASE WHEN NOT there OR error IS NOT NULL OR m = 3 THEN 'probe-error' WHEN m = 0 THEN 'reachable-current' ELSE 'unreachable' END AS classification,
        CASE WHEN there AND error IS NULL THEN [200, 404, 410, 500][m + 1] END AS status,
        CASE WHEN there AND error IS NULL AND m = 0 THEN sha256(html) END AS sha256,
        CASE WHEN NOT there THEN 'fixture-miss' WHEN error IS NOT NULL THEN error WHEN m = 3 THEN 'http-error' END AS detail FROM j""",
    "fork_cache_classify": f"""SELECT page_id AS n, lower(u.s) || '://' || lower(u.h) || CASE WHEN u.p = '' THEN '/' ELSE u.p END AS source,
      CASE WHEN page_id % 3 = 0 THEN 'fork-indicator' WHEN page_id % 5 = 0 OR page_id % 7 = 0 THEN 'cached-indicator' ELSE 'reachable-current' END AS classification,
      CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0 THEN 'public-search-result' END AS detail FROM (SELECT page_id, {_SQL_URL} AS u FROM pages)""",
    "link_documents": f"""WITH p AS (SELECT DISTINCT ON (url) url, page_id AS n, {_SQL_URL} AS u FROM pages ORDER BY url, page_id), c AS (SELECT *, n % 4 = 0 AS gone, n % 3 = 2 AND n % 2 = 0 AS bad FROM p)
      SELECT lower(u.s) || '://' || lower(u.h) || CASE WHEN u.p = '' THEN '/' ELSE u.p END AS source, CASE WHEN gone THEN 'unreachable' WHEN bad THEN 'probe-error' WHEN n % 3 = 0 THEN 'linked' ELSE 'reachable-current' END AS classification,
      CASE WHEN gone THEN 404 ELSE 200 END AS status, CASE WHEN NOT gone AND bad THEN 'malformed-extracted-url' END AS detail, CASE WHEN NOT gone AND n % 3 = 0 THEN 'https://never.example.com/x' ELSE '' END AS matches FROM c""",
    "repositories": """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 = 2 AND s_suppkey % 2 = 0 AS odd FROM supplier), c AS (SELECT *, NOT odd AND k % 5 <> 0 AS there FROM s)
      SELECT CASE WHEN odd THEN 'redacted-url:' || substr(sha256('own/s' || k || '/x'), 1, 16) ELSE 'https://github.com/own/s' || k END AS source,
      CASE WHEN NOT there THEN 'probe-error' WHEN k % 7 = 0 THEN 'unreachable' WHEN k % 4 = 0 THEN 'fork-indicator' WHEN k % 4 = 1 THEN 'reachable-current' ELSE 'probe-error' END AS classification,
      CASE WHEN there THEN CASE WHEN k % 7 = 0 THEN 410 ELSE 200 END END AS status, CASE WHEN odd THEN 'invalid-repository' WHEN NOT there THEN 'fixture-miss' WHEN k % 7 <> 0 AND k % 4 > 1 THEN 'invalid-repository-metadata' END AS detail FROM c""",
    "waitlist_dedup": "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id",
    "waitlist_pending": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "waitlist_texts": """SELECT c_name AS name, 'c' || c_custkey % 400 || '@x.co' AS email, '+1' || c_custkey AS phone, 't' || c_custkey AS ts FROM customer
      WHERE c_custkey % 4 > 0 AND c_custkey % 5 > 0 AND c_custkey % 400 NOT IN (SELECT s_suppkey FROM supplier)""",
    "seq_chain_check": """SELECT event_type, event_id, fault FROM (SELECT event_type, event_id, CASE WHEN b IS NULL AND event_id <> 0 THEN 'start' WHEN event_id - b = 0 THEN 'repeat' WHEN event_id - b <> 1 THEN 'gap' END AS fault
      FROM (SELECT event_type, event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events)) WHERE fault IS NOT NULL""",
    "chain_head": "SELECT conv_id, max(turn) AS seq, arg_max(sha256(text), turn) AS digest, count(*) AS n FROM conversations GROUP BY conv_id",
    "exact_duplicates": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "url_findings": f"""WITH p AS (SELECT page_id AS n, 'page-' || page_id AS path, suffix(regexp_extract(url, '//([^/?#]*)', 1), '.example.net') AS net FROM pages)
      SELECT path, 1 AS line_number, 'forbidden_url_host' AS rule, 'url_policy.forbidden_host' AS detector, 5 AS "column" FROM p WHERE net
      UNION ALL SELECT path, 2, 'forbidden_url_host', 'url_policy.forbidden_host', 1 FROM p WHERE net AND n % 6 = 2
      UNION ALL SELECT path, 2, CASE n % 6 WHEN 2 THEN 'sensitive_data_shape' WHEN 3 THEN 'malformed_url' WHEN 4 THEN 'forbidden_downloadable_document' ELSE 'private_repository_link' END,
        CASE n % 6 WHEN 0 THEN 'private' WHEN 2 THEN 'credential_url' WHEN 3 THEN 'invalid_percent_encoding' WHEN 4 THEN 'url_path_forbidden_filename' ELSE 'repository_visibility_default_deny' END, CASE n % 6 WHEN 3 THEN 3 WHEN 4 THEN 5 ELSE 1 END FROM p WHERE n % 6 <> 1""",
    "phrase_regex": f"WITH {_SQL_LINES}, s AS (SELECT path, line_number, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM lines) SELECT path, line_number, 'tion' AS detector, CAST(length(regexp_extract(line, '(?s)^(.*?)(?:and|the) [a-z]+tion[ ,.]', 1)) + 1 AS INT) AS \"column\" FROM s WHERE regexp_matches(line, '(?:and|the) [a-z]+tion[ ,.]')",
    "repository_needles": "SELECT 'c-' || c_custkey AS path, 1 AS line_number, 'private_repository_link' AS rule, 'repository[' || i || ']' AS detector FROM customer, (SELECT unnest([0, 1]) AS i) WHERE c_custkey % 4 < 2 OR (c_custkey % 4 = 2 AND i = 1)",
    "filename_rules": """WITH p AS (SELECT 'docs/' || p_name || '-' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.PEM' WHEN 1 THEN '/key.pem' WHEN 2 THEN '.pem.txt' ELSE '\uff0epem' END AS path, p_partkey % 4 AS k, p_name FROM part)
      SELECT path, 'forbidden_filename' AS rule, 'filename[0]' AS detector FROM p WHERE k <> 2 UNION ALL SELECT path, 'forbidden_filename', 'filename[1]' FROM p WHERE k = 1 UNION ALL SELECT path, 'forbidden_filename', 'ring' FROM p WHERE p_name LIKE '%ring' AND k <> 1""",
    "media_types": """WITH p AS (SELECT p_partkey, p_partkey % 6 AS e, p_partkey % 7 < 3 AS b FROM part)
      SELECT p_partkey, b AS "binary", CASE e WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/x-ndjson' WHEN 2 THEN 'application/json' ELSE CASE WHEN b THEN 'application/octet-stream' ELSE 'text/plain' END END AS media_type FROM p""",
    "declared_paths": """SELECT p_partkey, ([NULL, 'manifest_path_escape', 'manifest_path_escape', 'manifest_path_escape', 'invalid_manifest_path', 'manifest_path_escape', 'invalid_manifest_path', NULL, 'manifest_path_escape', NULL])[p_partkey % 10 + 1] AS error,
      p_partkey % 10 IN (1, 2, 3, 5) AS unsafe FROM part""",
    "links_by_kind": f"WITH {_SQL_LINKED} SELECT page_id, raw, context, error FROM linked",
    "link_contexts": f"WITH {_SQL_LINKED} SELECT page_id, raw AS target, arg_max(context, CASE context WHEN 'navigation' THEN 2 WHEN 'structured' THEN 1 ELSE 0 END) AS context FROM linked WHERE error IS NULL GROUP BY ALL",
    "repository_references": """SELECT page_id, (['api.github.com', 'github.com', 'raw.githubusercontent.com', 'dev.azure.com', 'github.com', NULL])[page_id % 6 + 1] AS host,
      (['own/repo', 'own/repo', 'own/repo', 'own/proj', 'own/repo', NULL])[page_id % 6 + 1] AS slug FROM pages""",
    "canonical_spellings": f"SELECT page_id, lower(u.s) || '://' || lower(u.h) || CASE WHEN lower(u.s) = 'http' THEN ':443' ELSE '' END || CASE WHEN u.p IN ('', '/') THEN '/' ELSE rtrim(u.p, '/') END || CASE WHEN u.q = '?' THEN '' ELSE u.q END AS canonical FROM (SELECT page_id, {_SQL_URL} AS u FROM pages)",
    "finding_ids_escaped": f"""WITH {_SQL_LINES}, {_SQL_MAIL} SELECT CAST(substr(path, 5) AS BIGINT) AS doc_id, line_number, substr(sha256('{{"column":' || col || ',"detector":"email_address","line":' || line_number || ',"path":"caf\\u00e9\\t\\ud83d\\ude00-' || substr(path, 5) || '","rule":"sensitive_data_shape"}}'), 1, 16) AS evidence_id FROM mails""",
    "record_faults": """WITH p AS (SELECT page_id AS n FROM pages)
      SELECT n AS key, 'page_id' AS field, 'absent' AS fault FROM p WHERE n % 10 IN (0, 1) UNION ALL SELECT -n, 'page_id', 'unexpected' FROM p WHERE n % 10 = 1 UNION ALL SELECT n, 'page_id', 'repeated' FROM p WHERE n % 10 = 4
      UNION ALL SELECT n, 'sha256', 'mismatch' FROM p WHERE n % 10 = 2 UNION ALL SELECT n, 'size', 'mismatch' FROM p WHERE n % 10 = 3""",
    "source_scan": f"WITH {_SQL_LINES}, {_SQL_MAIL}, {_SQL_FOUND} SELECT rule, count(*) AS n FROM found GROUP BY rule",
    "artifact_gates": """WITH p AS (SELECT page_id AS n FROM pages), c AS (SELECT unnest(['inventory', 'eligibility', 'parse', 'policy', 'links']) AS gate, unnest([
        (SELECT count(*) FROM p WHERE n % 13 = 0), (SELECT count(*) FROM p WHERE n % 13 <> 0 AND n % 17 = 0), 0, (SELECT count(*) FROM p WHERE n % 11 = 0),
        (SELECT count(*) FROM p WHERE n + 1 NOT IN (SELECT n FROM p)) + (SELECT count(*) FROM p WHERE n % 7 = 0)]) AS n)
      SELECT gate, n, CASE WHEN n > 0 THEN 'deny' ELSE 'pass' END AS result FROM c""",
    "page_phrases": """SELECT page_id AS page, phrase, fault FROM (SELECT page_id, html, unnest(['href="/the"', 'track(0)', '<ARTICLE>', '<b>']) AS phrase, unnest(['missing', 'forbidden', 'missing', 'forbidden']) AS fault FROM pages)
      WHERE CASE phrase WHEN 'href="/the"' THEN NOT contains(lower(html), phrase) WHEN 'track(0)' THEN contains(html, phrase) WHEN '<ARTICLE>' THEN NOT contains(html, phrase) ELSE contains(lower(html), phrase) END""",
    "revenue_by_nation": "SELECT n_name, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name",
}
ORACLES |= {
    "report_rows": f"WITH {_SQL_LINES}, {_SQL_FOUND} SELECT row_number() OVER (ORDER BY lower(path), path, line_number, coalesce(\"column\", 0), rule, detector) AS row, path, line_number, rule, detector FROM found",
    "class_rules": f"""WITH p AS (SELECT DISTINCT url, url LIKE 'https:%' AS listed, length(url) % 2 = 0 AS control, u.p AS place FROM (SELECT url, {_SQL_URL} AS u FROM pages))
      SELECT 'nondeploy_path_in_artifact_manifest' AS rule, url AS path, 'source_classification' AS detector FROM p WHERE listed AND place LIKE '/en/%'
      UNION ALL SELECT 'publication_control_manifest_mismatch', url, 'source_classification' FROM p WHERE place LIKE '/de/%' AND NOT (listed AND control)""",
    "bag_compare": """WITH l AS (SELECT l_suppkey, l_quantity, l_returnflag, count(*) AS n_left FROM lineitem GROUP BY ALL),
      r AS (SELECT l_suppkey, l_quantity, l_returnflag, count(*) AS n_right FROM (SELECT * FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_quantity = 50) UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'N' AND l_quantity = 1) GROUP BY ALL)
      SELECT l_suppkey, l_quantity, l_returnflag, n_left, coalesce(n_right, 0) AS n_right FROM l LEFT JOIN r USING (l_suppkey, l_quantity, l_returnflag) WHERE n_left <> coalesce(n_right, 0)""",
    "count_faults": """WITH c AS (SELECT c_nationkey AS key, c_mktsegment AS name, count(*) AS n, count(*) FILTER (WHERE c_acctbal > -900) AS told FROM customer GROUP BY ALL)
      SELECT key, name, CASE WHEN told = 0 THEN 'missing' ELSE 'mismatch' END AS fault FROM c WHERE n <> told UNION ALL SELECT key, 'all', 'unexpected' FROM c GROUP BY key HAVING sum(told) > 0""",
    "host_rules": f"""WITH h AS (SELECT page_id, url, lower(u.h) AS host FROM (SELECT page_id, url, {_SQL_URL} AS u FROM pages)),
      r AS (SELECT host AS domain, 'block' AS verdict FROM h WHERE url LIKE 'https:%' UNION ALL SELECT string_split(host, '.')[-1], 'allow' FROM h), m AS (SELECT domain, min(verdict) AS verdict FROM r GROUP BY domain),
      b AS (SELECT page_id, arg_max(domain, length(domain)) AS rule, arg_max(verdict, length(domain)) AS verdict FROM h JOIN m ON host = domain OR suffix(host, '.' || domain) GROUP BY page_id)
      SELECT page_id, host, rule, coalesce(verdict, 'unknown') AS verdict FROM h LEFT JOIN b USING (page_id)""",
    "forbidden_table": f"""WITH p AS (SELECT page_id, url, length(html) % 2 = 0 AS same, lower(u.s) || '://' || lower(u.h) || CASE WHEN u.p = '' THEN '/' ELSE u.p END AS shown,
        lower(u.s) || '://' || lower(u.h) || CASE WHEN u.p IN ('', '/') THEN '/' ELSE rtrim(u.p, '/') END || CASE WHEN u.q = '?' THEN '' ELSE u.q END AS form FROM (SELECT *, {_SQL_URL} AS u FROM pages))
      SELECT DISTINCT a.page_id AS doc_id, b.shown AS target FROM p a JOIN p b ON b.url LIKE 'https:%' AND (a.form = b.form OR (a.same AND contains(a.url, b.url)))""",
    "glob_rules": f"""WITH p AS (SELECT DISTINCT u.p AS path FROM (SELECT {_SQL_URL} AS u FROM pages) WHERE u.p <> '')
      SELECT path, 'any' AS class FROM p UNION ALL SELECT path, 'page' FROM p WHERE regexp_matches(path, '^/[^/]*/[^/]*[.]html$') UNION ALL SELECT path, 'in ' || regexp_extract(path, '^/([^/]+)/', 1) FROM p WHERE regexp_matches(path, '^/[^/]+/')""",
    "folder_faults": """WITH p AS (SELECT url, string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/') AS s FROM pages),
      n AS (SELECT DISTINCT array_to_string(s[:i], '/') AS folder FROM (SELECT s, unnest(range(1, len(s))) AS i FROM p)),
      t AS (SELECT DISTINCT array_to_string(s[:i], '/') AS folder FROM (SELECT s, unnest(range(1, len(s))) AS i FROM (SELECT s || ['index', 'x'] AS s FROM p WHERE url LIKE 'https:%')))
      SELECT folder, 'extra' AS fault FROM t WHERE folder NOT IN (SELECT folder FROM n) UNION ALL SELECT folder, 'missing' FROM n WHERE folder NOT IN (SELECT folder FROM t)""",
}
ORACLES["phrase_table"] = ORACLES["phrase_table_joined"] = f"""WITH {_SQL_LINES}, r AS (SELECT item_id, trim(regexp_replace(lower(substr(text, 1, 30)), '\\s+', ' ', 'g')) AS phrase FROM benchmark)
  SELECT DISTINCT path, line_number, item_id AS rule_id FROM lines JOIN r ON phrase <> '' AND contains(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), phrase)"""
ORACLES["audit_markdown"] = "WITH p AS (" + ORACLES["probe_classify"] + """), c AS (SELECT unnest(['unreachable', 'reachable-current', 'linked', 'cached-indicator', 'fork-indicator', 'probe-error']) AS k)
  SELECT 1 AS part, 'Artifacts audited: **' || count(*) || '**' AS line, 1 AS n FROM p UNION ALL SELECT 3, '| ' || k || ' | ' || count(p.source) || ' |', 1 FROM c LEFT JOIN p ON p.classification = k GROUP BY k
  UNION ALL SELECT 5, '| url | ' || source || ' | ' || classification || ' | ' || coalesce(CAST(status AS VARCHAR), '') || ' | ' || coalesce(sha256, '') || ' | ' || coalesce(detail, '') || ' |', count(*) FROM p GROUP BY ALL"""
ORACLES["probe_counts"] = "WITH c AS (SELECT unnest(['unreachable', 'reachable-current', 'linked', 'cached-indicator', 'fork-indicator', 'probe-error']) AS classification), p AS (" + ORACLES["probe_classify"] + ") SELECT c.classification, count(p.source) AS n FROM c LEFT JOIN p ON p.classification = c.classification GROUP BY 1"
