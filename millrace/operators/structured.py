"""JSON texts as rows of leaves with keys, ancestors and siblings, and the detectors that these trigger."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import exploded
from ..functions.text import structured_key
from .shapes import EMAIL, SHAPES, Allowance, value_allowed

# The limits of a document, and which shapes are secrets.
MAX_DEPTH, MAX_ITEMS = 32, 10_000
SECRET_SHAPES = tuple(SHAPES)[:12]
# The normalised keys that mark a scalar as of a kind.
KEY_ALIASES: dict[str, tuple[str, ...]] = {
    "access_tokens": ("access_token", "auth_token", "bearer_token", "oauth_token", "refresh_token"),
    "api_tokens": ("api_key", "api_secret", "api_token", "client_api_key"),
    "connection_strings": ("connection_string", "database_url", "db_connection", "db_url", "jdbc_url"),
    "contracts_not_intentionally_published_as_customer_facing_terms": ("contract", "contract_body", "executed_agreement", "private_contract"),
    "customer_notes": ("customer_note", "customer_notes", "submitted_note", "waitlist_note"),
    "customer_or_account_identifiers": ("account_id", "contact_id", "customer_id", "external_customer_id", "subscriber_id", "user_account_id"),
    "email_address_values": ("email", "email_address", "mail"),
    "government_identifiers": ("driver_license", "government_id", "national_id", "passport", "passport_number", "social_security_number", "ssn", "tax_id"),
    "legal_matter_records": ("case_number", "legal_matter", "legal_matter_id", "matter_number"),
    "passwords": ("passphrase", "passwd", "password", "pwd"),
    "phone_number_values": ("cell", "cell_phone", "mobile", "mobile_phone", "phone", "phone_number", "phones", "telephone"),
    "postal_address_values": ("address", "address_line", "address_line_1", "address_line_2", "mailing_address", "postal_address", "street", "street_address"),
    "private_keys": ("private_key", "private_key_pem", "signing_private_key", "ssh_private_key"),
    "privileged_communications": ("attorney_client", "privileged_communication", "privileged_message"),
    "signatures": ("digital_signature", "signature", "signature_value", "signed_by"),
    "submitted_names": ("contact_name", "customer_name", "first_name", "full_name", "last_name", "submitted_name"),
    "webhook_secrets": ("signing_secret", "webhook_key", "webhook_secret", "webhook_token"),
}
# Keys that make their surroundings a customer's record, of submissions, and forms of values.
CUSTOMER_KEYS = ("applicant", "contact", "customer", "intake", "lead", "person", "signup", "submission", "subscriber", "waitlist", "waitlist_submission")
SUBMISSION_KEYS = ("created_at", "submitted_at", "submission_id", "timestamp")
CONTACT_KEYS = ("account_id", "customer_id", "email", "email_address", "phone", "phone_number")
PHONE_VALUE = "^(?:\\+?1[\\s.-]?)?(?:\\(\\d{3}\\)|\\d{3})[\\s.-]?\\d{3}[\\s.-]?\\d{4}$"
CONNECTION_VALUE = "(?i)(?:AccountKey|SharedAccessKey|ClientSecret|Password)\\s*="
WEBHOOK_VALUE = "(?i)https://hooks\\.slack\\.com/services/"
#: Detectors for which a matching key is enough even without a value, and all there are.
SECRET_DETECTORS = ("access_tokens", "api_tokens", "connection_strings", "passwords", "private_keys", "real_secret_values_from_ci_secret_corpus", "webhook_secrets")
DETECTORS = (*KEY_ALIASES, "real_secret_values_from_ci_secret_corpus", "waitlist_submission_records")

LEAVES = "key {}, path string, name string, ancestors array<string>, siblings array<string>, kind string, value string"


def strict(text: str):
    """A JSON text; repeated keys and constants that JSON does not have are errors."""

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def never(name: str) -> None:
        raise ValueError(name)

    return json.loads(text, object_pairs_hook=once, parse_constant=never)


def _rendered(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def walk(root, max_depth: int, max_items: int, visited: list[int] | None = None, empties: bool = False) -> Iterator[tuple]:
    """``(path, name, ancestors, siblings, kind, value)`` of every scalar, and of where a limit stops the walk.

    List items keep the name and the siblings above them.  Items are those of all containers so far, counted on in
    ``visited``, which the values of one document share.  ``empties``: containers with nothing in them are rows too.
    """
    visited = [0] if visited is None else visited
    waiting = [(root, "$", None, (), (), 0)]
    while waiting:
        node, path, name, above, siblings, depth = waiting.pop()
        if depth > max_depth:
            yield path, name, above, siblings, "maximum_nesting_depth", None
        elif isinstance(node, (dict, list)):
            visited[0] += len(node)
            if empties and not node:
                yield path, name, above, siblings, "empty", None
            if visited[0] > max_items:
                yield path, name, above, siblings, "maximum_collection_items", None
            elif isinstance(node, dict):
                own, keys = above if name is None else (*above, name), tuple(node)
                waiting += [(v, f"{path}.{k}", k, own, keys, depth + 1) for k, v in reversed(node.items())]
            else:
                waiting += [(v, f"{path}[{i}]", name, above, siblings, depth + 1) for i, v in reversed([*enumerate(node)])]
        else:
            yield path, name, above, siblings, "boolean" if isinstance(node, bool) else "null" if node is None else "string" if isinstance(node, str) else "number", _rendered(node)


def json_leaves(rows: DataFrame, key: str, text: str, max_depth: int = MAX_DEPTH, max_items: int = MAX_ITEMS, lines: bool | Column = False, empties: bool = False) -> DataFrame:
    """``(key, path, name, ancestors, siblings, kind, value)`` of every scalar of strict JSON texts.

    A text that is not strict JSON (repeated keys, NaN, null) gives one row of kind ``invalid``; a container
    beyond ``max_depth``, or with which a text has more than ``max_items`` items, gives one of that limit's name instead
    of its leaves.  ``lines`` says which texts have a value per line that is not blank; these share one count of items.
    ``empties``: containers with nothing in them are rows of kind ``empty``.
    """
    given = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.lit(lines) if isinstance(lines, bool) else lines).alias("lines"))
    fields = [f.split(" ", 1)[0] for f in LEAVES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out = [], []
            for i, (own, by_line) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                leaves = _leaves_of(own, by_line, max_depth, max_items, empties)
                owner += [i] * len(leaves)
                out += leaves
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(map(list, c) if k in (2, 3) else c, t) for k, (c, t) in enumerate(zip(columns, kinds, strict=True)))], names=fields)

    return given.mapInArrow(run, LEAVES.format(given.schema["key"].dataType.simpleString()))


def _keyed(leaves: DataFrame) -> DataFrame:
    """Names, ancestors and siblings as normalised keys; leaves of one shape of keys are normalised once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for c in ("name", "ancestors", "siblings"):
                values = batch.column(c).to_pylist()
                made.append([None if v is None else structured_key(v) for v in values] if c == "name" else [[structured_key(x) for x in v or []] for v in values])
            yield pa.record_batch([*batch.columns, pa.array(made[0], pa.string()), *(pa.array(m, pa.list_(pa.string())) for m in made[1:])], names=[*batch.schema.names, "_key", "_above", "_around"])

    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)
    return leaves.mapInArrow(run, f"{inner}, _key string, _above array<string>, _around array<string>")


_LEAF = pa.struct([*((c, pa.string()) for c in ("path", "name", "kind", "value", "_key")), ("_above", pa.list_(pa.string())), ("_around", pa.list_(pa.string()))])
LEAF_TYPE = "array<struct<path:string,name:string,kind:string,value:string,_key:string,_above:array<string>,_around:array<string>>>"


def leaves_in(text: Column, by_line: Column, max_depth: int = MAX_DEPTH, max_items: int = MAX_ITEMS) -> Column:
    """The leaves of ``json_leaves`` with their normalised keys as one array; null for a null text. At most ``max_items`` and the containers'."""

    @F.arrow_udf(LEAF_TYPE)
    def run(texts: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for own, each in zip(texts.to_pylist(), lines.to_pylist(), strict=True):
            out.append(None if own is None else [
                {"path": path, "name": name, "kind": kind, "value": value, "_key": None if name is None else structured_key(name), "_above": [*map(structured_key, above)], "_around": [*map(structured_key, around)]}
                for path, name, above, around, kind, value in _leaves_of(own, each, max_depth, max_items)
            ])
        return pa.array(out, pa.list_(_LEAF))

    return run(text, by_line)


def _leaves_of(own: str | None, by_line: bool, max_depth: int, max_items: int, empties: bool = False) -> list[tuple]:
    try:
        if own is None:
            raise ValueError("null")
        parts = [x for x in own.removeprefix("\ufeff").splitlines() if x.strip()] if by_line else [own.removeprefix("\ufeff")]
        roots, visited = [strict(x) for x in parts], [0]
        return [leaf for root in roots for leaf in walk(root, max_depth, max_items, visited, empties)]
    except (ValueError, RecursionError):
        return [(None, None, (), (), "invalid", None)]


def _any_of(keys: Column, values: tuple[str, ...]) -> Column:
    return F.arrays_overlap(keys, F.array(*map(F.lit, values)))


def detector_hits(terms_path: Column) -> dict[str, Column]:
    """When each detector matches a leaf with ``_key``, ``_above``, ``_around``, ``kind`` and ``value``.

    ``terms_path``: where terms for customers may stand.
    """
    text = F.when(F.col("kind") == "string", F.trim("value")).when(F.col("kind") == "number", F.col("value"))
    some = F.coalesce(text != "", F.lit(False))
    keys = F.array_append("_above", F.coalesce("_key", F.lit("")))
    by_key = {d: _any_of(keys, aliases) for d, aliases in KEY_ALIASES.items()}
    like = lambda pattern: some & F.coalesce(text.rlike(pattern), F.lit(False))
    customer = _any_of(F.col("_above"), CUSTOMER_KEYS) | _any_of(F.col("_around"), (*CUSTOMER_KEYS, *CONTACT_KEYS))
    waiting = F.array_contains("_above", "waitlist_submission") | F.array_contains("_around", "waitlist_submission") | (_any_of(F.col("_around"), SUBMISSION_KEYS) & _any_of(F.col("_around"), CONTACT_KEYS))
    own = lambda *names: F.coalesce(F.col("_key").isin(*names), F.lit(False))
    hits = {d: some & k for d, k in by_key.items()}
    return hits | {
        "access_tokens": by_key["access_tokens"],
        "api_tokens": by_key["api_tokens"],
        "passwords": by_key["passwords"],
        "private_keys": by_key["private_keys"] | like(SHAPES["private_key"]),
        "connection_strings": by_key["connection_strings"] | like(CONNECTION_VALUE),
        "webhook_secrets": by_key["webhook_secrets"] | like(WEBHOOK_VALUE),
        "real_secret_values_from_ci_secret_corpus": reduce(or_, (like(f"(?U){SHAPES[s]}") for s in SECRET_SHAPES)),
        "email_address_values": some & (by_key["email_address_values"] | like(f"(?i)^{EMAIL}$")),
        "phone_number_values": some & (by_key["phone_number_values"] | like(PHONE_VALUE)),
        "customer_notes": some & (by_key["customer_notes"] | (own("note", "notes") & customer)),
        "submitted_names": some & (by_key["submitted_names"] | (own("name") & customer)),
        "waitlist_submission_records": some & waiting,
        "contracts_not_intentionally_published_as_customer_facing_terms": some & by_key["contracts_not_intentionally_published_as_customer_facing_terms"] & ~terms_path,
    }


def key_findings(leaves: DataFrame, detectors: tuple[str, ...] = DETECTORS, allowances: tuple[Allowance, ...] = (), placeholders: tuple[str, ...] = DETECTORS) -> DataFrame:
    """``(key, path, rule, detector)``: what the leaves of ``json_leaves`` trigger, and what could not be walked.

    ``key`` is the document's path.  Values that may stand (null, empty, or by ``allowances``) are passed over by the detectors
    in ``placeholders`` and by those of secrets.
    """
    keyed = with_key_hits(_keyed(leaves), F.col("key").cast("string"), detectors, allowances, placeholders)
    found = exploded(keyed, "key", "path", f="_values").select("key", "path", "f.rule", "f.detector")
    return found.repartition("key").distinct()  # findings rarely repeat: made distinct before they are dealt, a task would hold all of its own


def with_key_hits(keyed: DataFrame, document: Column, detectors: tuple[str, ...] = DETECTORS, allowances: tuple[Allowance, ...] = (), placeholders: tuple[str, ...] = DETECTORS) -> DataFrame:
    """Leaves with normalised keys, of the document of path ``document``, with ``_values``: an array of ``(rule, detector)``; none for a null kind."""
    terms = F.lower(document).startswith("terms/") | F.lower(document).startswith("privacy/")
    hits = []
    for name, hit in sorted(detector_hits(terms).items()):
        if name in detectors:
            passed = value_allowed(document, name, F.when(F.col("kind").isin("string", "number", "null"), F.col("value")).otherwise(F.lit("false")), allowances) if name in (*placeholders, *SECRET_DETECTORS) else F.lit(False)
            hits.append(F.when(hit & ~passed, F.struct(F.lit("structured_data_violation").alias("rule"), F.lit(name).alias("detector"))))
    limit = F.when(F.col("kind").startswith("maximum_"), F.struct(F.lit("structured_data_limit").alias("rule"), F.col("kind").alias("detector")))
    invalid = F.when(F.col("kind") == "invalid", F.struct(F.lit("invalid_structured_data").alias("rule"), F.lit("strict_json_parser").alias("detector")))
    scalar = F.col("kind").isin("string", "number", "boolean", "null")
    found = F.array_compact(F.array(limit, invalid, *(F.when(scalar, h) for h in hits)))
    return keyed.withColumn("_values", F.coalesce(F.when(F.col("kind").isNotNull(), found), F.array().cast("array<struct<rule:string,detector:string>>")))


# Keys that evidence may not have, because they hold private values or belong to another kind of record.
PRIVATE_VALUES = ("body", "candidate_source", "content", "detected_text", "fixture_body", "matched_customer_value", "matched_legal_value", "matched_secret_value", "password", "private_content_excerpt", "private_link", "private_repository_slug", "private_repository_url", "secret", "secret_value", "source_bytes", "source_content", "token")
RECORD_KEYS = ("frame_hash", "payload", "payload_hash", "prev_wave", "sig", "stream_id")


def unsafe_evidence(leaves: DataFrame, spec: str | None = None) -> DataFrame:
    """``(key, path, fault)``: leaves of evidence documents below a key that these may not have.

    ``leaves`` have empty containers too (``empties``), so that no key goes unseen; ``spec`` is the value of a key of that name
    that marks records of another kind.
    """
    marked = F.coalesce((F.lower("name") == "spec") & (F.col("kind") == "string") & (F.lower("value") == (spec or "").casefold()), F.lit(False)) & F.lit(bool(spec))
    names = F.transform(F.concat(F.array("name"), "ancestors", "siblings"), lambda n: F.replace(F.lower(n), F.lit("-"), F.lit("_")))
    fault = F.when(marked | _any_of(F.col("_names"), RECORD_KEYS), "frame_material").when(_any_of(F.col("_names"), PRIVATE_VALUES), "private_material_field")
    return leaves.withColumn("_names", F.array_compact(names)).select("key", "path", fault.alias("fault")).where("fault IS NOT NULL")
