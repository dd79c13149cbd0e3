"""Secret scans with multipart credential linking, in DataFrame operations only.

Patterns find parts: identifiers, secrets and endpoints.  Strong parts are reported alone.  Weak ones (a
short secret, a key or token in a form that is no secret for sure, a login name, an address) are reported only when an interval join finds a complementary
part in their scope: at most ``SCOPE`` code points away in the same document.  The join is an equi-join on
(document, bin of SCOPE code points), so a text full of parts is spread over its bins.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, read_table, text_or_empty

SCOPE = 160
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LOGIN = r"""(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"""(?:(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3|ftp|ssh)://[A-Za-z0-9._~:/?#@%&=+-]{3,}|(?:[Hh][Oo][Ss][Tt]|[Ee][Nn][Dd][Pp][Oo][Ii][Nn][Tt])["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,})"""
#: Kinds in report order, with pattern, role and the roles that complete a weak part (None: a strong one).
#: ``weak`` is an assignment whose value is too short for ``assign``.
KINDS = {
    "assign": (ASSIGN, "secret", None), "access": (ACCESS, "identifier", None), "hex": (HEX, "digest", None),
    "weak": (ASSIGN, "secret", ("identifier", "endpoint")), "login": (LOGIN, "identifier", ("secret", "digest")),
    "endpoint": (ENDPOINT, "endpoint", ("secret", "identifier")),
}
#: Weak secrets beyond those of the SQL: assignments to names that ``assign`` does not know, and bare mixed-case tokens outside all other parts.
NAMED = (
    r"""(?i:(?:secret|private|access)[_\x20-]?(?:access[_\x20-]?)?key|pwd|passphrase)"""
    r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}"""
)
BARE = r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"
ADDED = {"named": (NAMED, "secret", ("identifier", "endpoint")), "bare": (BARE, "secret", ("identifier", "endpoint"))}
ALL_KINDS = KINDS | ADDED
#: Texts that hold a part of a kind hold one of these, in either case: a cheap sieve before the patterns.
SIEVES = {
    "assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("akia",), "login": ("user", "login", "client_id", "account"), "endpoint": ("://", "host", "endpoint"),
}
LONG_VALUE, SHORT_VALUE = 12, 4
BASE = ("assign", "access", "hex")


def scanned(docs: DataFrame) -> DataFrame:
    """Adds ``hits``: for each pattern that occurs, the lengths of the pieces between its matches, of the matches and of the values.

    The patterns of ADDED are sought only in texts with an identifier or endpoint, as nothing else completes them.
    """

    def hit(name: str, pattern: str) -> Column:
        every = lambda group: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), F.length)
        pieces = F.transform(F.split("text", pattern, -1), F.length)
        zipped = F.arrays_zip(pieces.alias("gap"), every(0).alias("size"), every(2 if name == "assign" else 0).alias("value"))
        found = F.col("text").rlike(pattern)
        if name in SIEVES:
            found = reduce(or_, [F.contains("lower", F.lit(x)) for x in SIEVES[name]]) & found
        return F.when(found, F.struct(F.lit(name).alias("pattern"), zipped.alias("hits")))

    docs = docs.withColumn("lower", F.lower("text"))
    found = [hit(name, pattern) for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("login", LOGIN), ("endpoint", ENDPOINT))]
    docs = docs.withColumn("hits", F.array_compact(F.array(*found)))
    more = F.array_compact(F.array(*[hit(k, ADDED[k][0]) for k in ADDED]))
    completing = F.exists("hits", lambda h: h["pattern"].isin("access", "login", "endpoint"))
    return docs.withColumn("hits", F.when(completing, F.concat("hits", more)).otherwise(F.col("hits")))


def parts(scans: DataFrame) -> DataFrame:
    """Rows (row, kind, start, end) of all parts, strong and weak; start and end in code points, end exclusive."""
    hits = scans.select("row", F.explode("hits").alias("f")).select("row", "f.pattern", F.posexplode("f.hits").alias("nth", "hit"))
    before = Window.partitionBy("row", "pattern").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("hit.gap") + F.coalesce(F.col("hit.size"), F.lit(0))).over(before)
    kind = F.when(F.col("pattern") != "assign", F.col("pattern")).when(F.col("hit.value") >= LONG_VALUE, F.lit("assign"))
    kind = kind.when(F.col("hit.value") >= SHORT_VALUE, F.lit("weak"))
    placed = hits.select("row", kind.alias("kind"), (end - F.col("hit.size")).alias("start"), end.alias("end"))
    return placed.where("kind is not null and start is not null")  # the piece after the last hit has no size


def bins(a: Column, b: Column) -> Column:
    return F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE)))


def outside_others(found: DataFrame) -> DataFrame:
    """The parts without the bare tokens that overlap a part of another kind, such as the path of an address."""
    spread = lambda rows, a, b: rows.select("row", "kind", F.col("start").alias(a), F.col("end").alias(b), bins(F.col("start"), F.col("end")).alias("bin"))
    bare, other = spread(found.where("kind = 'bare'"), "start", "end"), spread(found.where("kind <> 'bare'"), "s", "e")
    overlap = (F.col("a.row") == F.col("b.row")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("s") < F.col("a.end")) & (F.col("e") > F.col("a.start"))
    inside = bare.alias("a").join(other.alias("b"), overlap, "left_semi").select("row", "kind", "start", "end").distinct()
    return found.join(inside, ["row", "kind", "start", "end"], "left_anti")


def completed(found: DataFrame) -> DataFrame:
    """The weak parts that have a complementary part within SCOPE: an interval join by bins."""
    role = lambda kinds: F.create_map(*[F.lit(x) for k in kinds for x in (k, ALL_KINDS[k][1])])[F.col("kind")]
    weak_kinds = [k for k in ALL_KINDS if ALL_KINDS[k][2]]
    needs = F.create_map(*[x for k in weak_kinds for x in (F.lit(k), F.array(*[F.lit(r) for r in ALL_KINDS[k][2]]))])
    weak = found.where(F.col("kind").isin(weak_kinds)).select("row", "kind", "start", "end", bins(F.col("start") - SCOPE, F.col("end") + SCOPE).alias("bin"))
    other = found.select("row", role(ALL_KINDS).alias("role"), F.col("start").alias("s"), F.col("end").alias("e"), bins(F.col("start"), F.col("end")).alias("bin"))
    near = (F.col("a.row") == F.col("b.row")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("s") <= F.col("a.end") + SCOPE) & (F.col("e") >= F.col("a.start") - SCOPE)
    fits = F.array_contains(needs[F.col("kind")], F.col("role"))
    return weak.alias("a").join(other.alias("b"), near & fits, "left_semi").select("row", "kind", "start", "end").distinct()


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, nth, kind, end) sorted by start, then kind.

    A null text counts as empty and has no spans; rows that repeat an id are scanned on their own.  Texts of
    any length are scanned whole; of parts that start together the kinds' order decides.  An empty table gives
    an empty result; other columns play no part, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty(docs[text_col]).alias("text"))
    scans = scratch.write(scanned(rows).drop("text", "lower"))
    found = outside_others(parts(scans))
    weak_kinds = [k for k in ALL_KINDS if ALL_KINDS[k][2]]
    spans = found.where(~F.col("kind").isin(weak_kinds)).unionByName(completed(found))
    nth = F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), F.col("kind"))
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", nth.alias("nth"), "kind", "end"))).alias("spans"))
    return scans.select("doc_id", "row").join(spans, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    hits = " UNION ALL ".join(
        f"""SELECT doc_id, '{name}' AS pattern, unnest(string_split_regex(text, {quote(p)})) AS gap,
        unnest(list_append(regexp_extract_all(text, {quote(p)}, 0), NULL)) AS hit,
        unnest(list_append(regexp_extract_all(text, {quote(p)}, {2 if name == 'assign' else 0}), NULL)) AS value,
        unnest(range(len(string_split_regex(text, {quote(p)})))) AS nth FROM d WHERE regexp_matches(text, {quote(p)})"""
        for name, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("login", LOGIN), ("endpoint", ENDPOINT))
    )
    role = "CASE {0}.kind " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in KINDS.items()) + " END"
    fits = " OR ".join(f"(a.kind = '{k}' AND {role.format('b')} IN ({', '.join(map(repr, v[2]))}))" for k, v in KINDS.items() if v[2])
    weak = ", ".join(repr(k) for k, v in KINDS.items() if v[2])
    order = "list_position([" + ", ".join(map(repr, KINDS)) + "], kind)"
    text = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS ({hits}),
c AS (SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, pattern ORDER BY nth) AS e FROM h),
p AS (SELECT doc_id, CASE WHEN pattern <> 'assign' THEN pattern WHEN length(value) >= {LONG_VALUE} THEN 'assign' WHEN length(value) >= {SHORT_VALUE} THEN 'weak' END AS kind,
  (e - length(hit))::BIGINT AS s, e::BIGINT AS e FROM c WHERE hit IS NOT NULL),
q AS (SELECT * FROM p WHERE kind IS NOT NULL),
k AS (SELECT * FROM q a WHERE kind NOT IN ({weak}) OR EXISTS (SELECT 1 FROM q b WHERE a.doc_id = b.doc_id AND b.s <= a.e + {SCOPE} AND b.e >= a.s - {SCOPE} AND ({fits}))),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg({text}, ',' ORDER BY s, {order}) FILTER (kind IN ('assign', 'access', 'hex')) AS base, string_agg({text}, ',' ORDER BY s, {order}) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
