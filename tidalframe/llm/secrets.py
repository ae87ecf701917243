"""Operator 6: secret scan with multipart credential linking, in DataFrame functions only.

*Base.* Assignments, access ids and long hex runs by fixed patterns, each kind leftmost and
non-overlapping, with code-point positions (from the lengths of what lies between matches).

*Parts.* Three roles make up a credential: identifiers (user names, client ids, access ids),
secrets (base matches; weak: mixed-case tokens with digits, short values of secret names) and
endpoints (URLs, host names with a port, host assignments). Weak candidates mean little
alone.

*Linking.* A scope is a paragraph (text between blank lines). Within a document's scope a
part is joined with the interval of ``reach`` code points on both sides of it; the interval
join is a semi-join, evaluated as range windows over the parts in order, so no pairs are
built. A weak secret is reported when an identifier or endpoint lies in its interval, an
identifier or endpoint when a secret does. Only texts with weak parts take this path,
once for each distinct text; the others are never shuffled.

No pattern repeats a group or gives back what a run took, so texts of any length and number
of matches cost time in proportion (positions: n * sqrt(n) element copies) and no stack.

Defined results: null text is empty and has no spans; equal texts have equal spans, so
repeated rows and rows without an id need no special care; empty tables give empty results.
Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stage, text_of

# The patterns of the base kinds; the value is group 2 of an assignment.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
BASE_KINDS = ("assign", "access", "hex")
#: Parts that are reported only when linked.
PART_PATTERNS = {
    "user": r"""(?i:user_?name|user_?id|user|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""",
    "endpoint": r"""(?i:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{4,}|(?:host|hostname|server|endpoint|url)["']?\x20*[:=]\x20*["']?[a-z0-9.-]+\.[a-z0-9:/._-]+)""",
    # Only the start of a run is tried and nothing is given back, so long runs stay linear.
    "host": r"(?<![A-Za-z0-9.-])[A-Za-z0-9.-]++:[0-9]++[A-Za-z0-9_.:-]*+",
    "weak": r"[A-Za-z0-9+/_-]{20,}={0,2}",
    "short": r"""(?i:password|passwd|secret|token|api_?key|pwd|passphrase|pin)["']?\x20*[:=]\x20*["']?[^\s"',;]{3,}""",
}
#: What a run with a port must look like, and its part that counts.
HOST_PORT = r"^[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z0-9-]:[0-9]{2,5}([^A-Za-z0-9_]|$)"
HOST_HEAD = r"^[A-Za-z0-9.-]+:[0-9]+"
ROLES = {"assign": "secret", "hex": "secret", "weak": "secret", "short": "secret", "access": "identifier", "user": "identifier", "endpoint": "endpoint", "host": "endpoint"}
BLANK_LINE = r"\n[\x20\t\r]*\n"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, **PART_PATTERNS, "break": BLANK_LINE}
REACH = 400
#: Matches whose positions are summed up together.
CHUNK = 256
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def positions(gaps: Column, matches: Column) -> Column:
    """Array of (start, end, found) of the matches, from what lies between them.

    Lengths are summed within chunks, then over the chunks, so the work is not the square
    of the number of matches.
    """
    sized = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("size"), m.alias("found")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int")), lambda c: F.slice(sized, c * CHUNK + 1, CHUNK))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        here = F.array(F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found")))
        return F.struct(end.alias("at"), F.concat(acc["out"], here).alias("out"))

    parts = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.struct(F.lit(0).alias("at"), empty.alias("out")), add))
    shifts = F.aggregate(F.transform(parts, lambda p: p["at"]), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    moved = F.zip_with(F.slice(shifts, 1, F.size(parts)), parts, lambda by, p: F.transform(p["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["found"].alias("found"))))
    return F.when(F.size(matches) > 0, F.flatten(moved)).otherwise(empty)


def find_all(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``docs`` (with a text) and for each kind its (start, end, found) in code points, end
    exclusive; a text is cut by a pattern only where that occurs."""
    rows = docs.withColumns({f"m_{k}": F.regexp_extract_all("text", F.lit(p), 0) for k, p in patterns.items()})
    cut = lambda k, p: F.when(F.size(f"m_{k}") > 0, F.transform(F.split("text", p, -1), lambda x: F.length(x)))
    rows = rows.withColumns({f"g_{k}": cut(k, p) for k, p in patterns.items()})
    return rows.select(*docs.columns, *[positions(F.col(f"g_{k}"), F.col(f"m_{k}")).alias(k) for k in patterns])


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def base_spans() -> Column:
    """Base matches of all kinds: array of (kind, start, end)."""
    assigned = F.filter("assign", lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= LEAST_VALUE)
    return F.concat(_named(assigned, "assign"), _named(F.col("access"), "access"), _named(F.col("hex"), "hex"))


def part_spans() -> Column:
    """Parts that only count when linked; weak tokens mix upper case, lower case and digits."""
    mixed = lambda s: s["found"].rlike("[A-Z]") & s["found"].rlike("[a-z]") & s["found"].rlike("[0-9]")
    port = lambda s: s["found"].rlike(HOST_PORT) & ~F.regexp_extract(s["found"], HOST_HEAD, 0).contains("..")
    head = lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(F.regexp_extract(s["found"], HOST_HEAD, 0))).alias("end"))
    spans = {kind: F.col(kind) for kind in PART_PATTERNS}
    spans["weak"] = F.filter("weak", mixed)
    spans["host"] = F.transform(F.filter("host", port), head)
    return F.concat(*[_named(x, kind) for kind, x in spans.items()])


def linked_parts(marks: DataFrame, reach: int) -> DataFrame:
    """Of (text_key, kind, start, end) with base spans, parts and breaks, the parts outside all
    base spans that have a complement within reach in their scope."""
    base = F.col("kind").isin(*BASE_KINDS)
    up = Window.partitionBy("text_key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("text_key").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    rows = marks.withColumns(
        {"scope": F.count(F.when(F.col("kind") == "break", 1)).over(up), "base_end": F.max(F.when(base, F.col("end"))).over(up), "base_start": F.min(F.when(base, F.col("start"))).over(down)}
    )
    inside = (F.coalesce("base_end", F.lit(-1)) > F.col("start")) | F.coalesce(F.col("base_start") < F.col("end"), F.lit(False))
    role = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r in ROLES.items()])
    rows = rows.where(base | ((F.col("kind") != "break") & ~inside)).withColumn("role", role)
    near = Window.partitionBy("text_key", "scope").orderBy("start").rangeBetween(-reach, reach)
    rows = rows.withColumns({f"near_{r}": F.max(F.col("role") == r).over(near) for r in ("secret", "identifier", "endpoint")})
    complement = F.when(F.col("role") == "secret", F.col("near_identifier") | F.col("near_endpoint")).otherwise(F.col("near_secret"))
    return rows.where(~base & complement)


def _rank(kind: Column) -> Column:
    order = [*BASE_KINDS, *PART_PATTERNS]
    return F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(order)])


def by_start(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of kind, start, end)."""
    rows = find_all(docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text")), PATTERNS)
    rows = rows.select("doc_id", "text", base_spans().alias("base"), part_spans().alias("parts"), F.col("break").alias("breaks"))
    some = F.size("parts") > 0
    breaks, key = F.when(some, _named(F.col("breaks"), "break")), F.when(some, F.sha2(F.col("text").cast("binary"), 256))
    found = stage(rows.select("doc_id", "base", F.when(some, F.col("parts")).alias("parts"), breaks.alias("breaks"), key.alias("text_key")), "secret-parts")

    once = found.where("text_key is not null").groupBy("text_key").agg(F.first(F.concat("base", "parts", "breaks")).alias("marks"))
    marks = once.select("text_key", F.explode("marks").alias("s")).select("text_key", "s.*")
    linked = linked_parts(marks, reach).groupBy("text_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))

    plain = found.where("text_key is null").select("doc_id", "base", F.col("base").alias("spans"))
    joined = found.where("text_key is not null").join(linked, "text_key", "left")
    joined = joined.select("doc_id", "base", F.concat("base", F.coalesce("linked", F.expr(f"cast(array() as {_SPANS})"))).alias("spans"))
    return plain.unionByName(joined).select("doc_id", by_start(F.col("base")).alias("base"), by_start(F.col("spans")).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def _sql_matches(kind: str, pattern: str, keep: str = "true", counted: str = "m") -> str:
    """Matches of a pattern in DuckDB, their bounds from what lies between them."""
    quoted = pattern.replace("'", "''")
    return f"""
    select doc_id, '{kind}' as kind, s, s + length({counted}) as e, m, v from (
      select doc_id, ms[i] as m, vs[i] as v,
             list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as s
      from (select *, unnest(range(1, len(ms) + 1)) as i from (
        select doc_id, string_split_regex(text, '{quoted}') as gaps, regexp_extract_all(text, '{quoted}') as ms,
               regexp_extract_all(text, '{quoted}', {2 if kind == "assign" else 0}) as vs from d)))
    where {keep}"""


#: Where DuckDB needs another spelling (it has no look-behind) or a filter.
_SQL_PARTS = {
    "weak": (PART_PATTERNS["weak"], "regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[0-9]')"),
    "host": (r"[A-Za-z0-9.-]+:[0-9]+[A-Za-z0-9_.:-]*", f"regexp_matches(m, '{HOST_PORT}') and not contains(regexp_extract(m, '{HOST_HEAD}'), '..')", f"regexp_extract(m, '{HOST_HEAD}')"),
}

OP6_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
base as ({_sql_matches("assign", ASSIGN, f"length(v) >= {LEAST_VALUE}")} union all {_sql_matches("access", ACCESS)} union all {_sql_matches("hex", HEX)}),
part as (
  select p.* from ({" union all ".join(_sql_matches(k, *_SQL_PARTS.get(k, (p,))) for k, p in PART_PATTERNS.items())}) p
  where not exists (select 1 from base b where b.doc_id = p.doc_id and b.s < p.e and p.s < b.e)),
br as ({_sql_matches("break", BLANK_LINE)}),
every_part as (
  select u.*, (select count(*) from br where br.doc_id = u.doc_id and br.s < u.s) as scope,
         case when kind in ('assign', 'hex', 'weak', 'short') then 'secret' when kind in ('endpoint', 'host') then 'endpoint' else 'identifier' end as role
  from (select doc_id, kind, s, e, true as is_base from base union all select doc_id, kind, s, e, false from part) u),
linked as (
  select a.doc_id, a.kind, a.s, a.e from every_part a where a.is_base or exists (
    select 1 from every_part b where b.doc_id = a.doc_id and b.scope = a.scope and b.s between a.s - {REACH} and a.s + {REACH}
    and case when a.role = 'secret' then b.role in ('identifier', 'endpoint') else b.role = 'secret' end)),
ranked as (select *, list_position([{", ".join(f"'{k}'" for k in (*BASE_KINDS, *PART_PATTERNS))}], kind) as k from linked)
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
       sha256(coalesce(string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, k) filter (k <= 3), '')) as base_sha256,
       coalesce(string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, k), '') as spans
from d left join ranked using (doc_id) group by d.doc_id
"""
