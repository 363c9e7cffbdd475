"""Secret scans by multipart credential linking: identifiers, secrets and endpoints support each other inside a scope.

Strong parts are reported as they are. Weak parts (a login or mail address, a value that merely looks like a key, an
endpoint) are interval-joined with the other parts of the same text and scope, and reported only where what completes them
stands within reach. DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skycadence.llm.shared import documents, join_hot, text_or_empty, written

REACH = 400  # code points between the starts of two parts of one credential
BLOCK = 64   # of entries whose lengths are summed at once
SCOPE = "\n\n"  # a blank line ends a scope


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


# Patterns; the value is what follows the first sign of assignment.
SIGN = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = "(?:" + _either_case("password|passwd|secret|token|api_?key") + ")" + SIGN + "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ENDPOINT = (_either_case("(?:https?|ftp|ssh|jdbc:[a-z]{2,20}|mongodb|redis|amqp|s3|postgres|postgresql|mysql)") + r"""://[^\x00-\x20"'<>]+"""
            + "|(?:" + _either_case("host|hostname|server|endpoint") + ")" + SIGN + "[A-Za-z0-9.:_-]{3,}")
LOGIN = ("(?:" + _either_case("user|username|user_?id|login|account|client_?id|access_?key|key_?id") + ")" + SIGN + "[A-Za-z0-9@._+-]{3,}"
         + "|[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:[.][A-Za-z0-9-]{1,63}){1,8}")
KEY = ("(?:" + _either_case("password|passwd|passphrase|pass|pwd|secret|token|auth|credential|private_?key|api_?key") + ")" + SIGN + "[A-Za-z0-9+/_.=-]{4,}"
       + "|[A-Za-z0-9+/_-]{20,}")
WEAK = f"{ENDPOINT}|{LOGIN}|{KEY}"
IS_ENDPOINT, IS_LOGIN, IS_ASSIGNED = f"^(?:{ENDPOINT})$", f"^(?:{LOGIN})$", "^[^:=]*" + SIGN
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "endpoint", "login", "key"]
ROLES = {"identifier": ["access", "login"], "secret": ["assign", "hex", "key"], "endpoint": ["endpoint"]}


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _gaps(text: Column, pattern: str, matches: Column) -> Column:
    """Lengths of what stands before each match; nothing is split where nothing matched."""
    return F.when(F.size(matches) > 0, F.transform(F.split(text, pattern, -1), F.char_length)).otherwise(F.array().cast("array<int>"))


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def _block_starts(steps: Column) -> Column:
    """Sum of the steps before each block of BLOCK entries."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(steps) - 1), F.lit(BLOCK)), lambda at: _sum(F.slice(steps, at + 1, BLOCK)))
    return F.when(F.size(steps) > 0, blocks).otherwise(F.array().cast("array<int>"))


def _running(values: Column) -> Column:
    return F.transform(values, lambda _, k: _sum(F.slice(values, F.lit(1), k)))


def with_spans(docs: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """Adds one array of (start, end, found) per pattern: its matches, leftmost first, in code points, end exclusive.

    A match starts at the sum of the lengths before it. Those sums are taken by blocks of 64 entries and then inside the
    block, so a text with a million matches needs some hundred steps for each and not a million."""
    names = list(patterns)
    out = docs.withColumn("__text", text)
    out = out.select("*", *[_matches(F.col("__text"), p).alias(f"__m_{k}") for k, p in patterns.items()])
    out = out.select("*", *[_gaps(F.col("__text"), p, F.col(f"__m_{k}")).alias(f"__g_{k}") for k, p in patterns.items()])
    out = out.select("*", *[F.zip_with(f"__m_{k}", F.slice(f"__g_{k}", F.lit(1), F.size(f"__m_{k}")), lambda m, g: F.char_length(m) + g).alias(f"__s_{k}") for k in names])
    out = out.select("*", *[_block_starts(F.col(f"__s_{k}")).alias(f"__b_{k}") for k in names])
    out = out.select("*", *[_running(F.col(f"__b_{k}")).alias(f"__r_{k}") for k in names])

    def spans(k):
        step, gap, before = F.col(f"__s_{k}"), F.col(f"__g_{k}"), F.col(f"__r_{k}")

        def span(m, i):
            block = F.floor(i / BLOCK).cast("int")
            start = before[block] + _sum(F.slice(step, block * BLOCK + 1, i % BLOCK)) + gap[i]
            return F.struct(start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("found"))
        return F.transform(F.col(f"__m_{k}"), span)
    return out.select(*docs.columns, *[spans(k).alias(k) for k in names])


def _kept(column: str, keep, kind: str) -> Column:
    """Spans that pass, as (start, kind's place in the list, end)."""
    return F.transform(F.filter(F.col(column), lambda s: keep(s["found"])),
                       lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _value_length(found: Column) -> Column:
    return F.char_length(F.regexp_replace(found, IS_ASSIGNED, ""))


def _mixed(found: Column) -> Column:
    """A bare run counts as a key only with small and capital letters and digits."""
    return found.rlike("[a-z]") & found.rlike("[A-Z]") & found.rlike("[0-9]")


def _key_like(found: Column) -> Column:
    return ~found.rlike(IS_ENDPOINT) & ~found.rlike(IS_LOGIN) & (found.rlike(IS_ASSIGNED) | _mixed(found))


def parts_of(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash, its strong spans, weak candidates and ends of scopes; a NULL text is empty."""
    found = with_spans(docs.select("doc_id", "text"), text_or_empty(), {"assign": ASSIGN, "access": ACCESS, "hex": "[0-9a-f]{32,}", "weak": WEAK})
    base = F.sort_array(F.concat(_kept("assign", lambda f: _value_length(f) >= 8, "assign"),
                                 _kept("access", lambda f: F.char_length(f) >= 16, "access"), _kept("hex", lambda f: F.char_length(f) >= 32, "hex")))
    weak = F.concat(_kept("weak", lambda f: f.rlike(IS_ENDPOINT), "endpoint"), _kept("weak", lambda f: ~f.rlike(IS_ENDPOINT) & f.rlike(IS_LOGIN), "login"),
                    _kept("weak", _key_like, "key"))
    found = found.select("doc_id", "text", base.alias("base"), weak.alias("weak"))
    hopeful = (F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1)
    found = found.withColumn("weak", F.when(hopeful, F.col("weak")).otherwise(F.slice("weak", 1, 0)))
    found = with_spans(found, F.when(hopeful, text_or_empty()).otherwise(F.lit("")), {"ends": SCOPE})
    return found.select("doc_id", F.unhex(F.md5(text_or_empty())).alias("h"), "base", "weak", F.transform("ends", lambda s: s["end"]).alias("ends"))


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(h, added): the weak spans of each text whose complement stands in the same scope within reach.

    A login needs a secret, a key an identifier or an endpoint, an endpoint both an identifier and a secret; two weak
    parts may complete each other. A weak span that overlaps a strong one says nothing. Equal texts are settled once.
    Parts are dealt to cells as wide as the reach; a cell is one row of first and last places per role, so no pairs are formed.
    """
    some = parts.where(F.size("weak") > 0)
    scope_ends = F.transform("ends", lambda e: F.struct(e.alias("start"), F.lit(-1).alias("kind"), e.alias("end")))
    rows = some.select("h", F.explode(F.concat("base", "weak", scope_ends)).alias("p")).select("h", "p.*").distinct()
    order = Window.partitionBy("h").orderBy("start", "kind")  # the parts of one text
    strong = F.col("kind").between(0, len(BASE) - 1)
    rows = rows.select("*", F.count_if(F.col("kind") == -1).over(order).alias("scope"),
                       F.max(F.when(strong, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("covered"),
                       F.min(F.when(strong, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("next"))
    free = (F.coalesce("covered", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    rows = rows.where((F.col("kind") >= 0) & (strong | free)).withColumn("cell", F.floor(F.col("start") / reach))
    role = {r: F.col("kind").isin([KINDS.index(k) for k in kinds]) for r, kinds in ROLES.items()}
    cells = rows.groupBy("h", "scope", "cell").agg(*[f(F.when(is_role, F.col("start"))).alias(f"{name}_{r}")
                                                     for r, is_role in role.items() for name, f in (("first", F.min), ("last", F.max))])
    weak = rows.where(~strong).select("h", "scope", "start", "kind", "end", F.explode(F.array(*[F.col("cell") + k for k in (-1, 0, 1)])).alias("cell"))
    met = join_hot(weak, cells, ["h", "scope", "cell"])
    near = {r: F.coalesce((F.col(f"last_{r}") >= F.col("start") - reach) & (F.col(f"first_{r}") <= F.col("start") + reach), F.lit(False)) for r in ROLES}
    weak = met.groupBy("h", "start", "kind", "end").agg(*[F.bool_or(near[r]).alias(r) for r in ROLES])
    complete = (F.when(F.col("kind") == KINDS.index("login"), F.col("secret")).when(F.col("kind") == KINDS.index("key"), F.col("identifier") | F.col("endpoint"))
                .otherwise(F.col("identifier") & F.col("secret")))
    return weak.where(complete).groupBy("h").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def credentials(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row: doc_id, base and added spans as arrays of (start, kind, end), kinds by their place in KINDS.

    Starts count code points from 0, ends are exclusive. NULL and empty texts have no spans; repeated rows each get the
    spans of their text, a NULL doc_id stays, an empty table gives no rows; columns other than doc_id and text are not
    read. A text of any length is read whole. What is written and shuffled are spans, never texts."""
    parts = written(parts_of(docs), "credential-parts")
    rows = join_hot(parts.select("doc_id", "h", "base"), linked(parts, reach), ["h"], "left")
    return rows.select("doc_id", "base", F.coalesce("added", F.slice("base", 1, 0)).alias("added"))


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def op11_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials(documents(spark, sf_dir))
    counts = [_number(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.sort_array(F.concat("base", "added"))).alias("spans"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak": WEAK, "ends": SCOPE}
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(f"SELECT k, '{name}' AS what, regexp_extract_all(t, {_quoted(p)}) AS ms, regexp_split_to_array(t, {_quoted(p)}) AS gs FROM d"
                          for name, p in _PATTERNS.items())}),
n AS (SELECT k, what, ms, gs, unnest(list_filter(range(1, len(ms) + 1), lambda i: what <> 'hex' OR length(ms[i]) >= 32)) AS i FROM m),
s AS (SELECT k, what, ms[i] AS found, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS b FROM n),
e AS (SELECT k, what, found, b::BIGINT AS b, (b + length(found))::BIGINT AS e FROM s),
v AS (SELECT k, b, e, CASE WHEN what IN ('assign', 'access', 'hex') THEN what WHEN regexp_full_match(found, {_quoted(ENDPOINT)}) THEN 'endpoint'
             WHEN regexp_full_match(found, {_quoted(LOGIN)}) THEN 'login' WHEN regexp_matches(found, {_quoted(IS_ASSIGNED)}) THEN 'key'
             WHEN regexp_matches(found, '[a-z]') AND regexp_matches(found, '[A-Z]') AND regexp_matches(found, '[0-9]') THEN 'key' END AS kind,
             (SELECT count(*) FROM e x WHERE x.k = e.k AND x.what = 'ends' AND x.e <= e.b) AS scope
      FROM e WHERE CASE what WHEN 'assign' THEN length(regexp_replace(found, {_quoted(IS_ASSIGNED)}, '')) >= 8 WHEN 'access' THEN length(found) >= 16
                             WHEN 'hex' THEN length(found) >= 32 ELSE what = 'weak' END),
o AS (SELECT *, kind IN ('access', 'login') AS id_, kind IN ('assign', 'hex', 'key') AS secret_, kind = 'endpoint' AS end_, kind IN ('assign', 'access', 'hex') AS strong FROM v WHERE kind IS NOT NULL),
f AS (SELECT * FROM o WHERE strong OR NOT EXISTS (SELECT 1 FROM o x WHERE x.k = o.k AND x.strong AND x.b < o.e AND x.e > o.b)),
near AS (SELECT w.k, w.b, w.e, w.kind, bool_or(x.id_) AS i, bool_or(x.secret_) AS s, bool_or(x.end_) AS n
         FROM f w JOIN f x ON x.k = w.k AND x.scope = w.scope AND abs(x.b - w.b) <= {REACH} WHERE NOT w.strong GROUP BY ALL),
a AS (SELECT k, b, e, kind, TRUE AS strong FROM f WHERE strong
      UNION ALL SELECT k, b, e, kind, FALSE FROM near WHERE CASE kind WHEN 'login' THEN s WHEN 'key' THEN i OR n ELSE i AND s END),
z AS (SELECT *, kind || ':' || b || ':' || e AS span, list_position({KINDS}, kind) AS p FROM a)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY b, p) FILTER (strong), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY b, p), '') AS spans
FROM d LEFT JOIN z ON z.k = d.k GROUP BY d.k, d.doc_id
"""
