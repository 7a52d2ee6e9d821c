"""Secret scans by multipart credential linking, with built-in functions only.

Base kinds (assign, access, hex) stand alone. Weak parts are reported only where complementary parts
co-occur in one scope, starts at most SCOPE code points apart in one document:
- a weak secret (a bare token of 32 or more letters, digits, + / _ - with upper, lower and digit, and its =
  padding, or a value named as a secret key) needs an identifier (an access key or a named user, client or
  account). One that lies inside a base span says nothing new and is left out;
- an identifier needs a secret: an assignment, a hex run or a weak secret, which it then supports in turn;
- an endpoint (URL or host:port) needs a secret that stands without it: a base one, or a weak one with an
  identifier. A rejected candidate supports nothing.
The links are interval joins: parts are laid into bins of SCOPE code points, each bin and role is reduced to
its first and last position before anything meets, and a part looks at three bins by an equality join.

Spans are code points, end exclusive. A base match is the leftmost non-overlapping match of its kind;
[0-9a-f]{24,} and AKIA[A-Z0-9]{16,} match just what their greedy "+" forms leave after the length test.

Defined cases: null text counts as empty; a row is a document of its own even if doc_id repeats or is
null; documents without spans have zero counts and the digest of the empty string. The patterns repeat single
characters only, so a text of any length needs no stack, and each starts once per token, so time stays linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, write_table

SCOPE = 256
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: kind -> pattern, in the order in which kinds of one start are listed; weak kinds follow the base kinds
BASE = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
WEAK = (
    ("weak_secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{32,}+={0,2}", "secret"),
    ("weak_id", r"""(?i:\b(?:user(?:name)?|login|client_?id|account(?:_?id)?|key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", "id"),
    ("endpoint", r"\bhttps?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/_.?=&%-]*|(?<![A-Za-z0-9.-])(?=[A-Za-z0-9-]++\.)[A-Za-z0-9.-]++(?<!\.):[0-9]{2,5}+\b", "endpoint"),
    ("named_secret", r"""(?i:\b(?:[a-z0-9]{1,32}[_-]){0,4}(?:secret(?:[_-]?access)?[_-]?key|client[_-]?secret))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", "secret"),
)
ROLE = {"assign": "secret", "access": "id", "hex": "secret"} | {kind: role for kind, _, role in WEAK}
KINDS = [kind for kind, _ in BASE] + [kind for kind, _, _ in WEAK]
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Spans are placed in runs of so many.
RUN = 128


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once: a lambda's variable instead of an expression that each element repeats."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(steps: Column, kind: int, least: int) -> Column:
    """Spans from steps (code points skipped, length, size of the tested group).

    Positions are running sums. They are made within runs of RUN steps and the runs are then moved by
    the sums before them, as a fold that appends copies its array at each step.
    """
    empty = F.array().cast(SPAN)
    span = lambda at, x: F.struct((at + x["skip"]).alias("start"), F.lit(kind).alias("kind"), (at + x["skip"] + x["len"]).alias("end"))
    run = lambda k: F.aggregate(
        F.slice(steps, k * RUN + 1, RUN), F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, x: F.struct((acc["at"] + x["skip"] + x["len"]).alias("at"), F.when(x["size"] >= least, F.array_append(acc["spans"], span(acc["at"], x))).otherwise(acc["spans"]).alias("spans")),
    )
    numbers = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int"))
    first = F.array().cast("array<int>")
    before = lambda runs: F.aggregate(
        runs, F.struct(F.lit(0).alias("at"), first.alias("all")), lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"],
    )
    moved = lambda r, by: F.transform(r["spans"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))
    joined = lambda runs: F.flatten(F.zip_with(runs, before(runs), moved))
    return F.when(F.size(steps) > 0, _bound(F.transform(numbers, run), joined)).otherwise(empty)


def spans_of(text: Column, pattern: str, kind: int, least: tuple[int, int] | None = None) -> Column:
    """Spans of the pattern's matches; least: a group and the number of characters that it must have.

    The text is cut at its matches; positions are running sums of the lengths of the pieces and matches.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(least[0])) if least else found
    matches = F.zip_with(found, sizes, lambda m, g: F.struct(F.length(m).alias("len"), F.length(g).alias("size")))
    # the last piece has no match after it
    steps = F.zip_with(matches, pieces, lambda m, piece: F.struct(F.length(piece).alias("skip"), m["len"].alias("len"), m["size"].alias("size")))
    steps = F.filter(steps, lambda x: x["len"].isNotNull())
    # most texts have no match: one search then, and no cutting
    return F.when(text.rlike(pattern), _bound(steps, lambda s: _placed(s, kind, least[1] if least else 0))).otherwise(F.array().cast(SPAN))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """_row (a number of the row), doc_id, base and weak spans; written, so that row numbers stay."""
    text = F.coalesce("text", F.lit(""))
    base = [spans_of(text, p, k, (2, 6) if kind == "assign" else None) for k, (kind, p) in enumerate(BASE)]
    weak = [spans_of(text, p, k + len(BASE)) for k, (_, p, _) in enumerate(WEAK)]
    return write_table(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.concat(*base).alias("base"), F.concat(*weak).alias("weak")), "spans")


def _near(weak: DataFrame, parts: DataFrame, complement: Column, scope: int) -> DataFrame:
    """The rows of weak that have one of parts, of a complementary role, at most scope code points from their start."""
    # one row per document, bin and role
    ends = parts.groupBy(F.col("_row").alias("r"), F.col("bin").alias("b"), F.col("role").alias("other")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    near = weak.withColumn("near", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    inside = (F.col("near") == F.col("bin")) | (F.col("last").between(F.col("start") - scope, F.col("start"))) | (F.col("first").between(F.col("start"), F.col("start") + scope))
    met = near.join(ends, (F.col("_row") == F.col("r")) & (F.col("near") == F.col("b")) & complement & inside, "left_semi")
    return met.drop("near").distinct()


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """_row and linked: the weak spans that have a complementary part in their scope."""
    roles = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    parts = scanned.where(F.size("weak") > 0).select("_row", F.explode(F.concat("base", "weak")).alias("s"))
    is_weak = F.col("kind") >= len(BASE)
    parts = parts.select("_row", F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"))
    # a weak secret inside a base span says nothing new; base spans come first among those of one start
    earlier = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("role", F.element_at(roles, F.col("kind") + 1)).withColumn("_reach", F.max(F.when(~is_weak, F.col("end"))).over(earlier))
    parts = parts.where(~(is_weak & (F.col("role") == "secret")) | F.col("_reach").isNull() | (F.col("_reach") < F.col("end"))).drop("_reach")
    # written: each of the joins below reads it
    parts = write_table(parts.withColumn("bin", F.floor(F.col("start") / scope)), "parts")
    weak = parts.where(is_weak)
    # a weak secret and an identifier support each other; an endpoint needs a secret that stands without it
    pairs = write_table(_near(weak.where("role <> 'endpoint'"), parts.where("role <> 'endpoint'"), F.col("role") != F.col("other"), scope), "pairs")
    firm = parts.where(~is_weak & (F.col("role") == "secret")).unionByName(pairs.where("role = 'secret'"))
    ends = _near(weak.where("role = 'endpoint'"), firm, F.lit(True), scope)
    return pairs.unionByName(ends).groupBy("_row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("linked"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, base and all: arrays of (start, kind, end), kind an index into KINDS."""
    scanned = scan(docs)
    found = scanned.join(settled(lambda: linked(scanned, scope), "linked"), "_row", "left")
    return found.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPAN)))).alias("all"))


def report(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return find_secrets(docs.select("doc_id", "text")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"),
    )
