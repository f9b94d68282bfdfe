"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Well-formed e-mail addresses, IP addresses, card and phone numbers are the base
spans; they and long mixed tokens of letters and digits (secrets) are the seeds. The whole words
next to a seed induce patterns; all other tokens with a digit or an at sign are candidates and meet
the same patterns; groups of digits that single separators part are one candidate. Patterns and
instances score each other over a few rounds: a pattern's confidence in a kind is
the mean score of its distinct instances, an unseen instance's score the
noisy-or of its patterns. Candidates of a high score through patterns with enough
distinct seeds are added as spans of that kind, and so are secrets apart from base spans.

A null text counts as empty and has no spans. Offsets are code points, ends exclusive.
Repeated rows get equal results; a null doc_id is a row like any other. The work grows with a text's
length, however many matches it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Workspace, read

KINDS = ("email", "ip", "card", "phone")
#: Seeds that are no base spans.
MORE_KINDS = ("secret",)
#: The same languages as the plain expressions, with possessive repeats and starts that only a run's first character or
#: the end of the last match can be, so that long runs take linear time and no recursion.
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{32,}+",
}
#: Tokens that may be identifiers.
CANDIDATE = r"(?<![A-Za-z0-9._%+@-])\(?[A-Za-z._%+-]*+[0-9@](?:[A-Za-z0-9_%+@-]|\.(?=[A-Za-z0-9]))*+(?:(?<=[0-9])\)?[ /]\(?[0-9](?:[0-9_-]|\.(?=[0-9]))*+)*+"
#: Matches whose places are summed up at a time.
BLOCK = 512

SPAN = "array<struct<k:int,s:int,e:int,m:string,left:string,right:string>>"


def located(text: Column, expression: str, guard: Column, kind: int) -> Column:
    """Matches of `expression` (k, s, e, m) with the text up to the last match (left) and up to the next (right).

    Places are sums of lengths of matches and of the pieces between them, by blocks, so that no long array grows step by step.
    """
    found = F.when(guard, F.regexp_extract_all(text, F.lit(expression), F.lit(0)))
    pieces = F.when(guard, F.split(text, expression, -1))
    none = F.expr(f"cast(array() AS {SPAN})")

    def sized(x: Column) -> Column:
        lengths = F.transform(F.arrays_zip(x["m"], x["gap"]), lambda y: F.struct(F.length(y["gap"]).alias("gap"), F.length(y["m"]).alias("m")))
        return F.struct(x["m"].alias("m"), x["gap"].alias("gap"), F.filter(lengths, lambda y: y["m"].isNotNull()).alias("sizes"))

    # Bound by transform, so that nothing is evaluated for each match.
    bound = F.transform(F.array(F.struct(found.alias("m"), pieces.alias("gap"))), sized)
    return F.flatten(F.transform(bound, lambda x: F.when(F.size(x["sizes"]) > 0, _places(x, kind)).otherwise(none)))


def _places(x: Column, kind: int) -> Column:
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["sizes"]) - 1) / BLOCK).cast("int")), lambda b: F.slice(x["sizes"], b * BLOCK + 1, BLOCK))

    def add(done: Column, block: Column) -> Column:
        whole = F.aggregate(block, F.lit(0), lambda total, y: total + y["gap"] + y["m"])
        return F.struct((done["at"] + whole).alias("at"), F.concat(done["out"], F.array(F.struct(done["at"].alias("at"), block.alias("block")))).alias("out"))

    def step(done: Column, y: Column) -> Column:
        start = done["at"] + y["gap"]
        end = start + y["m"]
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(start.alias("s"), end.alias("e")))).alias("out"))

    begun = F.aggregate(blocks, F.expr("struct(0 AS at, cast(array() AS array<struct<at:int,block:array<struct<gap:int,m:int>>>>) AS out)"), add, lambda done: done["out"])
    placed = F.flatten(F.transform(begun, lambda b: F.aggregate(b["block"], F.struct(b["at"].alias("at"), F.expr("cast(array() AS array<struct<s:int,e:int>>)").alias("out")), step, lambda done: done["out"])))

    def whole(y: Column, i: Column) -> Column:
        left = F.concat(F.coalesce(F.get(x["m"], i - 1), F.lit("")), F.get(x["gap"], i))
        right = F.concat(F.get(x["gap"], i + 1), F.coalesce(F.get(x["m"], i + 1), F.lit("")))
        return F.struct(F.lit(kind).alias("k"), y["s"].alias("s"), y["e"].alias("e"), F.get(x["m"], i).alias("m"), left.alias("left"), right.alias("right"))

    return F.transform(placed, whole)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    back = F.reverse(number)

    def term(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), term) % 10 == 0


def _ip_parts_fit(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> Column:
    """All base spans of a text by kind, then start."""
    has_digit = text.rlike("[0-9]")
    out = []
    for kind, name in enumerate(KINDS):
        guard = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(name, F.lit(True))
        found = located(text, EXPRESSIONS[name], (guard if name == "email" else guard & has_digit), kind)
        if name == "ip":
            found = F.filter(found, lambda x: _ip_parts_fit(x["m"]))
        elif name == "card":
            found = F.filter(found, lambda x: F.when(F.length(digits(x["m"])).between(13, 19), luhn(digits(x["m"]))).otherwise(F.lit(False)))
        elif name == "phone":
            found = F.filter(found, lambda x: F.length(digits(x["m"])).between(9, 15))
        out.append(found)
    return F.concat(*out)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*(F.lit(k) for k in (*KINDS, *MORE_KINDS))), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _words(x: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(x, r"\s+", " ")))


def _met(span: Column) -> Column:
    """A span with the one, two and three whole words before it and the word after it."""
    left, right = _words(span["left"]), _words(span["right"])
    return F.struct(*(span[c].alias(c) for c in ("k", "s", "e", "m")), *(F.substring_index(left, " ", -n).alias(f"l{n}") for n in (1, 2, 3)), F.substring_index(right, " ", 1).alias("r1"))


def _apart(met: DataFrame) -> DataFrame:
    """Rows of met (key, k, s, e, ...) without secrets that overlap base spans and candidates that overlap either."""
    one = Window.partitionBy("key")
    before, after = (one.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("s"), F.desc("s")))
    base, seed = F.col("k").between(0, len(KINDS) - 1), F.col("k") >= 0

    def meets(which: Column) -> Column:
        reach, following = F.max(F.when(which, F.col("e"))).over(before), F.min(F.when(which, F.col("s"))).over(after)
        return F.coalesce(reach > F.col("s"), F.lit(False)) | F.coalesce(following < F.col("e"), F.lit(False))

    marked = met.dropDuplicates(["key", "k", "s", "e"]).withColumn("_base", meets(base)).withColumn("_seed", meets(seed))
    return marked.where(base | F.when(seed, ~F.col("_base")).otherwise(~F.col("_seed"))).drop("_base", "_seed")


def _mentions(spotted: DataFrame) -> DataFrame:
    """A row per seed and candidate: key, kind (null: candidate), s, e, value, patterns."""
    met = spotted.select("key", "seeded", F.explode("mentions").alias("x")).select("key", "seeded", "x.*")
    met = met.where("NOT seeded").drop("seeded").unionByName(_apart(met.where("seeded").drop("seeded")))
    value = F.lower(F.regexp_replace("m", r"[\s().-]+", "")).alias("value")
    context = F.array(*(F.concat(F.lit(f"L{n} "), F.when(F.col(f"l{n}") != "", F.col(f"l{n}"))) for n in (1, 2, 3)), F.concat(F.lit("R "), F.when(F.col("r1") != "", F.col("r1"))), F.when((F.col("l1") != "") & (F.col("r1") != ""), F.concat(F.lit("B "), "l1", F.lit(" _ "), "r1")))
    return met.select("key", F.when(F.col("k") >= 0, F.col("k")).alias("kind"), "s", "e", value, F.array_compact(context).alias("patterns"))


def discovered(mentions: DataFrame, ws: Workspace, rounds: int = 3, support: int = 5, confidence: float = 0.8, accept: float = 0.9) -> DataFrame:
    """value, kind of the instances that the pattern graph accepts."""
    seeds = mentions.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("seed"))
    edges = mentions.select(F.explode("patterns").alias("pattern"), "value").distinct()
    edges = ws.keep(edges.join(seeds, "value", "left"), "edges")
    scores = ws.keep(seeds.select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")), "scores")
    for _ in range(rounds):
        # A pattern's confidence in a kind is the mean score of all its distinct instances.
        counted = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
        good = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.count_if(F.col("seed") == F.col("kind")).alias("seeds"))
        rated = good.join(counted, "pattern").select("pattern", "kind", (F.col("total") / F.col("instances")).alias("conf"), "seeds").where((F.col("seeds") >= support) & (F.col("conf") >= confidence))
        rated = ws.keep(rated, "rated")
        fresh = edges.where("seed IS NULL").join(rated, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))))).alias("score"))
        scores = ws.keep(seeds.select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).union(fresh), "scores")
    unseen = scores.join(seeds.select("value"), "value", "left_anti").where(F.col("score") >= accept)
    best = unseen.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    return best.select("value", "kind")


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), workspace: Workspace | None = None, **options) -> DataFrame:
    """`keep`, base and spans (arrays of k, s, e: kind's place in KINDS and MORE_KINDS, start, end) for each row of docs."""
    ws = workspace or Workspace(docs.sparkSession, "pii")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), text.alias("t"))
    docs = docs.select("*", F.xxhash64(*(f"c{i}" for i in range(len(keep))), "t").alias("key"), base_spans(F.col("t")).alias("base"))
    t = F.col("t")
    digit = t.rlike("[0-9]")
    secrets = located(t, EXPRESSIONS["secret"], digit, len(KINDS))
    others = located(t, CANDIDATE, t.rlike("[0-9@]"), -1)
    plain = F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    seeds = docs.select("*", secrets.alias("secrets"), others.alias("others"))
    spotted = ws.keep(
        seeds.select(*(f"c{i}" for i in range(len(keep))), "key", plain.alias("base"), (F.size("base") + F.size("secrets") > 0).alias("seeded"), F.transform(F.concat("base", "secrets", "others"), _met).alias("mentions")),
        "spotted",
    )
    mentions = ws.keep(_mentions(spotted), "mentions")
    more = mentions.where("kind IS NULL").drop("kind").join(discovered(mentions, ws, **options), "value").select("key", "kind", "s", "e")
    more = more.union(mentions.where(F.col("kind") >= len(KINDS)).select("key", "kind", "s", "e"))
    more = more.groupBy("key").agg(F.collect_set(F.struct(F.col("kind").alias("k"), "s", "e")).alias("more"))
    whole = F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() AS array<struct<k:int,s:int,e:int>>)"))))
    return spotted.select(*(f"c{i}" for i in range(len(keep))), "key", "base").join(more, "key", "left").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "base", whole.alias("spans"))


def _of_kind(k: int):
    return lambda x: x["k"] == k


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"))
    counts = (F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS))
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
