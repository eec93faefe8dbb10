"""Personal data: base patterns plus bootstrapped contextual extraction, all in Spark SQL functions.

Base spans come from four patterns (``BASE``), leftmost and without overlap per
kind, with the numeric checks applied afterwards. ``split`` and
``regexp_extract_all`` with one pattern give the gaps and the matches of a text,
whose lengths add up to positions. The Java patterns are the plain ones with
possessive runs and a look-behind that only forbids starts inside a run the
search has already tried, so long unbroken runs cost linear time.

The bootstrapped part follows the seed and pattern scheme:

* An instance is a base span, whatever its characters, or an identifier-like
  token (one with ``MIN_DIGITS`` digits or more) that overlaps none; its lexical
  pattern is the word before it, or the ``key=`` / ``key:`` in front of it in the
  same token. Spans in one token share its pattern. A word that itself holds
  several spans is no pattern.
* Seeds are the base spans. The pattern-instance graph has one edge per
  (pattern, instance) with its count.
* Patterns and instances score each other for ``ROUNDS`` rounds: a pattern's
  confidence is the score-weighted share of instances among *all* occurrences of
  its context in the corpus; an instance is as good as its best pattern. Context
  totals are counted over all tokens of all texts, for every pattern of the
  graph, so that one learned from a discovered instance is rated, too.
* Patterns with confidence of ``CONFIDENCE`` or more and at least ``SUPPORT``
  different trusted instances then mark the unseen identifiers they precede as
  spans of kind ``context``, unless these overlap a base span.

Defined cases: null and empty texts have no spans, counts of 0 and the digest of
the empty string; every input row gives one row, also rows that repeat a doc_id;
a null doc_id stays null; spans are in code points, end exclusive; equal starts
are listed in the order of the kinds; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ["email", "ip", "card", "phone", "context"]
#: Java form of the base patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TOKEN = r"(?:(?<!\S)|\G)[^\s0-9]*+[0-9]\S*+"
KEY = r"^([A-Za-z_]+[=:]+[\"']?)"
MIN_DIGITS = 3
SUPPORT = 3
CONFIDENCE = 0.8
ROUNDS = 3


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digit string passes the Luhn check."""
    back = F.reverse(F.split(digits, ""))
    doubled = F.transform(F.filter(back, lambda d: d != ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda t, d: t + d) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # a part is at most 255 when, without leading zeros, it has at most 3 digits and a small value
        part = lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) > 3, F.lit(False)).otherwise(
            F.substring(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), -3, 3).cast("int") <= 255)
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of every match: start and end in code points, and its text."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(matches)), lambda g: F.length(g)).alias("g"), matches.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + p["g"]
        e = s + F.length(p["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), p["m"].alias("m")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _spaced(c: Column) -> Column:
    return F.translate(c, "\t\n\r\f", "    ")


SPAN = "s:int,e:int,m:string,t:int,key:string,word:string"


def _in_context(text: Column, pattern: str) -> Column:
    """array<struct<SPAN>> of every match as in _located, with the start and key of its token and the word before that."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), matches.alias("m"))
    # last: the token of the match before, as far as read; empty when it holds several matches
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("t"), F.lit("").alias("key"), F.lit("").alias("word"), F.lit("").alias("last"),
                     F.expr(f"cast(array() as array<struct<{SPAN}>>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        gap, s = _spaced(p["g"]), acc["at"] + F.length(p["g"])
        e = s + F.length(p["m"])
        new = (acc["at"] == 0) | F.contains(gap, F.lit(" "))
        glue = F.substring_index(gap, " ", -1)
        body = F.rtrim(F.substr(gap, F.lit(1), F.length(gap) - F.length(glue)))
        word = (F.when(~new, acc["word"]).when((acc["at"] == 0) | F.contains(body, F.lit(" ")), F.substring_index(body, " ", -1))
                .when(acc["last"] == "", F.lit("")).otherwise(F.concat(acc["last"], body)))
        key = F.when(new, F.regexp_extract(glue, KEY, 1)).otherwise(acc["key"])
        t = F.when(new, s - F.length(glue)).otherwise(acc["t"])
        last = F.when(new, F.substring_index(F.concat(glue, p["m"]), " ", -1)).otherwise(F.lit(""))
        span = F.struct(s.alias("s"), e.alias("e"), p["m"].alias("m"), t.alias("t"), key.alias("key"), word.alias("word"))
        return F.struct(e.alias("at"), t.alias("t"), key.alias("key"), word.alias("word"), last.alias("last"),
                        F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of one kind as array<struct<SPAN>>; empty for null texts."""
    empty = F.expr(f"cast(array() as array<struct<{SPAN}>>)")
    found = F.filter(_in_context(text, BASE[kind]), lambda x: _valid(kind, x["m"]))
    return F.when(text.isNotNull() & text.rlike(HINT[kind]), found).otherwise(empty)


def _tokens(text: Column) -> Column:
    """Identifier-like tokens: array<struct<s, e, key, value, before>>, spans without the key and closing marks."""
    gaps = F.split(text, TOKEN, -1)
    raw = F.zip_with(_located(text, TOKEN), F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0))),
                     lambda t, g: F.struct(t["s"].alias("s"), t["m"].alias("m"), g.alias("g")))

    def shaped(x: Column) -> Column:
        key = F.regexp_extract(x["m"], KEY, 1)
        value = F.regexp_replace(F.substr(x["m"], F.length(key) + 1), r"[\"',;.!?)]+$", "")
        s = x["s"] + F.length(key)
        before = F.substring_index(F.rtrim(_spaced(x["g"])), " ", -1)
        return F.struct(s.alias("s"), (s + F.length(value)).alias("e"), value.alias("value"),
                        F.lower(F.when(key != "", key).otherwise(before)).alias("pattern"), (key != "").alias("inner"))

    kept = F.filter(F.transform(raw, shaped), lambda x: (F.length(_digits(x["value"])) >= MIN_DIGITS) & (x["pattern"] != ""))
    empty = F.expr("cast(array() as array<struct<s:int,e:int,value:string,pattern:string,inner:boolean>>)")
    return F.when(text.isNotNull() & text.rlike(r"[0-9]"), kept).otherwise(empty)


def _overlaps(spans: Column, s: Column, e: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < e) & (s < b["e"]))


def _instances(found: DataFrame) -> DataFrame:
    """A row per instance: text key, s, e, value, pattern, inner, seed, and ``again`` (1 when its token has given an instance already)."""
    inner = lambda x: x["key"] != ""
    at = F.array_sort(F.transform("raw", lambda x: F.struct(
        x["t"].alias("t"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("value"),
        F.lower(F.when(inner(x), x["key"]).otherwise(x["word"])).alias("pattern"), inner(x).alias("inner"))))
    seeds = F.transform("at", lambda x, i: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value"), x["pattern"].alias("pattern"), x["inner"].alias("inner"),
        F.lit(True).alias("seed"), F.when((i > 0) & (F.get("at", i - 1)["t"] == x["t"]), 1).otherwise(0).alias("again")))
    others = F.transform(F.filter("tokens", lambda t: ~_overlaps(F.col("raw"), t["s"], t["e"])), lambda t: F.struct(
        t["s"].alias("s"), t["e"].alias("e"), t["value"].alias("value"), t["pattern"].alias("pattern"), t["inner"].alias("inner"),
        F.lit(False).alias("seed"), F.lit(0).alias("again")))
    return (found.withColumn("at", at).select(*TEXT_KEY, F.explode(F.concat(F.filter(seeds, lambda x: x["pattern"] != ""), others)).alias("t"))
            .select(*TEXT_KEY, "t.*"))


def patterns(marked: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """High-confidence patterns (pattern, inner) of the bootstrapped graph.

    ``marked`` has a row per instance: pattern, inner, value, seed, again.
    """
    edges = scratch.cut(marked.groupBy("pattern", "inner", "value").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("seed").cast("double")).alias("seed"), F.sum("again").alias("again")), "edges")
    # All occurrences of a context, in all tokens of all texts; a token of several instances is one for each.
    word, key = F.col("word"), F.regexp_extract("word", KEY + ".", 1)
    words = (docs.where("text IS NOT NULL").select(F.explode(F.split(_spaced(F.lower("text")), " ")).alias("word")).where("word != ''")
             .select(word, F.when(F.contains(word, F.lit("=")) | F.contains(word, F.lit(":")), key).otherwise(F.lit("")).alias("key"))
             .select(F.explode(F.when(F.col("key") == "", F.array(F.struct(word.alias("pattern"), F.lit(False).alias("inner")))).otherwise(
                 F.array(F.struct(word.alias("pattern"), F.lit(False).alias("inner")), F.struct(F.col("key").alias("pattern"), F.lit(True).alias("inner"))))).alias("c"))
             .select("c.*").groupBy("pattern", "inner").agg(F.count(F.lit(1)).alias("total")))
    contexts = edges.groupBy("pattern", "inner").agg(F.sum("again").alias("again"))
    totals = scratch.cut(words.join(contexts, ["pattern", "inner"]).select("pattern", "inner", (F.col("total") + F.col("again")).alias("total")), "totals")
    score = edges.groupBy("value").agg(F.max("seed").alias("score"))
    for turn in range(ROUNDS):
        rated = (edges.join(score, "value").groupBy("pattern", "inner")
                 .agg(F.sum(F.col("n") * F.col("score")).alias("good"), F.sum(F.when(F.col("score") >= 0.5, 1).otherwise(0)).alias("support"))
                 .join(totals, ["pattern", "inner"])
                 .select("pattern", "inner", (F.col("good") / F.col("total")).alias("confidence"), "support")
                 .where(F.col("support") >= SUPPORT))
        rated = scratch.cut(rated, f"patterns{turn}")
        score = scratch.cut(edges.join(rated, ["pattern", "inner"], "left").groupBy("value").agg(
            F.greatest(F.max("seed"), F.coalesce(F.max("confidence"), F.lit(0.0))).alias("score")), f"scores{turn}")
    return rated.where(F.col("confidence") >= CONFIDENCE).select("pattern", "inner")


TEXT_KEY = ["_text_1", "_text_2"]


def _with_key(docs: DataFrame) -> DataFrame:
    """A 128-bit key of the text, equal for copies."""
    return (docs.withColumn("_text_1", F.xxhash64("text")).withColumn("_text_2", F.xxhash64(F.lit("text"), "text")))


def find(docs: DataFrame, scratch: Scratch | None = None, patterns_only: bool = False) -> DataFrame:
    """(text key, base, spans) of every different text that has a span; or the
    trusted patterns (pattern, inner) alone.

    ``base`` and ``spans`` are arrays of (s, k, e), k the kind's number, by start
    and then kind. The result is narrow; texts don't pass through a shuffle.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    raw = F.concat(*[F.transform(base_spans(F.col("text"), k), _numbered(i)) for i, k in enumerate(KINDS[:4])])
    found = scratch.cut(_with_key(docs.select("text").where("text IS NOT NULL"))
                        .select(*TEXT_KEY, raw.alias("raw"), _tokens(F.col("text")).alias("tokens"))
                        .where("size(tokens) > 0 OR size(raw) > 0"), "found")
    found = found.withColumn("base", F.array_sort(F.transform("raw", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))))
    marked = _instances(found)
    good = patterns(marked, docs, scratch)
    if patterns_only:
        return good
    extra = (marked.where("NOT seed").join(good, ["pattern", "inner"], "left_semi")
             .groupBy(*TEXT_KEY).agg(F.collect_set(F.struct("s", F.lit(4).alias("k"), "e")).alias("extra")))
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    return (found.select(*TEXT_KEY, "base").dropDuplicates(TEXT_KEY).join(extra, TEXT_KEY, "left")
            .select(*TEXT_KEY, "base", F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("spans"))
            .where("size(spans) > 0"))


def _numbered(kind: int):
    return lambda x: F.struct(F.lit(kind).alias("k"), *[x[c].alias(c) for c in ("s", "e", "m", "t", "key", "word")])


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    docs = docs.select("doc_id", "text")
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    found = (_with_key(docs).select("doc_id", *TEXT_KEY).join(find(docs), TEXT_KEY, "left")
             .withColumn("base", F.coalesce("base", none)).withColumn("spans", F.coalesce("spans", none)))
    kinds = F.transform("base", lambda x: x["k"])
    count = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *count, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


#: Up to so many trusted patterns are put into the plan itself; beyond it they are joined.
INLINE_PATTERNS = 256


def _spans_in_place(rows: DataFrame, good: list) -> DataFrame:
    """``rows`` (text, ...) with ``spans``: base spans and those of trusted patterns as
    array<struct<s, k, e>>, from the text alone. Each step ends in an ``explode`` of one
    element, so it is computed once a row and not again wherever it is used."""
    def once(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))

    text = F.col("text")
    raw = F.concat(*[F.transform(base_spans(text, k), _numbered(i)) for i, k in enumerate(KINDS[:4])])
    rows = once(rows, "spans", F.transform(raw, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    if good:
        trusted = F.array(*[F.struct(F.lit(g["pattern"]).alias("pattern"), F.lit(g["inner"]).alias("inner")) for g in good])
        rows = once(rows, "tokens", _tokens(text))
        extra = F.transform(F.filter("tokens", lambda t: F.array_contains(trusted, F.struct(t["pattern"].alias("pattern"), t["inner"].alias("inner")))
                                     & ~_overlaps(F.col("spans"), t["s"], t["e"])), lambda t: F.struct(t["s"].alias("s"), F.lit(4).alias("k"), t["e"].alias("e")))
        rows = rows.select(*[c for c in rows.columns if c not in ("spans", "tokens")], F.concat("spans", F.array_distinct(extra)).alias("spans"))
    return once(rows, "spans", F.array_sort("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars`` follows the new text.

    Of overlapping spans the first names the replacement and all are covered.
    The rows travel as one struct beside the text, so no column of theirs can
    clash with one of this module. With few trusted patterns, the usual case, a
    text's spans are found where it is read and no text is shuffled.
    """
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    scratch = Scratch(docs.sparkSession, "pii-redact")
    good = scratch.cut(find(docs, scratch, patterns_only=True), "trusted")
    few = good.limit(INLINE_PATTERNS + 1).collect()
    if len(few) <= INLINE_PATTERNS:
        found = _spans_in_place(rows, sorted(few, key=lambda g: (g["pattern"], g["inner"])))
        found = found.withColumn("spans", F.when(F.size("spans") > 0, F.col("spans")))
    else:
        found = _with_key(rows).join(find(docs).select(*TEXT_KEY, "spans"), TEXT_KEY, "left")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    nothing = F.expr("cast(array() as array<string>)")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        add = F.when(x["s"] >= acc["at"], F.array(gap, F.element_at(names, x["k"] + 1))).otherwise(nothing)
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], add).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(
        F.concat_ws("", acc["out"]), F.substr(F.col("text"), acc["at"] + 1, F.length("text"))))
    redacted = found.withColumn("text", F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("text")))
    length = F.when(F.col("spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None
    values = {"text": F.col("text"), "n_chars": length}
    return redacted.select(*[(values[c] if c in values else F.col("row").getField(c)).alias(c) for c in docs.columns])
