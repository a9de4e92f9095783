"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates in each whole text.  The values' hashes are counted over the corpus by distinct repositories and
owners: a value that several owners hold is a copied example; one that stays with its owner looks live, a bare run of hex
digits only if it mixes letters and digits.  Live values add spans of kind `live` beside the base spans, as does `key` for well-known key prefixes.

A span counts code points, end exclusive.  Matches of a kind are leftmost and do not overlap; a match that is too short is
dropped after it was consumed.  Null texts are empty.  A null source is an owner of its own.  Each row gets one row, also
where ids repeat or are null.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parted, reshuffled, saved

VALUE = "([A-Za-z0-9+/_.=-]+)"
#: kind: pattern, and the least number of characters of the value (group 2 of assign, else the match).
BASE = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?" + VALUE, 12),
    "access": ("AKIA[A-Z0-9]+", 18),
    "hex": ("[0-9a-f]+", 16),
}
MORE = {"key": ("(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]+", 20)}
#: Patterns that some match must fit for a text to hold any span of the kind; they only save work.
GATES = {"assign": BASE["assign"][0], "access": "AKIA[A-Z0-9]{14}", "hex": "[0-9a-f]{16}", "key": MORE["key"][0]}
#: Owners, or repositories, from which on a value counts as a copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 5
#: Matches whose offsets are summed in one go; a text with more goes block by block.
BLOCK = 256
SPAN = "array<struct<start:int,end:int,ord:int,kind:string,value:string>>"


def let(value: Column, body) -> Column:
    """body of the value, computed once; inside a lambda a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, kind: str, pattern: str, least: int, ord_: int) -> Column:
    """The spans of one kind: the text between matches and the matches themselves, in turn, add up to their places."""
    grouped = kind == "assign"
    # One character class run is a match as a whole, so its minimum may stand in the pattern; a match of `assign` may not be cut short.
    exact = pattern if grouped else pattern[:-1] + "{%d,}" % (least - 4 if kind == "access" else least) if kind in ("access", "hex") else pattern
    pieces = F.arrays_zip(F.split(text, exact, -1).alias("gap"), F.regexp_extract_all(text, F.lit(exact), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(exact), F.lit(2 if grouped else 0)).alias("value"))
    matched = F.filter(pieces, lambda p: p["match"].isNotNull())

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["gap"])
        end = start + F.char_length(p["match"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), p["value"].alias("value")))).alias("out"))

    def summed(own: Column) -> Column:
        def block(acc: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(own, b * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out")), add)
            return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        numbers = F.sequence(F.lit(0), F.floor(F.size(own) / BLOCK).cast("int"))
        return F.flatten(F.aggregate(numbers, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out")), block, lambda acc: acc["out"]))

    return F.filter(let(matched, summed), lambda s: F.char_length(s["value"]) >= least)


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """row, id, key, doc_id, owner, repository, spans (of all patterns, in order) for every row of docs; a written table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("repository"), text.alias("text"))
    empty = F.expr(f"cast(array() as {SPAN})")
    found = [F.when(F.rlike("text", F.lit(GATES[kind])), spans_of(F.col("text"), kind, pattern, least, k)).otherwise(empty) for k, (kind, (pattern, least)) in enumerate((BASE | MORE).items())]
    return saved(
        own.select(
            F.monotonically_increasing_id().alias("row"),
            *row_key(),
            "doc_id",
            F.split_part("repository", F.lit("/"), F.lit(1)).alias("owner"),
            "repository",
            F.array_sort(F.concat(*found)).alias("spans"),
        ),
        "candidates",
    )


def row_key() -> tuple[Column, Column]:
    """What tells rows apart: the id, and a hash of whether there is one and of the text."""
    doc_id = F.col("doc_id").cast("long")
    return F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(doc_id.isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, owners, repositories, occurrences, live of every candidate value of the corpus."""
    each = found.select("owner", "repository", F.explode("spans").alias("s")).select("owner", "repository", F.xxhash64("s.value").alias("value_hash"), ((F.col("s.kind") != "hex") | F.rlike("s.value", F.lit("[a-f]")) & F.rlike("s.value", F.lit("[0-9]"))).alias("secret"))
    held = each.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"), F.max("secret").alias("secret"))
    by_owner = held.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"), F.max("secret").alias("secret"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences"), F.max("secret").alias("secret")).select(
        "value_hash", "owners", "repositories", "occurrences", (F.col("secret") & (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES)).alias("live")
    )


def live_spans(found: DataFrame) -> DataFrame:
    """row, live (spans of the values that look live), of the rows that have any."""
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s", F.xxhash64("s.value").alias("value_hash"))
    live = ownership(found).where("live").select(reshuffled("value_hash"))
    # The value stands at the end of its match.
    span = F.struct((F.col("s.end") - F.char_length("s.value")).alias("start"), F.col("s.end").alias("end"), F.lit(len(BASE | MORE)).alias("ord"), F.lit("live").alias("kind"), F.col("s.value").alias("value"))
    return each.join(live, "value_hash", "left_semi").groupBy("row").agg(F.array_distinct(F.array_sort(F.collect_list(span))).alias("live"))


def find_secrets(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, id, key, spans (all, by start and kind), for every row of docs(doc_id, text, source)."""
    found = candidates(docs, owner)
    return found.join(live_spans(found), "row", "left").select("doc_id", "id", "key", F.when(F.col("live").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "live"))).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], (s["start"]).cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))

    # Spans sort by start, then end; the digest asks for start, then kind.
    def by_kind(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return find_secrets(docs).select("doc_id", *counts, F.sha2(written(by_kind(base)).cast("binary"), 256).alias("base_sha256"), written(by_kind(F.col("spans"))).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the values that look live replaced in text; all other rows and columns as they were.

    Only rows that may hold such a value are shuffled, with their texts."""
    found = candidates(docs)
    live = found.select("row", "id", "key").join(live_spans(found), "row")
    values = saved(live.select("id", "key", F.array_distinct(F.transform("live", lambda s: s["value"])).alias("values")).dropDuplicates(["id", "key"]), "live")
    keyed = docs.select(*row_key(), F.struct("*").alias("own"))
    near, others = parted(keyed, ["id", "key"], values)
    longest = F.transform(F.reverse(F.array_sort(F.transform("values", lambda v: F.struct(F.char_length(v).alias("n"), v.alias("v"))))), lambda x: x["v"])
    text = F.col("own.text")
    hidden = F.when(F.col("values").isNull(), text).otherwise(F.aggregate(longest, text, lambda acc, v: F.replace(acc, v, F.lit(mark))))
    changed = near.join(values, ["id", "key"], "left").select(*(hidden.alias(c) if c == "text" else F.col(f"own.`{c}`") for c in docs.columns))
    return others.select("own.*").unionAll(changed)
