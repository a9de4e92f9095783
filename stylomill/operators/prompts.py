"""Prompt grids, holdout selections and stratified samples over small configuration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

LENGTH = "{length_hint}"


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """Named places of the template filled, white space squeezed."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return T.squeezed(template)


def filled(rows: DataFrame) -> DataFrame:
    """id, subject_id, branche, copy_type, tone, length, prompt of joined subject, type, tone and length rows."""
    prompt = rendered(F.col("template"), {"name": F.col("name"), "branche": F.col("branche"), "fakten_block": T.fact_block(F.col("fakten")), "tone_hint": F.col("tone_hint"), "length_hint": F.col("length_hint")})
    return rows.select(F.concat_ws("__", "subject_id", "copy_type", "tone", "length").alias("id"), "subject_id", "branche", "copy_type", "tone", "length", prompt.alias("prompt"))


def axes(lengths: DataFrame) -> DataFrame:
    """The lengths, and `na` for templates without a length."""
    own = lengths.select(F.col("id").alias("length"), F.col("hint").alias("length_hint"), F.lit(True).alias("uses_length"))
    return own.unionByName(lengths.sparkSession.createDataFrame([("na", "", False)], own.schema))


def grid(subjects: DataFrame, copy_types: DataFrame, tones: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every subject that may be profiled with every type and tone, and every length where the template asks for one."""
    who = subjects.where(F.coalesce("profiling", F.lit(True))).select(F.col("id").alias("subject_id"), "name", "branche", "fakten")
    what = copy_types.select(F.col("id").alias("copy_type"), "template", F.contains("template", F.lit(LENGTH)).alias("uses_length"))
    return filled(who.crossJoin(F.broadcast(what.join(axes(lengths), "uses_length"))).crossJoin(F.broadcast(tones.select(F.col("id").alias("tone"), F.col("hint").alias("tone_hint")))))


def broad_selection(copy_types: DataFrame, tones: list[str], lengths: list[str]) -> DataFrame:
    """copy_type, tone, length: each type with each tone, the length alternating with both places.  copy_types: id, ord."""
    each = copy_types.select(F.col("id").alias("copy_type"), "ord", F.posexplode(F.array(*map(F.lit, tones))).alias("j", "tone"))
    return each.select("copy_type", "tone", F.get(F.array(*map(F.lit, lengths)), F.pmod(F.col("ord") + F.col("j"), F.lit(len(lengths))).cast("int")).alias("length"))


def selected(selection: DataFrame, subject: DataFrame, copy_types: DataFrame, tones: DataFrame, lengths: DataFrame) -> DataFrame:
    """Prompts of one subject; every row of the selection must find its type, tone and length."""
    what = copy_types.select(F.col("id").alias("copy_type"), "template", F.contains("template", F.lit(LENGTH)).alias("uses_length"))
    rows = selection.join(F.broadcast(what), "copy_type", "left")
    rows = rows.withColumn("length", F.when(F.col("uses_length"), F.col("length")).otherwise("na"))
    rows = rows.join(F.broadcast(axes(lengths).drop("uses_length")), "length", "left").join(F.broadcast(tones.select(F.col("id").alias("tone"), F.col("hint").alias("tone_hint"))), "tone", "left")
    found = F.col("template").isNotNull() & F.col("length_hint").isNotNull() & F.col("tone_hint").isNotNull()
    rows = rows.withColumn("template", F.when(found, F.col("template")).otherwise(F.raise_error(F.concat(F.lit("unknown type, tone or length: "), F.concat_ws("/", "copy_type", "tone", "length")))))
    return filled(rows.crossJoin(F.broadcast(subject.select(F.col("id").alias("subject_id"), "name", "branche", "fakten"))))


def stratified(rows: DataFrame, n: int, stratum: str, key: str = "id", seed: int = 42, first: Column | None = None) -> DataFrame:
    """n rows: one of those marked by `first`, if any is, then one more of every stratum as far as n goes, in the strata's
    order, then others at random; the same for a seed."""
    chance = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))
    marked = F.coalesce(first, F.lit(False)) if first is not None else F.lit(False)
    own = rows.withColumn("__chance", chance).withColumn("__marked", marked)
    # Of the marked rows one is taken ahead of all strata.
    lead = own.where("__marked").orderBy("__chance", key).limit(1).select(F.col(key).alias("__lead"))
    own = own.join(F.broadcast(lead), F.col(key) == F.col("__lead"), "left")
    nth = F.row_number().over(W.partitionBy(stratum, F.col("__lead").isNotNull()).orderBy("__chance", key))
    ranked = own.withColumn("__turn", F.when(F.col("__lead").isNotNull(), 0).when(nth == 1, 1).otherwise(2))
    return ranked.orderBy("__turn", F.when(F.col("__turn") == 1, F.col(stratum)), "__chance", key).limit(n).drop("__chance", "__marked", "__lead", "__turn")


def by_type(rows: DataFrame, stratum: str = "copy_type", key: str = "id") -> DataFrame:
    """Each type with the ids of its rows, in order."""
    return rows.groupBy(stratum).agg(F.array_sort(F.collect_list(key)).alias("ids"))


def served(rows: DataFrame) -> DataFrame:
    """id, prompt as a served model is asked: facts under their own heading, white space only taken off the ends."""
    prompt = F.col("template")
    for name, value in {"name": F.col("name"), "branche": F.col("branche"), "fakten_block": T.fact_block(F.col("fakten"), T.SERVED_FACTS), "tone_hint": F.col("tone_hint"), "length_hint": F.col("length_hint")}.items():
        prompt = F.replace(prompt, F.lit("{" + name + "}"), value)
    return rows.select("id", F.regexp_replace(prompt, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "").alias("prompt"))


def looked_up(rows: DataFrame, id_: str, key: str = "id") -> DataFrame:
    """The row of that id; an error if there is none."""
    found = rows.where(F.col(key) == id_)
    missing = found.agg(F.count("*").alias("n")).select(F.assert_true(F.col("n") > 0, F.lit(f"no row has the id {id_}")).alias("ok"))
    return found.join(F.broadcast(missing), F.col("ok").isNull())


def suffix(temperature: float, repetition_penalty: float = 1.0, lora_scale: float = 1.0) -> str:
    """Part of an output's path: the parameters that differ from their defaults, and always the temperature."""
    return f"_t{temperature:g}" + (f"_rp{repetition_penalty:g}" if repetition_penalty != 1 else "") + (f"_ls{lora_scale:g}" if lora_scale != 1 else "")
