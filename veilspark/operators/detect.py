"""Detection of sensitive fields by rules, labels and dictionaries.

Defined results: null and empty texts hold nothing; a value is an entity once per scope, kind and spelling, with the attributes of its first
occurrence by text order, rule order and match order; ties cannot arise, as that order is total. Repeated rows change nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.numbering import number_within
from veilspark.functions.text import ascii_digits, clean_label_value, strip
from veilspark.operators.rules import DICTIONARY_PREFIX, RULES, TECHNICAL_SIGNAL, WORDS, Rule


def amount_range(value: Column) -> Column:
    """The bucket, in ten thousands, of an amount; a number without unit counts as ten thousands. Null stays null."""
    n = ascii_digits(F.regexp_extract(value, r"\p{Nd}+(?:\.\p{Nd}+)?", 0)).try_cast("double")
    low = F.lower(value)
    scaled = (
        F.when(value.contains("亿元"), n * 10000)
        .when(value.contains("万元"), n)
        .when(value.contains("元"), n / 10000)
        .when(value.contains("$") | low.contains("usd") | low.contains("dollar"), n * 7.2 / 10000)
        .when(low.contains("rmb") | low.contains("cny"), n / 10000)
        .otherwise(n)
    )
    bucket = F.when(value.isNull(), None).when(scaled.isNull(), "金额区间未知")
    for edge, label in ((10, "低于10万"), (50, "10万至50万"), (100, "50万至100万"), (500, "100万至500万"), (1000, "500万至1000万"), (5000, "1000万至5000万")):
        bucket = bucket.when(scaled < edge, label)
    return bucket.otherwise("高于5000万")


def technical_signal(text: Column) -> Column:
    """Whether a text speaks of technical results; null counts as no text."""
    return F.coalesce(text, F.lit("")).rlike(TECHNICAL_SIGNAL)


def words(text: Column) -> Column:
    """The words of a text that are long enough for the rules of whole words; cut once for all of them."""
    return F.regexp_extract_all(text, F.lit(WORDS), 0)


def matches(text: Column, rule: Rule, cut_words: Column | None = None) -> Column:
    """All values of one rule in a text, in order, cleaned."""
    if rule.sort == "word":
        whole = (f"(?{rule.flags}u)" if rule.flags else "") + f"^(?:{rule.core})$"
        return F.filter(words(text) if cut_words is None else cut_words, lambda w: w.rlike(whole))
    found = F.regexp_extract_all(text, F.lit(rule.java), 1)
    if rule.sign:
        found = F.when(text.rlike(rule.sign), found).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(found, clean_label_value if rule.sort == "label" else strip), lambda x: x != "")


def rule_hits(df: DataFrame, text: str, rule: Rule) -> DataFrame:
    """The columns of ``df`` without the text, with match_ord and original for each match of the rule."""
    rest = [c for c in df.columns if c != text]
    return df.filter(F.col(text).rlike(rule.sign or rule.java)).select(*rest, F.posexplode(matches(F.col(text), rule)).alias("match_ord", "original"))


def _first(found: DataFrame, scope: list[str]) -> DataFrame:
    """One row for each (scope, kind, original): the first by order. Map-side combine; no window."""
    first = F.min(F.struct("text_ord", "rule_ord", "match_ord", "placeholder_prefix", "strategy", "replacement_hint")).alias("f")
    return found.groupBy(*scope, "kind", "original").agg(first).select(*scope, "kind", "original", "f.placeholder_prefix", "f.strategy", "f.replacement_hint")


def _occurrences(text: Column, i: int, rule: Rule, cut_words: Column) -> Column:
    def one(x: Column, j: Column) -> Column:
        hint = amount_range(x) if rule.name == "amount" else F.lit(None).cast("string")
        return F.struct(F.lit(i).alias("rule_ord"), j.alias("match_ord"), F.lit(rule.kind).alias("kind"), x.alias("original"), F.lit(rule.prefix).alias("placeholder_prefix"), F.lit(rule.strategy).alias("strategy"), hint.alias("replacement_hint"))

    return F.transform(matches(text, rule, cut_words), one)


def detect(df: DataFrame, scope: list[str], order: str, text: str) -> DataFrame:
    """(scope, kind, original, placeholder_prefix, strategy, replacement_hint) of all entities of all texts of a scope."""
    df = df.filter(F.col(text).isNotNull())
    df = df.select(*scope, F.col(order).alias("text_ord"), F.col(text).alias("_t"), words(F.col(text)).alias("_w"))
    found = df.select(*scope, "text_ord", F.inline(F.flatten(F.array(*[_occurrences(F.col("_t"), i, r, F.col("_w")) for i, r in enumerate(RULES)]))))
    return _first(found, scope)


def ordered(entities: DataFrame, scope: list[str]) -> DataFrame:
    """Entities with ``ord``, longest first, then by kind and spelling: the order in which replacement claims text."""
    keyed = entities.withColumn("_len", -F.length("original"))
    return number_within(keyed, scope, ["_len", "kind", "original"], "ord").drop("_len")


def dictionary_values(dictionary: DataFrame) -> DataFrame:
    """(project_id, kind, value, placeholder_prefix): each value of a customer dictionary once, stripped, blank ones dropped."""
    prefix = F.lit("自定义")
    for k, p in DICTIONARY_PREFIX.items():
        prefix = F.when(F.col("kind") == k, p).otherwise(prefix)
    v = dictionary.select("project_id", "kind", strip(F.col("value")).alias("value")).filter(F.length("value") > 0)
    return v.filter("kind is not null").distinct().withColumn("placeholder_prefix", prefix)


def with_dictionary(entities: DataFrame, present: DataFrame) -> DataFrame:
    """Entities plus the dictionary values found in the scope's texts that are not entities yet."""
    new = present.select("project_id", "kind", F.col("value").alias("original"), "placeholder_prefix", F.lit("pseudonym").alias("strategy"), F.lit(None).cast("string").alias("replacement_hint"))
    new = new.alias("n").join(entities.alias("e"), (F.col("n.project_id") == F.col("e.project_id")) & (F.col("n.kind") == F.col("e.kind")) & (F.col("n.original") == F.col("e.original")), "left_anti")
    return entities.select(new.columns).unionByName(new)


def body_then_channels(body: DataFrame, channels: DataFrame, scope: list[str]) -> DataFrame:
    """Body entities, then those of hidden channels that the body lacks, file by file; ``ord`` follows that order."""
    b = body.select(*scope, "kind", "original", "placeholder_prefix", "strategy", "replacement_hint", F.lit(0).alias("src"), F.lit(-1).alias("file_ord"))
    c = channels.select(*scope, "kind", "original", "placeholder_prefix", "strategy", "replacement_hint", F.lit(1).alias("src"), "file_ord")
    first = F.min(F.struct("src", "file_ord", (-F.length("original")).alias("len"), "placeholder_prefix", "strategy", "replacement_hint")).alias("f")
    one = b.unionByName(c).groupBy(*scope, "kind", "original").agg(first)
    flat = one.select(*scope, "kind", "original", "f.*")
    return number_within(flat, scope, ["src", "file_ord", "len", "kind", "original"], "ord").drop("src", "file_ord", "len")
