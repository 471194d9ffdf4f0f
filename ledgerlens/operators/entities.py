"""Entities in texts: names out of a dictionary, and the kinds that a pattern can tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import words

#: Forms of periods and amounts.
PATTERNS = {
    "period": "(Q[1-4] FY[0-9]{2}|Q[1-4] [0-9]{4}|(?:First|Second|Third|Fourth) Quarter [0-9]{4}|H[12] [0-9]{4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-[0-9]{2})",
    "amount": "([0-9][0-9.,]* (?:M EUR|k EUR|EUR/t|EUR|USD|MWh|kt|hours|points))",
}
#: Names of a dictionary up to which runs of words are picked by its first words, and that are broadcast at most; more are joined by shuffle.
SCANNED_NAMES, BROADCAST_NAMES = 5_000, 500_000


def _runs(longest: int, firsts: list[str] | None) -> Column:
    """All runs of up to so many words of the array w that begin with one of ``firsts`` (or with any word)."""
    at = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"))).otherwise(F.array().cast("array<int>"))
    if firsts is not None:
        at = F.filter(at, lambda i: F.element_at("w", i).isin(firsts))
    # runs over the end are shorter ones once more
    return F.flatten(F.transform(at, lambda i: F.array(*[F.array_join(F.slice("w", i, F.lit(k)), " ") for k in range(1, longest + 1)])))


def extract(texts: DataFrame, names: DataFrame, key: str = "chunk_id", text: str = "content", patterns: dict[str, str] | None = None) -> DataFrame:
    """(key, kind, entity): each once per text.

    ``names`` (kind, name) is a dictionary of the user's: companies, metrics, departments. A name is found where its words stand
    in the text one after the other, in any case and with punctuation around them; it may have up to as many words as the
    longest of the dictionary. Periods and amounts are found by their form. Null texts have none.
    """
    known = names.filter(F.col("kind").isNotNull() & F.col("name").isNotNull()).select("kind", F.col("name").alias("entity"), words(F.lower("name")).alias("w")).filter(F.size("w") > 0)
    known = known.select("kind", "entity", F.array_join("w", " ").alias("gram"), F.size("w").alias("n")).distinct()
    n, longest = known.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(1))).first()
    bare = F.transform(words(F.lower(F.col(text))), lambda x: F.trim(x, F.lit('.,;:!?"()')))
    rows = texts.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text, bare.alias("w"))
    firsts = [r[0] for r in known.select(F.split("gram", " ")[0]).distinct().collect()] if n <= SCANNED_NAMES else None
    grams = rows.select(key, F.explode(F.array_distinct(_runs(longest, firsts))).alias("gram"))
    known = known.drop("n")
    named = grams.join(F.broadcast(known) if n <= BROADCAST_NAMES else known, "gram").select(key, "kind", "entity").distinct()
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.regexp_extract_all(text, F.lit(p), 1)).alias("names")) for k, p in (patterns or PATTERNS).items()])
    formed = rows.select(key, F.explode(lists).alias("x")).select(key, F.col("x.kind").alias("kind"), F.explode("x.names").alias("entity"))
    return named.unionByName(formed)


def co_mentions(found: DataFrame, kind: str | None = None, key: str = "chunk_id") -> DataFrame:
    """(a, b, texts): names that stand in the same texts, a < b, and in how many; formed within each text."""
    rows = found if kind is None else found.filter(F.col("kind") == kind)
    per = rows.groupBy(key).agg(F.array_sort(F.collect_set("entity")).alias("names"))
    pairs = F.flatten(F.transform("names", lambda a: F.transform(F.filter("names", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return per.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("texts"))
