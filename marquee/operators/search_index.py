"""Substring search by an index of trigrams kept in a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.catalog import search
from marquee.sources.versions import Store, bucket

#: Trigrams that are looked up for a search: the rarest ones.
LOOKED_UP = 3


def trigrams(text):
    """The different runs of three characters of a text; none of a shorter one."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


class SearchIndex:
    """Postings (gram, id) and how many there are of each gram, by gram in buckets; a search reads the buckets of its rarest grams alone."""

    def __init__(self, store: Store, id_col: str = "id"):
        self.store, self.id_col = store, id_col
        #: Postings that the last search read.
        self.postings_read = 0

    def build(self, items: DataFrame, *columns: str, buckets: int = 64) -> None:
        text = F.lower(F.concat_ws(" ", *columns))
        with self.store.begin() as tx:
            # a file small enough for one task holds the texts of many postings, so items are dealt to all tasks first
            texts = items.select(F.col(self.id_col).alias("id"), text.alias("text")).repartition("id")
            grams = texts.select("id", F.explode(trigrams(F.col("text"))).alias("gram")).where(F.char_length("gram") == 3)
            tx.create("postings", grams, ["gram"], buckets)
            tx.create("grams", tx.read("postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")), ["gram"], buckets)

    def part(self, name: str, grams: list[str]) -> DataFrame:
        """The rows of a table whose gram is one of `grams`, from the buckets that these fall in."""
        table = self.store.manifest()["tables"][name]
        asked = self.store.spark.createDataFrame([(g,) for g in grams], "gram string").select(bucket(table)).distinct()
        return self.store.load(table, [r[0] for r in asked.collect()]).where(F.col("gram").isin(grams))

    def search(self, items: DataFrame, words: str, *columns: str) -> DataFrame:
        """What catalog.search() finds. Words of fewer than three characters have no trigram; they are searched for in all items."""
        text = words.strip().lower()
        grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
        if not grams:
            return search(items, words, *columns)
        known = sorted((r.n, r.gram) for r in self.part("grams", grams).collect())  # a row a trigram of the words
        if len(known) < len(grams):
            return items.limit(0)
        rarest = [gram for _, gram in known[:LOOKED_UP]]
        self.postings_read = sum(n for n, _ in known[:LOOKED_UP])
        hits = self.part("postings", rarest).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select(F.col("id").alias(self.id_col))
        return search(items.join(hits, self.id_col, "left_semi"), words, *columns)
