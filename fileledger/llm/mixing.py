"""Mix sources to target weights.

Every row gets a hash-random key and rows are range-sorted by it inside their source.
Distributed prefix sums of the word counts tell where a source's budget ends: rows
before the cut are taken once more than the full epochs, the row on the cut gives the
words that are still missing, rows behind it give none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.llm.common import WORD, prefix_sums, word_count
from fileledger.session import cut_lineage


def random_key(doc_id: Column) -> Column:
    """64 hash bits of the id as hex; they depend on nothing else, so reruns agree."""
    return F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 16)


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Per source: source_size and target.

    The sources, by code point and null last, take ``weights`` in turn. They share
    ``share`` of all sizes by weight; a target stops at ``most`` times its source's size
    and what is cut off goes to the others by weight, until none is above. Each round is
    one aggregate over the sources, whose result is a single row.
    """
    sources = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull()))
    numbered = prefix_sums(sources, [], ["_null", "source"], F.lit(1), "_at")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    table = cut_lineage(numbered.select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * most
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        # A source whose cap is at or below its share stays capped: the level only rises.
        capped = cap <= F.lit(level) * F.col("weight")
        row = table.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if not row["open"]:
            break
        raised = (total * share - row["fixed"]) / row["open"]
        if raised <= level:
            break
        level = raised
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2
) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, and the sort key.

    ``taken`` counts the words taken, repeats included. Words taken from a source equal
    its target rounded to a whole number. Null texts and texts without a word have size 0
    and give nothing; rows with equal ids are separate rows; a null source is a source of
    its own; an empty table gives an empty plan. Other columns are ignored.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = cut_lineage(sized.withColumn("_key", random_key(F.col("doc_id"))))
    targets = source_targets(sized, weights, share, most).withColumnRenamed("source", "_source")
    placed = prefix_sums(sized, ["source"], ["_key", "doc_id", "size"], F.col("size"))
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    once = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    taken = (epochs * F.col("size") + once).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "_key", epochs.alias("_epochs"), once.alias("_once"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies, and the part on each cut.

    The cut of a source is one sort position, so the texts meet a table of one row per
    source and are never sorted. Rows with the id of the cut row and its size are treated
    like it. ``n_chars`` is set anew where a text is cut; texts without a word are left out.
    """
    plan = mix_plan(docs, **settings)
    position = F.struct("_key", "doc_id", "size")
    whole = F.when((F.col("_once") == F.col("size")) & (F.col("size") > 0), position)
    part = F.when((F.col("_once") > 0) & (F.col("_once") < F.col("size")), position)
    cuts = plan.groupBy(F.col("source").alias("_source")).agg(
        F.max("_epochs").alias("_epochs"), F.max(whole).alias("_last"), F.min(part).alias("_part"),
        F.min(F.when(part.isNotNull(), F.col("_once"))).alias("_words"),
    )
    cuts = cut_lineage(cuts)
    row = docs.select(F.struct(*docs.columns).alias("row"))
    here = F.struct(random_key(F.col("row.doc_id")).alias("_key"), F.col("row.doc_id").alias("doc_id"), word_count(F.col("row.text")).alias("size"))
    met = row.withColumn("_here", here).filter("_here.size > 0").join(cuts, F.col("row.source").eqNullSafe(F.col("_source")), "left")
    whole_times = F.col("_epochs").cast("int") + F.coalesce((F.col("_here") <= F.col("_last")).cast("int"), F.lit(0))
    cut_here = F.coalesce(F.col("_here") == F.col("_part"), F.lit(False))
    met = met.withColumn("_whole", whole_times).withColumn("_times", whole_times + cut_here.cast("int")).filter("_times > 0")
    copies = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    short = F.col("_copy") > F.col("_whole")
    # Words with the white space before them, so that the kept part is unchanged.
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.coalesce("_words", F.lit(0)), F.lit(0)).cast("int")), "")
    out = copies.withColumn("_text", F.when(short, cut).otherwise(F.col("row.text")))
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(short, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[x.alias(c) for c, x in columns.items()])
