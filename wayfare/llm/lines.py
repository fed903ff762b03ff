"""Line dedup by a log-template tree of fixed depth; DataFrame functions only.

A line's words with a digit read as a variable field. Lines with as many words and the same LEAD first
words are one leaf of the tree. In a group of lines, at first a leaf, a word at a place is fixed if it stands
there in at least half of the group's lines; the others are variable fields. The fixed words are the line's template.
Templates that recur in enough documents, with enough fixed words, are boilerplate, and their lines go.

The lines that stay are split by their words at the place where frequent words other than the fixed one cover
most lines: one group for each frequent word, one for the lines with any other. That place splits no more below,
so there are at most as many rounds as a line has places. Equal lines are never parted, and in the last
group all their words are fixed, so a line that recurs often enough goes, whatever else fills its leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import salted_join, written

LEAD = 3
FIELD = "<*>"


def masked_words(line: Column) -> Column:
    """The words of a line, variable fields masked."""
    words = F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.rlike("[0-9]"), FIELD).otherwise(w))


def leaf_of(words: Column) -> Column:
    """Word count and leading words in 64 bits; collisions only join leaves."""
    return F.when(F.size(words) > 0, F.xxhash64(F.size(words), F.slice(words, 1, LEAD)))


def _round(each: DataFrame, min_docs: int, fixed_share: float) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, th, line_no) of the lines whose template recurs, and the others in smaller groups; None if no group splits.

    each: leaf (the group), doc_id, th, line_no, words; a written table.
    """
    size = each.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    at = each.select("leaf", F.posexplode("words").alias("at", "word")).groupBy("leaf", "at", "word").agg(F.count(F.lit(1)).alias("c"))
    # a word that is fixed or frequent stands in half of min_docs lines at least
    at = written(at.filter(2 * F.col("c") >= min_docs).join(size, "leaf"), "line-words")
    often = F.when(F.col("c") >= min_docs, F.col("c")).otherwise(0)
    # at most two words a place reach half; the greater stays if both do, and the other can split
    places = at.groupBy("leaf", "at").agg(F.max(F.when(2 * F.col("c") >= F.col("n"), F.struct("word", often.alias("c")))).alias("top"), F.sum(often).alias("cover"))
    places = places.select("leaf", "at", F.col("top.word").alias("word"), (F.col("cover") - F.coalesce("top.c", F.lit(0))).alias("cover"))
    groups = places.groupBy("leaf").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("word") != FIELD, F.struct("at", "word")))).alias("fixed"),
        F.max(F.when(F.col("cover") > 0, F.struct("cover", -F.col("at")))).alias("best"),
    )
    groups = written(groups.select("leaf", "fixed", (-F.col("best")["col2"]).alias("split_at")), "line-fixed")
    template = F.transform("words", lambda w, i: F.when(F.element_at("fixed", i) == w, w).otherwise(FIELD))
    share = F.size(F.filter(F.col("template"), lambda w: w != FIELD)) / F.size("template")
    shaped = (
        each.join(groups, "leaf").withColumn("template", template)
        .withColumn("template", F.when(share >= fixed_share, F.sha2(F.concat_ws(" ", "template"), 256)))
        .filter("template is not null or split_at is not null")
        .select("leaf", "doc_id", "th", "line_no", "template", "split_at", F.when(F.col("split_at").isNotNull(), F.col("words")).alias("words"))
    )
    shaped = written(shaped, "line-shaped")
    recur = shaped.filter("template is not null").select("template", "doc_id", "th").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs).select("template")
    recur = written(recur, "line-recur")
    # a hot template is dealt over tasks where its table is too large to broadcast
    found = salted_join(shaped, recur, ["template"], ["doc_id", "line_no"], merge=False).select("doc_id", "th", "line_no")
    words = at.filter(F.col("c") >= min_docs).join(groups.select("leaf", "split_at"), "leaf").filter("at = split_at").select("leaf", "word", F.lit(True).alias("frequent"))
    rest = salted_join(shaped.filter("split_at is not null"), recur, ["template"], ["doc_id", "line_no"], "left_anti", merge=False).withColumn("word", F.expr("words[split_at]"))
    rest = rest.join(words, ["leaf", "word"], "left")
    rest = rest.select(F.xxhash64("leaf", "split_at", F.when(F.col("frequent"), F.col("word"))).alias("leaf"), "doc_id", "th", "line_no", "words")
    rest = written(rest, "line-hot")
    return found, None if rest.isEmpty() else rest


def drop_templates(docs: DataFrame, *, min_docs: int = 10, fixed_share: float = 0.6) -> DataFrame:
    """doc_id, text, n_lines, n_dropped; one row per input row, text without the dropped lines.

    Lines are parted by \\n; a line without words stays. A null text has no lines and stays null. Rows with the
    same doc_id and text are one document; doc_id may be null. No rows give no rows.

    Leaves are counted from each document's distinct leaf hashes, with partial counts before the
    shuffle. Only lines of leaves that recur in min_docs documents are looked at word by word.
    """
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda x: masked_words(x))
    distinct = need.filter("text is not null").select(F.explode(F.array_distinct(F.transform(lines, leaf_of))).alias("leaf")).filter("leaf is not null")
    hot = written(distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs).select("leaf"), "line-leaves")
    # words and leaf of a line come from one array, so that no filter below computes them again
    shapes = F.transform(lines, lambda w: F.struct(w.alias("words"), leaf_of(w).alias("leaf")))
    each = (
        need.filter("text is not null").select("doc_id", "th", F.posexplode(shapes).alias("line_no", "line"))
        .select(F.col("line.leaf").alias("leaf"), "doc_id", "th", "line_no", F.col("line.words").alias("words"))
    )
    each = written(each.join(hot, "leaf"), "line-hot")
    gone = None
    while True:
        found, each = _round(each, min_docs, fixed_share)
        gone = found if gone is None else gone.unionByName(found)
        if each is None:
            break
    gone = gone.groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("gone")).withColumnsRenamed({"doc_id": "g_id", "th": "g_th"})
    gone = written(gone, "line-gone")
    # texts move once by doc_id, merged at every size, since what goes grows with the corpus
    out = need.join(gone.hint("merge"), need["doc_id"].eqNullSafe(gone["g_id"]) & need["th"].eqNullSafe(gone["g_th"]), "left")
    part = F.split("text", "\n", -1)
    left = F.filter(F.transform(part, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("gone", s["i"]))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda s: s["x"]), "\n"))
    return out.select(
        "doc_id", kept.alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(part)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
