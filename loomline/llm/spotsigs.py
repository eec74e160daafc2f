"""Document fingerprints by spot signatures, in DataFrame operations only.

A signature is a common word (the anchor, the last of its run) with the chain of the next two content words; a text's
first content words form one more, so that a text without common words has a signature too. A fingerprint is the set
of signature hashes, sorted. Candidates for comparison are partitioned by set length, as a similarity bounds the ratio
of lengths, and pairs are compared through pruned Jaccard: a pair whose lengths lie in partitions that aren't adjacent, or
that shares none of the hashes that come first in its sets, can't reach the similarity and isn't intersected for the verdict.

Each row is paired with its edited text and with the next document; near_edited and near_next are the exact
similarities that follow, and same_edited and same_next the verdicts of the pruned comparison.

The common words are a parameter; the default has the most usual function words of four languages.

Cases: a null text is empty; a text without words has an empty fingerprint (an empty string), alike only to another
empty one; repeated rows and equal texts have equal fingerprints; ties of doc_id are ordered by the text's hash; a
null doc_id sorts first; a single row is its own next document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import materialise, partitions

#: Function words of English, French, German and Spanish.
COMMON_WORDS = (
    "a an and are as at be but by for from had has have he in is it not of on or she that the this to was were which with you "
    "au aux avec ce dans de des du elle en est et il la le les ne nous par pas pour qui que sur un une vous "
    "auf aus das dem den der die ein eine er es für ich im ist mit nicht sich sie sind und von war wie zu "
    "al como con del el ella ha las lo los más no para pero por se ser si su sus una y"
)
COMMON_WORDS = tuple(dict.fromkeys(COMMON_WORDS.split()))


def signatures(text: Column, common: tuple[str, ...] = COMMON_WORDS) -> Column:
    """The sorted array of distinct signatures of a text, as hashes of 48 bits."""
    # Each common word is tied to the word after it ("of~the~house"), so that an element is a content word after its anchors.
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    tied = F.array_join(F.transform(words, lambda w: F.when(w.isin(list(common)), F.concat(w, F.lit("~"))).otherwise(F.concat(w, F.lit(" ")))), "")
    spots = F.when(tied != "", F.split(F.rtrim(F.concat(F.lit("^~"), tied)), " "))
    return F.coalesce(_chains(spots), F.array().cast("array<long>"))


def _chains(spots: Column) -> Column:
    # element i beside element i + 1: the first word of a chain with its anchors, and the second
    beside = F.zip_with(spots, F.slice(spots, F.lit(2), F.greatest(F.size(spots), F.lit(1))), lambda s, t: F.when(s.contains("~"), F.shiftrightunsigned(F.xxhash64(F.substring_index(s, "~", -2), F.substring_index(t, "~", -1)), 16)))
    return F.array_sort(F.array_distinct(F.filter(beside, lambda h: h.isNotNull())))


def as_text(signature_set: Column) -> Column:
    """A fingerprint as a string: the hashes in order, 12 hex digits each."""
    return F.array_join(F.transform(signature_set, lambda h: F.lower(F.lpad(F.hex(h), 12, "0"))), "")


def length_partition(signature_set: Column, threshold: float) -> Column:
    """Sets as alike as threshold lie in the same or adjacent partitions. An empty set is in -1."""
    return F.when(F.size(signature_set) == 0, -1).otherwise(F.floor(F.log(F.size(signature_set).cast("double")) / F.log(F.lit(1 / threshold)))).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; of two empty ones 1."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when(both == 0, 1.0).otherwise(shared / both)


def first_hashes(signature_set: Column, threshold: float) -> Column:
    """The hashes one of which two sets, ordered alike, have in common if they are as alike as threshold."""
    size = F.size(signature_set)
    return F.slice(signature_set, F.lit(1), (size - F.ceil(size * threshold) + 1).cast("int"))


def pruned_jaccard(a: Column, b: Column, threshold: float) -> Column:
    """Whether two sorted sets are as alike as threshold: by length partition, then first hashes, then intersection."""
    adjacent = F.abs(length_partition(a, threshold) - length_partition(b, threshold)) <= 1
    candidates = F.arrays_overlap(first_hashes(a, threshold), first_hashes(b, threshold))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(~both, F.size(a) == F.size(b)).when(~adjacent, False).when(~candidates, False).otherwise(likeness(a, b) >= threshold)


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): class representatives a < b with likeness of threshold or more, and doc_id, class_id of every row.

    A class is the documents of one fingerprint, named by its smallest doc_id; copies aren't paired. Sets are ordered by
    how many classes have a hash, the rarest first, so that boilerplate signatures are among the first ones of such sets
    only that have nothing else. Representatives in adjacent length partitions that share one of their first hashes
    are compared. Documents without signatures are classes of their own.
    """
    sets = materialise(docs.select("doc_id", signatures(F.col("text")).alias("set")).withColumn("key", F.sha2(as_text(F.col("set")), 256)), "spotsigs")
    classes = materialise(sets.where(F.size("set") > 0).groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("set").alias("set")), "spotsigs-classes")
    each = classes.select("key", F.explode("set").alias("hash"))
    ranked = each.join(each.groupBy("hash").agg(F.count("*").alias("classes")), "hash")
    ordered = ranked.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("classes", "hash"))), lambda x: x["hash"]).alias("rarest"))
    size = F.size("rarest")
    probes = ordered.join(classes.select("key", "class_id"), "key")
    probes = probes.withColumn("part", length_partition(F.col("rarest"), threshold)).select("key", "class_id", "part", size.alias("size"), F.explode(first_hashes(F.col("rarest"), threshold)).alias("hash"))
    a, b = probes.select(*[F.col(c).alias(f"{c}_a") for c in probes.columns]), probes.select(*[F.col(c).alias(f"{c}_b") for c in probes.columns])
    near = (F.col("hash_a") == F.col("hash_b")) & (F.col("key_a") < F.col("key_b")) & (F.abs(F.col("part_a") - F.col("part_b")) <= 1)
    near &= (F.col("size_a") >= F.col("size_b") * threshold) & (F.col("size_b") >= F.col("size_a") * threshold)
    pairs = a.join(b, near).select("key_a", "key_b").distinct()
    named = lambda x: classes.select(F.col("key").alias(f"key_{x}"), F.col("class_id").alias(x), F.col("set").alias(f"set_{x}"))
    pairs = pairs.join(named("a"), "key_a").join(named("b"), "key_b")
    pairs = pairs.withColumn("likeness", likeness(F.col("set_a"), F.col("set_b"))).where(F.col("likeness") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
    members = sets.join(classes.select("key", "class_id"), "key", "left").select("doc_id", F.when(F.size("set") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    return pairs, members


def dealt(docs: DataFrame, columns: list[str], ranges: int) -> DataFrame:
    """doc_id, order, tie, columns of every row, its range r, and whether it is a ghost there: the begin of the range after r.

    Rows are ordered by doc_id (those without first), then by a hash of columns. The borders of ranges are rows: those of
    ids that are approximate quantiles, and of an id that fills several ranges, those that are the first of equal parts
    of its hashes. So rows that share an id are dealt to as many ranges as they need.
    """
    low = -(1 << 63)
    order, tie = F.coalesce(F.col("doc_id"), F.lit(low)).cast("long"), F.xxhash64(*columns)
    rows = docs.select("doc_id", order.alias("order"), tie.alias("tie"), *columns)
    quantiles, least = rows.agg(F.percentile_approx("order", [i / ranges for i in range(ranges)], 100 * ranges), F.min("order")).first()
    parts = Counter(quantiles or [])
    parts.update({least} - {*parts, None})
    hot = {v: n for v, n in parts.items() if n > 1}
    borders = [(v, low) for v in parts if v not in hot]  # all rows of such an id are at the border
    if hot:
        of = F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("order"))
        part = F.shiftright((F.shiftright("tie", 40) + (1 << 23)) * of, 24)
        firsts = rows.where(F.col("order").isin(list(hot))).groupBy("order", part.alias("part")).agg(F.min("tie").alias("tie"))
        borders += [(r.order, r.tie) for r in firsts.collect()]  # no more than ranges
    borders = sorted(borders)
    step = max(1, int(len(borders) ** 0.5))
    coarse = [borders[i : i + step] for i in range(0, len(borders), step)] or [[(0, low)]]
    # two short scans find the range: first among every step-th border, then among the step borders there
    literal = lambda xs: F.array(*[F.struct(F.lit(o).cast("long").alias("o"), F.lit(t).cast("long").alias("t")) for o, t in xs])
    not_after = lambda b: (b["o"] < F.col("order")) | ((b["o"] == F.col("order")) & (b["t"] <= F.col("tie")))
    rows = rows.withColumn("block", F.greatest(F.size(F.filter(literal([x[0] for x in coarse]), not_after)), F.lit(1)))
    within = F.element_at(F.array(*[literal(x) for x in coarse]), F.col("block"))
    rows = rows.withColumn("own", (F.col("block") - 1) * step + F.size(F.filter(within, not_after)) - 1)
    is_border = F.exists(within, lambda b: (b["o"] == F.col("order")) & ((b["t"] == low) | (b["t"] == F.col("tie"))))
    before = F.pmod(F.col("own") - 1, F.lit(max(1, len(borders))))
    here, ghost = F.struct(F.col("own").alias("r"), F.lit(False).alias("ghost")), F.struct(before.alias("r"), F.lit(True).alias("ghost"))
    places = F.when(is_border, F.array(here, ghost)).otherwise(F.array(here))
    return rows.select("doc_id", "order", "tie", *columns, F.explode(places).alias("p")).select("doc_id", "order", "tie", *columns, "p.*")


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column]) -> DataFrame:
    """doc_id, columns and derived of every row, and next_<column> of the row that follows by doc_id (after the last: the first).

    What is derived of the columns is made after the exchange, so it isn't shuffled. Each range of rows is windowed by
    itself. The first row of a range goes to the range before it too, which so knows what follows its last.
    """
    placed = dealt(docs, columns, 4 * partitions(docs.sparkSession)).repartition("r").withColumns(derived)
    window = Window.partitionBy("r").orderBy("ghost", "order", "tie")
    all_columns = [*columns, *derived]
    after = [F.lead(c).over(window).alias(f"next_{c}") for c in all_columns]
    return placed.select("doc_id", *all_columns, *after, "ghost").where(~F.col("ghost")).drop("ghost")


def fingerprints_and_edits(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(own, ["text"], {"signs": signatures(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n", n).withColumn("half", half)
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("half")), F.substring("next_text", F.lit(1), F.col("half"))))
    rows = rows.withColumn("edited_signs", signatures(F.col("edited")))
    signs, edited, after = F.col("signs"), F.col("edited_signs"), F.col("next_signs")
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(signs).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
        likeness(signs, edited).cast("double").alias("near_edited"), likeness(signs, after).cast("double").alias("near_next"),
        pruned_jaccard(signs, edited, threshold).alias("same_edited"), pruned_jaccard(signs, after, threshold).alias("same_next"),
    )
