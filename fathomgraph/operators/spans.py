"""Annotated documents: spans, pruning, decoding of relations, and scores.

A sentence row is (doc, sent, offset, tokens); spans use document-level token numbers with an inclusive end. All spans
of a sentence come from one token array of one input row, which bounds every per-sentence group below.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unescape_brackets
from ..session import discard, durable

SENT = ["doc", "sent"]
ENDS = ["s1", "e1", "s2", "e2"]
#: Token numbers of a cell, by which parts of a sentence are joined.
CELL = 64

# Entity labels, symmetric relation labels (after 'NIL') and directed relation labels of each corpus.
LABELS = {
    "ace04": {
        "entity": ["NIL", "FAC", "WEA", "LOC", "VEH", "GPE", "ORG", "PER"],
        "symmetric": ["NIL", "PER-SOC"],
        "directed": ["OTHER-AFF", "ART", "GPE-AFF", "EMP-ORG", "PHYS"],
    },
    "ace05": {
        "entity": ["NIL", "FAC", "WEA", "LOC", "VEH", "GPE", "ORG", "PER"],
        "symmetric": ["NIL", "PER-SOC"],
        "directed": ["ART", "ORG-AFF", "GEN-AFF", "PHYS", "PART-WHOLE"],
    },
    "scierc": {
        "entity": ["NIL", "Method", "OtherScientificTerm", "Task", "Generic", "Material", "Metric"],
        "symmetric": ["NIL", "CONJUNCTION", "COMPARE"],
        "directed": ["PART-OF", "USED-FOR", "FEATURE-OF", "EVALUATE-FOR", "HYPONYM-OF"],
    },
    "other": {
        "entity": [
            "NIL", "CARDINAL", "DATE", "EVENT", "FAC", "GPE", "LANGUAGE", "LAW", "LOC", "MONEY", "NORP", "ORDINAL", "ORG",
            "PERCENT", "PERSON", "PRODUCT", "QUANTITY", "TIME", "WORK_OF_ART",
        ],
        "symmetric": ["NIL"],
        "directed": [],
    },
}


def label_table(spark, corpora: Sequence[str] = tuple(LABELS)) -> DataFrame:
    """(corpus, kind, label_id, label); relation classes number symmetric, directed, then inverse labels."""
    rows = []
    for corpus in corpora:
        sets = LABELS[corpus]
        rows += [(corpus, "entity", i, label) for i, label in enumerate(sets["entity"])]
        rows += [(corpus, "relation", i, label) for i, label in enumerate(relation_classes(sets["symmetric"], sets["directed"]))]
    return spark.createDataFrame(rows, "corpus string, kind string, label_id int, label string")


def relation_classes(symmetric: Sequence[str], directed: Sequence[str]) -> list[str]:
    return [*symmetric, *directed, *[f"{label}^-1" for label in directed]]


def typed_documents(docs: DataFrame) -> DataFrame:
    """Cast the text triples and quintuples of annotated documents to structs."""

    def spans(c: str) -> Column:
        return F.transform(c, lambda s: F.transform(s, lambda x: F.struct(
            x[0].cast("int").alias("s"), x[1].cast("int").alias("e"), x[2].alias("label"))))

    relations = F.transform("relations", lambda s: F.transform(s, lambda x: F.struct(
        x[0].cast("int").alias("s1"), x[1].cast("int").alias("e1"), x[2].cast("int").alias("s2"), x[3].cast("int").alias("e2"),
        x[4].alias("label"))))
    out = docs.withColumn("ner", spans("ner")).withColumn("relations", relations)
    return out.withColumn("predicted_ner", spans("predicted_ner")) if "predicted_ner" in docs.columns else out


def sentences(docs: DataFrame, doc: str = "doc", column: str = "sentences") -> DataFrame:
    """One row per sentence with the number of tokens before it in the document."""
    offsets = F.aggregate(
        column, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(s)))
    )
    sized = docs.select(F.col(doc).alias("doc"), F.col(column).alias("_s"), offsets.alias("_o"))
    total = F.element_at("_o", -1)
    rows = sized.select(
        "doc", total.alias("doc_tokens"),
        F.posexplode(F.arrays_zip(F.col("_s").alias("tokens"), F.slice("_o", 1, F.size("_s")).alias("offset"))).alias("sent", "_z"),
    )
    return rows.select("doc", "sent", F.col("_z.offset").alias("offset"), "doc_tokens", unescape_brackets(F.col("_z.tokens")).alias("tokens"))


def gold_spans(docs: DataFrame, column: str = "ner") -> DataFrame:
    """(doc, sent, s, e, label) of typed documents."""
    return docs.select("doc", F.posexplode(column).alias("sent", "_x")).select("doc", "sent", F.inline("_x"))


def _span_rows(ranges: DataFrame, longest: int, *carry: str) -> DataFrame:
    """All spans of up to ``longest`` tokens that start in ``_from`` to ``_to`` and end by ``_last``."""
    starts = ranges.select(*SENT, "_last", *carry, F.explode(F.sequence("_from", "_to")).alias("s"))
    return starts.select(*SENT, "s", F.explode(F.sequence(F.col("s"), F.least(F.col("s") + longest - 1, F.col("_last")))).alias("e"), *carry)


def _token_range(sents: DataFrame) -> DataFrame:
    """(doc, sent, _from, _last): first and last token number of the sentences that have any."""
    n = F.size("tokens")
    return sents.filter(n > 0).select(*SENT, F.col("offset").alias("_from"), (F.col("offset") + n - 1).alias("_last"))


def candidate_spans(sents: DataFrame, longest: int = 8) -> DataFrame:
    """All spans of up to ``longest`` tokens inside a sentence."""
    return _span_rows(_token_range(sents).withColumn("_to", F.col("_last")), longest)


def label_spans(sents: DataFrame, gold: DataFrame, longest: int = 8, cell: int = CELL) -> DataFrame:
    """The candidate spans of the sentences with their gold label, NIL without one.

    Sentences are cut into cells of ``cell`` token numbers and meet the gold spans that start in the same cell; spans are
    listed after this join, so none of them is shuffled.
    """
    number = lambda c: F.floor(F.col(c) / cell).cast("int")
    cells = _token_range(sents).withColumn("_cell", F.explode(F.sequence(number("_from"), number("_last"))))
    held = gold.groupBy(*SENT, number("s").alias("_cell")).agg(F.collect_list(F.struct("s", "e", F.coalesce("label", F.lit("NIL")).alias("label"))).alias("_gold"))
    first, last = F.col("_cell") * cell, (F.col("_cell") + 1) * cell - 1
    ranges = cells.join(held, [*SENT, "_cell"], "left").withColumns({"_from": F.greatest("_from", first), "_to": F.least("_last", last)})
    spans = _span_rows(ranges, longest, "_gold")
    labels = F.transform(F.filter("_gold", lambda g: (g["s"] == F.col("s")) & (g["e"] == F.col("e"))), lambda g: g["label"])
    return spans.select(*SENT, "s", "e", labels.alias("_labels")).select(
        *SENT, "s", "e", F.explode(F.when(F.size("_labels") > 0, F.col("_labels")).otherwise(F.array(F.lit("NIL")))).alias("label")
    )


def context_window(sents: DataFrame, budget: int) -> DataFrame:
    """Tokens of context on both sides within a length budget; the shorter side gives its rest to the other."""
    n = F.size("tokens")
    left, right = F.col("offset"), F.col("doc_tokens") - F.col("offset") - n
    half = F.floor((F.lit(budget) - n) / 2).cast("int")
    fits = n < budget
    short_left = left < right
    take_left = F.when(short_left, F.least(left, half))
    take_right = F.when(~short_left, F.least(right, half))
    left_out = F.coalesce(take_left, F.least(left, F.lit(budget) - take_right - n))
    right_out = F.coalesce(take_right, F.least(right, F.lit(budget) - take_left - n))
    zero = F.lit(0)
    return sents.select(
        *SENT, F.when(fits, left_out).otherwise(zero).alias("left_context"), F.when(fits, right_out).otherwise(zero).alias("right_context")
    )


def _turned(label: Column) -> list[Column]:
    """The columns of the other direction of a relation, with the given label."""
    return [F.col("s2").alias("s1"), F.col("e2").alias("e1"), F.col("s1").alias("s2"), F.col("e1").alias("e2"), label.alias("label")]


def _unordered(rows: DataFrame) -> DataFrame:
    """Adds ``_order`` (-1 if the first end is the lower, 1 if the second, 0 if equal) and the ends in order, ``_a`` to ``_d``."""
    one, two = F.struct("s1", "e1"), F.struct("s2", "e2")
    order = F.when(one < two, -1).when(two < one, 1).otherwise(0)
    ends = {f"_{n}": F.when(one <= two, F.col(x)).otherwise(F.col(y)) for n, x, y in zip("abcd", ENDS, ("s2", "e2", "s1", "e1"))}
    return rows.withColumns({"_order": order, **ends})


def _by_pair():
    """Both directions of a pair; rows that are already partitioned by sentence are not shuffled for it."""
    return Window.partitionBy(*SENT, "_a", "_b", "_c", "_d")


def _any_null() -> Column:
    return reduce(lambda x, y: x | y, [F.col(c).isNull() for c in (*SENT, *ENDS)])


def expand_relations(relations: DataFrame, symmetric: Sequence[str], directed: Sequence[str]) -> DataFrame:
    """Add the reverse of each gold relation: the same label if symmetric, else its inverse class.

    A reverse that is itself annotated keeps the annotation. ``label_id`` numbers the classes.
    """
    classes = relation_classes(symmetric, directed)
    ids = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    back = F.when(F.col("label").isin(*symmetric), F.col("label")).otherwise(F.concat("label", F.lit("^-1")))
    orders = F.collect_set("_order").over(_by_pair())
    marked = _unordered(relations.select(*SENT, *ENDS, "label")).withColumn("_annotated", F.array_contains(orders, -F.col("_order")) & ~_any_null())
    given = F.struct(*ENDS, "label", F.lit(False).alias("added"))
    added = F.struct(*_turned(back), F.lit(True).alias("added"))
    rows = marked.select(*SENT, F.inline(F.when(F.col("_annotated"), F.array(given)).otherwise(F.array(given, added))))
    return rows.withColumn("label_id", F.element_at(ids, F.col("label")))


def symmetric_gold(relations: DataFrame, symmetric: Sequence[str]) -> DataFrame:
    """Gold set for scoring: the given relations plus both directions of symmetric labels."""
    given = F.struct(*ENDS, "label")
    both = F.when(F.col("label").isin(*symmetric), F.array(given, F.struct(*_turned(F.col("label"))))).otherwise(F.array(given))
    return relations.select(*SENT, F.inline(both)).distinct()


def entity_pairs(entities: DataFrame, labelled: DataFrame) -> DataFrame:
    """Ordered subject x object pairs of a sentence, self-pairs included, with their relation class (0 without one).

    Pairs are listed from the entities and the relations of a sentence, after the only join, and are not shuffled.
    """
    lists = entities.filter(_known_sentence()).groupBy(*SENT).agg(F.collect_list(F.struct("s", "e")).alias("_ents"))
    known = labelled.groupBy(*SENT).agg(F.collect_list(F.struct(*ENDS, "label_id")).alias("_known"))
    joined = lists.join(known, SENT, "left")
    subject = joined.select(*SENT, "_ents", "_known", F.explode("_ents").alias("_x"))
    mine = F.filter("_known", lambda r: (r["s1"] == F.col("_x.s")) & (r["e1"] == F.col("_x.e")))
    subject = subject.select(*SENT, "_ents", F.col("_x.s").alias("s1"), F.col("_x.e").alias("e1"), mine.alias("_mine"))
    pairs = subject.select(*SENT, "s1", "e1", "_mine", F.explode("_ents").alias("_y"))
    pairs = pairs.select(*SENT, "s1", "e1", F.col("_y.s").alias("s2"), F.col("_y.e").alias("e2"), "_mine")
    ids = F.transform(F.filter("_mine", lambda r: (r["s2"] == F.col("s2")) & (r["e2"] == F.col("e2"))), lambda r: F.coalesce(r["label_id"], F.lit(0)))
    zero = F.array(F.lit(0))
    return pairs.select(*SENT, *ENDS, ids.alias("_ids")).select(
        *SENT, *ENDS, F.explode(F.when(F.size("_ids") > 0, F.col("_ids")).otherwise(zero)).alias("label_id")
    )


def _known_sentence() -> Column:
    """Rows without a document or sentence meet no other row."""
    return F.col("doc").isNotNull() & F.col("sent").isNotNull()


def span_budget(length: Column, ratio: float, low: int, high: int) -> Column:
    k = F.ceil(length * F.lit(ratio)).cast("int")
    return F.least(F.greatest(k, F.lit(low)), F.lit(high))


def prune_spans(scored: DataFrame, sents: DataFrame, ratio: float = 0.5, low: int = 3, high: int = 18) -> DataFrame:
    """The best k spans of each sentence, k depending on its length.

    The constant bound ``high`` lets Spark cut every sentence inside each task before the shuffle.
    """
    order = Window.partitionBy(*SENT).orderBy(F.col("score").desc(), "s", "e", "label")
    best = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= high)
    k = sents.select(*SENT, span_budget(F.size("tokens"), ratio, low, high).alias("_k"))
    return best.join(k, SENT).filter(F.col("place") <= F.col("_k")).drop("_k")


def suppress_overlaps(scored: DataFrame, same_label: bool = True) -> DataFrame:
    """Keep spans by falling score unless they overlap one already kept (of the same label, or of any)."""
    group = [*SENT, "label"] if same_label else SENT
    item = F.struct((-F.col("score")).alias("neg"), "s", "e", "label", "score")
    ordered = scored.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    kept = F.aggregate(
        "_all", F.slice("_all", 1, 0),
        lambda acc, x: F.when(
            F.exists(acc, lambda y: (y["s"] <= x["e"]) & (x["s"] <= y["e"])), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    flat = ordered.select(*SENT, F.explode(kept).alias("_k"))
    return flat.select(*SENT, "_k.s", "_k.e", "_k.label", "_k.score")


def _beats(one: str, two: str) -> Column:
    """Does the span with prefix ``one`` go before the other: higher score, then start, end and label."""
    key = lambda p: F.struct(-F.col(f"{p}score"), F.col(f"{p}s"), F.col(f"{p}e"), F.col(f"{p}label"))
    return key(one) < key(two)


def _by_window(rows: DataFrame, size: int, prefix: str = "") -> DataFrame:
    """A row for each window of ``size`` tokens that a span meets; columns other than the sentence get the prefix."""
    windows = F.sequence(F.floor(F.col("s") / size), F.floor(F.col("e") / size))
    named = [F.col(c).alias(c if c in SENT else prefix + c) for c in rows.columns]
    return rows.select(*named, F.explode(windows).alias("_window"))


def _left_greedily(same_label: bool):
    """The rest of a sentence in order, each span against the kept ones beside it only."""

    def run(group: pa.Table) -> pa.Table:
        lowest_first = [-x for x in group.column("score").to_pylist()]
        order = list(zip(lowest_first, *(group.column(c).to_pylist() for c in ("s", "e", "label"))))
        starts: dict = {}
        ends: dict = {}
        kept = []
        for k in sorted(range(len(order)), key=order.__getitem__):
            _, s, e, label = order[k]
            own = label if same_label else None
            a, b = starts.setdefault(own, []), ends.setdefault(own, [])
            at = bisect_left(a, s)  # kept spans do not overlap, so their starts and ends have one order
            if at < len(a) and a[at] <= e or at and b[at - 1] >= s:
                continue
            a.insert(at, s)
            b.insert(at, e)
            kept.append(k)
        return group.take(pa.array(sorted(kept), pa.int64()))

    return run


def suppress_in_rounds(scored: DataFrame, same_label: bool = True, window: int = 16, rounds: int = 6) -> DataFrame:
    """The rows of ``suppress_overlaps``, by parallel rounds over overlaps instead of one array per sentence.

    In each round the spans that beat all live spans they overlap stay, and what they overlap goes. Overlaps are an equi-join
    on the windows of tokens that spans meet, so a line of any length is spread over the tasks. Where falling scores form a
    chain, a round settles two spans of it; what is left after ``rounds`` rounds is settled per sentence by a sweep in order of
    score that looks at the two neighbours of a span only.
    """
    group = [*SENT, "label"] if same_label else SENT
    columns = [*SENT, "s", "e", "label", "score"]
    live = durable(scored.select(*columns).dropDuplicates().withColumn("_id", F.monotonically_increasing_id()), "spans")
    kept: list[DataFrame] = []
    for _ in range(rounds):
        mine, theirs = _by_window(live, window, "a_"), _by_window(live, window, "b_")
        on = [*SENT, "_window"]
        meets = (F.col("a_s") <= F.col("b_e")) & (F.col("b_s") <= F.col("a_e")) & (F.col("a__id") != F.col("b__id"))
        if same_label:
            meets = meets & (F.col("a_label") == F.col("b_label"))
        other = theirs.select(*[F.col(c).alias(f"o_{c}") for c in on], *[c for c in theirs.columns if c not in on])
        same_place = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"o_{c}") for c in on])
        beaten = mine.join(other, same_place & meets & _beats("b_", "a_"), "left_semi").select(F.col("a__id").alias("_id")).distinct()
        best = durable(live.join(beaten, "_id", "left_anti"), "best-spans")
        kept.append(best)
        won = _by_window(best, window, "b_")
        won = won.select(*[F.col(c).alias(f"o_{c}") for c in on], *[c for c in won.columns if c not in on])
        gone = mine.join(won, same_place & meets, "left_semi").select(F.col("a__id").alias("_id")).distinct()
        following = durable(live.join(best.select("_id"), "_id", "left_anti").join(gone, "_id", "left_anti"), "spans")
        discard(live)
        live = following
        if live.isEmpty():
            break
    rest = live.select(*columns).groupBy(*group).applyInArrow(_left_greedily(same_label), live.select(*columns).schema)
    return reduce(DataFrame.unionByName, [b.select(*columns) for b in kept], rest)


def _prf(cor: Column, predicted: Column, gold: Column, prefix: str) -> list[Column]:
    p = F.when(predicted > 0, cor / predicted).otherwise(F.lit(0.0))
    r = F.when(gold > 0, cor / gold).otherwise(F.lit(0.0))
    f1 = F.when(cor > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [p.alias(f"{prefix}precision"), r.alias(f"{prefix}recall"), f1.alias(f"{prefix}f1")]


def _hits(predicted: DataFrame, gold: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(predicted rows, predicted rows that are gold); two numbers for the driver."""
    marked = predicted.join(gold.select(*keys).distinct().withColumn("_gold", F.lit(True)), list(keys), "left")
    row = marked.agg(F.count(F.lit(1)).alias("n"), F.count("_gold").alias("cor")).first()
    return row["n"], row["cor"]


def entity_scores(scored: DataFrame, gold: DataFrame, same_label: bool = True) -> DataFrame:
    """Micro precision, recall and F1 with overlap suppression and, as all_*, without."""
    keys = [*SENT, "s", "e", "label"]
    scored, gold = durable(scored.select(*keys, "score"), "scored"), durable(gold.select(*keys), "gold")  # each is read several times
    total = gold.count()
    cols = []
    for prefix, predicted in (("", suppress_overlaps(scored, same_label)), ("all_", scored)):
        n, cor = _hits(predicted, gold, keys)
        cols += _prf(F.lit(cor), F.lit(n), F.lit(total), prefix)
    discard(scored, gold)
    return scored.sparkSession.range(1).select(*cols)


def decode_relations(scores: DataFrame, symmetric: Sequence[str], directed: Sequence[str]) -> DataFrame:
    """(doc, sent, s1, e1, s2, e2, label, score): the best class of each unordered pair.

    The class scores of both directions are added, the reverse ones with directed and inverse classes swapped; the
    first maximum counts, class 0 means no relation, and an inverse class turns the pair round. The directions of a pair
    are brought together by a window: scores that are already partitioned by sentence are sorted, but not shuffled. Rows
    with a column ``back`` have the scores of the other direction in it, and their first end is the lower.
    """
    n_sym, n_dir = len(symmetric), len(directed)
    labels = F.array(*[F.lit(x) for x in (*symmetric, *directed)])
    swapped = [*range(n_sym), *range(n_sym + n_dir, n_sym + 2 * n_dir), *range(n_sym, n_sym + n_dir)]
    if "back" in scores.columns:
        forward = scores.filter(~_any_null()).select(*SENT, *ENDS, F.col("logp").alias("_f"), F.col("back").alias("_b"))
    else:
        placed = _unordered(scores.select(*SENT, *ENDS, "logp").filter(~_any_null())).filter("_order != 0")
        placed = placed.select(*SENT, "_a", "_b", "_c", "_d", "_order", "logp")
        met = placed.withColumn("_back", F.collect_list(F.when(F.col("_order") > 0, F.col("logp"))).over(_by_pair())).filter("_order < 0")
        forward = met.select(*SENT, *[F.col(f"_{n}").alias(c) for n, c in zip("abcd", ENDS)], F.col("logp").alias("_f"), F.explode("_back").alias("_b"))
    total = F.array(*[F.get("_f", F.lit(k)) + F.get("_b", F.lit(back)) for k, back in enumerate(swapped)])
    # Sums and classes are exploded: what reads them does not work them out again, and generated methods stay small.
    best = forward.select(*SENT, *ENDS, F.explode(F.array(total)).alias("_sum"))
    first = F.array_position("_sum", F.array_max("_sum")).cast("int") - 1
    best = best.select(*SENT, *ENDS, F.inline(F.array(F.struct(F.array_max("_sum").alias("score"), first.alias("_class"))))).filter("_class > 0")
    turned = F.col("_class") >= n_sym + n_dir
    label_no = F.when(turned, F.col("_class") - n_dir).otherwise(F.col("_class"))
    swap = {"s1": "s2", "e1": "e2", "s2": "s1", "e2": "e1"}
    return best.select(
        *SENT, *[F.when(turned, F.col(swap[c])).otherwise(F.col(c)).alias(c) for c in ENDS],
        F.element_at(labels, label_no + 1).alias("label"), "score",
    )


def _packed_ends(s: Column, e: Column) -> Column:
    """Both token numbers, which are ints, in one number."""
    return s.cast("long") * (1 << 32) + e.cast("long")


def _with_end_labels(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``_types1`` and ``_types2``: the labels of the entities at each end, [NIL] where there is none.

    Relations meet a map of the entities of their sentence, so those that are partitioned by sentence are neither shuffled
    nor sorted.
    """
    named = F.struct(_packed_ends(F.col("s"), F.col("e")).alias("at"), F.coalesce("label", F.lit("NIL")).alias("label"))
    lists = entities.filter("s IS NOT NULL AND e IS NOT NULL").groupBy(*SENT).agg(F.collect_list(named).alias("_ents"))
    lists = lists.withColumn("_at", F.array_distinct(F.col("_ents.at")))
    own = F.transform("_at", lambda a: F.transform(F.filter("_ents", lambda x: x["at"] == a), lambda x: x["label"]))
    single = F.transform("_ents", lambda x: F.array(x["label"]))
    names = F.map_from_arrays("_at", F.when(F.size("_at") < F.size("_ents"), own).otherwise(single))
    out = relations.join(lists.select(*SENT, names.alias("_names")).hint("shuffle_hash"), SENT, "left")
    nil = F.array(F.lit("NIL"))
    labels = [F.coalesce(F.try_element_at("_names", _packed_ends(F.col(f"s{i}"), F.col(f"e{i}"))), nil).alias(f"_types{i}") for i in "12"]
    return out.select(*relations.columns, *labels)


def with_end_types(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity labels of both ends, NIL where the end is not an entity; a row for each if several entities have the same ends."""
    out = _with_end_labels(relations, entities)
    for i in "12":
        out = out.withColumn(f"type{i}", F.explode(f"_types{i}"))
    return out.drop("_types1", "_types2")


def relation_scores(
    predicted: DataFrame, gold: DataFrame, predicted_entities: DataFrame, gold_entities: DataFrame, symmetric: Sequence[str]
) -> DataFrame:
    """P/R/F1 of relations, strict and (typed_*) with both entity types, counted in one pass over the predictions.

    Precision divides by the decoded pairs, recall by the gold rows before symmetric relations are doubled. A prediction
    counts once for each pair of types of its ends; pairs of types are listed for those predictions only that are gold.
    """
    gold = durable(gold, "gold-relations")  # counted, and read for the sets below
    strict, typed = F.struct(*ENDS, "label"), F.struct(*ENDS, "label", "type1", "type2")
    known = with_end_types(symmetric_gold(gold.repartition(*SENT), symmetric), gold_entities).groupBy(*SENT).agg(
        F.collect_set(strict).alias("_strict"), F.collect_set(typed).alias("_typed")
    )
    total = gold.count()
    marked = _with_end_labels(predicted.select(*SENT, *ENDS, "label"), predicted_entities).join(known.hint("shuffle_hash"), SENT, "left")
    types = F.flatten(F.transform("_types1", lambda t: F.transform("_types2", lambda u: F.struct(*ENDS, "label", t.alias("type1"), u.alias("type2")))))
    times, right = F.size("_types1") * F.size("_types2"), F.array_contains("_strict", strict)
    typed_times = F.size(F.filter(types, lambda x: F.array_contains(F.col("_typed"), x)))
    counted = [F.sum(times), F.sum(F.when(right, times)), F.sum(F.when(right, typed_times))]
    row = marked.agg(*[F.coalesce(c, F.lit(0)).alias(name) for c, name in zip(counted, ("n", "cor", "typed"))]).first()
    discard(gold)
    cols = [c for prefix, cor in (("", row["cor"]), ("typed_", row["typed"])) for c in _prf(F.lit(cor), F.lit(row["n"]), F.lit(total), prefix)]
    return predicted.sparkSession.range(1).select(*cols)


def fold_predictions(sents: DataFrame, predicted: DataFrame, fields: Sequence[str] = ("s", "e", "label")) -> DataFrame:
    """Sorted prediction list per sentence, empty without predictions."""
    lists = predicted.groupBy(*SENT).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("predicted"))
    joined = sents.select(*SENT).join(lists, SENT, "left")
    return joined.withColumn("predicted", F.coalesce("predicted", F.array().cast(lists.schema["predicted"].dataType)))


def fold_documents(folded: DataFrame) -> DataFrame:
    """One row per document: its sentence lists in sentence order."""
    rows = folded.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("sent", "predicted"))).alias("_s"))
    return rows.select("doc", F.transform("_s", lambda x: x["predicted"]).alias("predicted"))
