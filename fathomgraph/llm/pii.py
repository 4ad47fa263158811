"""Operator 7: personal data by candidates and boosted trees. DataFrame functions only.

Four base kinds (email, ip, card, phone) have fixed forms and checks. Beyond them, generators of high recall propose spans
that may overlap each other: numbers with separators, account-like strings, spelled-out addresses, long digit runs. Each
candidate gets features of its format and of the text around it; boosted trees score it; a threshold per kind, set
on held-out labelled rows for a wanted precision, decides. A chosen span that overlaps a base span, or a chosen one of
higher score (then: earlier, longer), is left out.

The trees are fitted by Spark's GBTClassifier on labelled sentences, ``COPIES`` for each of ``TEMPLATES`` with other digits
and letters: this bounded sample is the only training data. The fitted trees become one column expression, which is
evaluated inside each row; no candidate is shuffled.

All offsets are code points, end exclusive. Patterns hold no group that is repeated with backtracking, so a text of any
length needs neither quadratic time nor deep recursion; running offsets are summed in blocks.

Cases: a null or empty text has no spans; a null id is kept; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .common import public_columns

BASE_KINDS = ("email", "ip", "card", "phone")
#: Generators: kind and pattern. Possessive, so each is linear.
GENERATORS = {
    "address_words": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]++(?:(?: ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}+\)?[ ./-][0-9]{3,4}+(?:[ ./-][0-9]{2,4}+){1,2}+(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}+[0-9]{2}+(?: ?[A-Z0-9]{4}+){2,7}+(?: ?[A-Z0-9]{1,3}+)?+(?![0-9A-Za-z])",
    "id_number": r"(?<![0-9A-Za-z.-])[0-9]{3}+-[0-9]{2}+-[0-9]{4}+(?![0-9A-Za-z-])",
    "digits": r"(?<![0-9A-Za-z.,+-])[0-9](?:[ -]?[0-9]){8,18}+(?![0-9A-Za-z])",
}
KINDS = (*BASE_KINDS, *GENERATORS)
CONTEXT = 24
COPIES = 24
TREES = 12
DEPTH = 3
PRECISION = 0.97

#: Labelled sentences: # is a digit, @ a small letter, ^ a capital; what stands in {} is personal.
TEMPLATES = [
    "call me at {(###) ###-####} before noon", "my phone number is {###-###-####}, thanks", "tel. {### ### ####} or come by",
    "Tel: {0## ### ## ##} abends", "mobile {0###-###-####} any time", "telephone {### ####-####} for the office",
    "fax {(0##) ####-####} only", "ring {###.###.####} after six", "téléphone {0#.##.##.##.##} le soir", "appelez le {## ### ## ##} demain",
    "Telefon {0### ### ####}, bitte", "teléfono {### ### ###} por favor", "contact {(###) ### ####}.",
    "SSN {###-##-####} on file", "social security number: {###-##-####}", "his ssn is {###-##-####} and", "tax id {###-##-####} given",
    "IBAN {^^## #### #### #### #### ##}", "pay to {^^################} today", "account {^^## ^^^^ #### #### ##} please", "Konto {^^## #### #### #### ####}",
    "write to {@@@@@ at @@@@@@ dot com} now", "mail {@@@@.@@@@@ (at) @@@@@ (dot) org}", "reach me: {@@@@@@ [at] @@@@ [dot] net}", "e-mail {@@@## at @@@@@ dot de} bitte",
    "card number {#### #### #### ###} expires", "card {#### ###### #####} on record", "passport no. {#########} issued", "customer id card {###########}",
    "account number {##########} at the bank", "my account is {###-###-####}", "bank account {### ### ####} please",
    "born {##-##-####} id {###-##-####}",
    "between 19##-20## we grew", "version ##.#.### was out", "pages ###-### of the book", "it cost ### ### ### in total", "ISBN ###-#-####-####-# is out of print",
    "pi is 3.########## or so", "## ### people came", "the years #### #### and ####", "room ### on floor ##", "a score of ###-## at half time", "width ### ### height ### ###",
    "order ############ was sent", "row ########## of the table", "population ### ### ### in ####", "part number ^^## #### ####", "model ^^## #### is sold out",
    "serial ^^############ printed below", "flight ^^#### at ##:##", "code ^^##^^##^^## of the building", "look at @@@@ dot and line", "meet at @@@@ dot point here",
    "she was at @@@@@ dot to dot games", "commit ############ merged", "build ###-##-#### failed", "section ###-##-#### of the code", "lines ### ### ### ###", "values ### ### #### and ## ### ####",
    "ticket ###-###-#### closed", "invoice ### ### ### due", "elapsed ############### ns", "timestamp ########## read", "total ### ### #### units", "in the years 1###-2###", "ratio ### / ### / ###",
    "grid ## ### ### cells", "file of ########## bytes", "offset ########### in the file", "bus ### ### ### lines", "the matrix ### ### ### ###",
]
_PERSONAL = r"(?i)phone|tel\b|tel[.:]|telef|téléph|teléf|mobile|call|ring|fax|contact|appelez|reach|mail|ssn|social|tax|passport|iban|konto|account|bank|card|pay to|write"
_PLAIN = r"(?i)version|page|isbn|order|row|year|room|floor|score|width|height|population|part|model|serial|flight|code|commit|build|section|line|value|ticket|invoice|elapsed|time|total|ratio|grid|file|offset|bus|matrix|cost|look|meet|was|people|units"


# ---- spans with places


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, match).

    The gaps between matches and the matches give the places; sums run over blocks of 64 steps.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).cast("long").alias("gap"), (F.length(g) + F.length(m)).cast("long").alias("step"), m.alias("match")))
    # a one-element array binds the columns, so that they are computed once
    return F.flatten(F.transform(F.array(steps), _placed))


def _placed(steps: Column) -> Column:
    """Places from steps. Elements are read one by one, as a slice reads its whole array."""
    within = F.sequence(F.lit(0), F.lit(63))

    def with_blocks(blocks: Column) -> Column:
        def place(s: Column, i: Column) -> Column:
            block, rest = F.floor(i / 64).cast("int"), (i % 64).cast("int")
            earlier = F.aggregate(F.sequence(F.lit(0), block), F.lit(0).cast("long"), lambda a, k: a + F.when(k < block, F.get(blocks, k)).otherwise(0))
            inside = F.aggregate(F.sequence(F.lit(0), rest), F.lit(0).cast("long"), lambda a, k: a + F.when(k < rest, F.get(steps, block * 64 + k)["step"]).otherwise(0))
            start = earlier + inside + s["gap"]
            return F.struct(start.alias("start"), (start + F.length(s["match"])).alias("end"), s["match"].alias("match"))

        return F.transform(steps, place)

    numbers = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 64).cast("int"))
    blocks = F.transform(numbers, lambda b: _sum(F.transform(within, lambda k: F.coalesce(F.get(steps, b * 64 + k)["step"], F.lit(0).cast("long")))))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, match: string>>)")
    return F.when(F.size(steps) > 0, F.flatten(F.transform(F.array(blocks), with_blocks))).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does the check digit agree?"""

    def value(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, 1).cast("int")
        double = digit * 2
        return F.when(i % 2 == 0, digit).otherwise(double - F.when(double > 9, 9).otherwise(0))

    return _sum(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value)) % 10 == 0


def base_spans(text: Column) -> Column:
    """Checked spans of the base kinds: array of (kind, start, end, match), by kind as listed, then start."""
    local = "[A-Za-z0-9._%+-]"
    email = rf"(?:\G|(?<!{local})){local}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    ip = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
    card = r"[0-9](?:[\x20-]?[0-9])++"
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"
    # no leading zeros, then 0 to 255
    small = lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    fits_ip = lambda s: F.forall(F.split(s["match"], r"\."), small)
    n_digits = lambda s: F.length(_digits(s["match"]))
    fits_card = lambda s: F.when(n_digits(s).between(16, 19), luhn(_digits(s["match"]))).otherwise(False)
    has = lambda mark, found: F.when(F.instr(text, mark) > 0, found)
    number = text.rlike("[0-9]")
    spans = [
        _of("email", has("@", matches(text, email))),
        _of("ip", F.when(number & text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, ip), fits_ip))),
        _of("card", F.when(number & text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), F.filter(matches(text, card), fits_card))),
        _of("phone", has("+", F.filter(matches(text, phone), lambda s: n_digits(s).between(8, 15)))),
    ]
    return F.concat(*spans)


def _of(kind: str, found: Column) -> Column:
    kind_of = lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"))
    return F.coalesce(F.transform(found, kind_of), F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint, match: string>>)"))


# ---- candidates and their features

FEATURES = [
    "kind_no", "length", "n_digits", "n_letters", "n_groups", "first_group", "last_group", "longest_group", "parenthesis", "dots", "hyphens", "blanks",
    "luhn", "distinct", "leading_zero", "personal_before", "plain_before", "colon_before", "before_digit", "after_digit", "personal_after",
]


def _features(text: Column, span: Column, kind: str) -> list[Column]:
    m = span["match"]
    before = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(span["start"], F.lit(CONTEXT)).cast("int"))
    after = F.substring(text, (span["end"] + 1).cast("int"), F.lit(CONTEXT))
    digits = _digits(m)
    groups = F.transform(F.filter(F.split(m, "[^0-9A-Za-z]+"), lambda g: g != ""), F.length)
    count = lambda mark: F.length(m) - F.length(F.replace(m, F.lit(mark), F.lit("")))
    yes = lambda c: c.cast("int")
    values = [
        F.lit(KINDS.index(kind)), F.length(m), F.length(digits), F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.size(groups),
        F.coalesce(F.try_element_at(groups, F.lit(1)), F.lit(0)), F.coalesce(F.try_element_at(groups, F.lit(-1)), F.lit(0)), F.coalesce(F.array_max(groups), F.lit(0)),
        yes(m.contains("(")), count("."), count("-"), count(" "),
        yes(F.when(F.length(digits) > 0, luhn(digits)).otherwise(False)), F.size(F.array_distinct(F.split(digits, ""))), yes(digits.startswith("0")),
        yes(before.rlike(_PERSONAL)), yes(before.rlike(_PLAIN)), yes(before.rlike(r"[:.] ?$")), yes(before.rlike(r"[0-9] ?$")), yes(after.rlike(r"^ ?[0-9]")), yes(after.rlike(_PERSONAL)),
    ]
    return [v.cast("double") for v in values]


def candidates(text: Column) -> Column:
    """Proposed spans with features: array of (kind, start, end, match, features), which may overlap."""
    likely = {"address_words": text.rlike(r"(?i)\bdot\b|[\[(]dot[\])]"), "account": text.rlike(r"[A-Z]{2}[0-9]{2}")}
    out = []
    for kind, pattern in GENERATORS.items():
        found = F.when(likely.get(kind, text.rlike(r"[0-9](?:[ ()./-]{0,2}[0-9]){6}")), matches(text, pattern))
        none = F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint, match: string, features: array<double>>>)")
        out.append(F.coalesce(F.transform(found, _candidate(text, kind)), none))
    return F.concat(*out)


def _candidate(text: Column, kind: str):
    return lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), F.array(*_features(text, s, kind)).alias("features")
    )


# ---- training


def training_sentences(spark: SparkSession, copies: int = COPIES) -> DataFrame:
    """(sentence, low, high, copy): labelled rows made from the templates; low and high bound what is personal."""
    rows = spark.createDataFrame([(t,) for t in TEMPLATES], "template string").select("template", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    letter = lambda first, i, n: F.char(F.lit(ord(first)) + F.pmod(F.xxhash64("template", "copy", i), F.lit(n)))

    def fill(c: Column, i: Column) -> Column:
        return F.when(c == "#", letter("0", i, 10)).when(c == "@", letter("a", i, 26)).when(c == "^", letter("A", i, 26)).otherwise(c)

    rows = rows.withColumn("filled", F.array_join(F.transform(F.split("template", ""), fill), ""))
    low, high = F.instr("filled", "{") - 1, F.instr("filled", "}") - 2
    return rows.select(F.regexp_replace("filled", "[{}]", "").alias("sentence"), low.alias("low"), high.alias("high"), "copy")


class Trees:
    """Boosted trees as nested (feature, threshold, left, right) or leaf values, with weights and thresholds."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def margin(self, features: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(F.get(features, F.lit(feature)) <= threshold, walk(left)).otherwise(walk(right))

        return reduce(lambda a, b: a + b, [walk(t) * F.lit(w) for t, w in zip(self.trees, self.weights)])


def _nodes(node):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _nodes(node.leftChild()), _nodes(node.rightChild()))


def train(spark: SparkSession, copies: int = COPIES, precision: float = PRECISION) -> Trees:
    """Fit on three quarters of the copies; set thresholds on the rest, the lowest score from which precision is as wanted."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = training_sentences(spark, copies)
    rows = rows.select("copy", "low", "high", F.explode(candidates(F.col("sentence"))).alias("c"))
    overlap = F.least("c.end", "high") - F.greatest("c.start", "low")
    label = (F.col("low") >= 0) & (overlap * 2 > F.col("c.end") - F.col("c.start"))
    rows = durable(rows.select("copy", F.col("c.kind").alias("kind"), "c.features", F.coalesce(label, F.lit(False)).cast("double").alias("label")), "pii-training")
    held = F.col("copy") % 4 == 0
    fitted = GBTClassifier(featuresCol="vector", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(
        rows.filter(~held).select(array_to_vector("features").alias("vector"), "label")
    )
    java = fitted._java_obj
    trees = Trees([_nodes(t.rootNode()) for t in java.trees()], [float(w) for w in java.treeWeights()], {})
    scored = rows.filter(held).select("kind", "label", trees.margin(F.col("features")).alias("margin")).collect()  # len(TEMPLATES) * copies / 4 sentences
    for kind in GENERATORS:
        own = sorted(((r["margin"], r["label"]) for r in scored if r["kind"] == kind), reverse=True)
        best, right = float("inf"), 0
        for k, (margin, personal) in enumerate(own, 1):
            right += personal
            if right >= precision * k and (k == len(own) or own[k][0] < margin):
                best = margin
        trees.thresholds[kind] = best
    return trees


# ---- the operator


def find_personal(docs: DataFrame, trees: Trees | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, added): spans (kind, start, end, match) of each document; ``added`` have a score too."""
    trees = trees or train(docs.sparkSession)
    rows = public_columns(docs, doc_id=doc_id, text=text)
    t = F.coalesce("text", F.lit(""))
    bound = F.create_map(*[x for k, v in trees.thresholds.items() for x in (F.lit(k), F.lit(min(v, 1e9)))])

    def scored(c: Column) -> Column:
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"), trees.margin(c["features"]).alias("score"))

    rows = rows.select("doc_id", base_spans(t).alias("base"), F.filter(F.transform(candidates(t), scored), lambda c: c["score"] >= F.try_element_at(bound, c["kind"])).alias("likely"))
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    rank = lambda c: F.struct(c["score"], -c["start"], c["end"], c["kind"])
    free = F.filter("likely", lambda c: ~F.exists("base", lambda b: meets(b, c)))
    rows = rows.select("doc_id", "base", free.alias("likely"))
    added = F.filter("likely", lambda c: ~F.exists("likely", lambda d: meets(c, d) & (rank(d) > rank(c))))
    return rows.select("doc_id", "base", F.array_sort(F.transform(added, lambda c: F.struct(_kind_no(c["kind"]).alias("no"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["match"].alias("match"), c["score"].alias("score")))).alias("added"))


def _kind_no(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span's match replaced by its kind in brackets."""
    return F.aggregate(spans, text, lambda t, s: F.replace(t, s["match"], F.concat(F.lit("["), s["kind"], F.lit("]"))))
