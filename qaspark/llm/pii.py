"""Personal data: high-recall candidates judged by gradient-boosted trees.

Everything is DataFrame expressions. Strict patterns give the base spans. Beside them,
generators propose loose spans (anything around an at sign, any run that is mostly
digits); boosted trees over format and context features judge each candidate as each
kind it could be, and a threshold per kind, calibrated on held-out rows, selects those
that are redacted too. The trees are trained on the whole corpus: its base spans, as they
stand and re-written in the ways people write them, against candidates that are no base
span. Equal rows of features are one weighted row, so what is fitted grows with the
different ones only. The trees are then compiled into one SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, prepared, stored

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that no start inside a run is tried twice.
_RUN = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_RUN})|\G){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What each generator proposes, and the kinds its candidates may be.
GENERATORS = {
    "at": (r"[A-Za-z0-9][^\s@]{0,63}+(?:@|\s?[\[(]at[\])]\s?)[^\s@]{1,255}+", ("email",)),
    "digits": (r"[+(]?[0-9][0-9()./_\x20-]{5,40}[0-9]", ("ip", "card", "phone")),
}
CONTEXT = {"email": "mail|contact|write to|reach", "ip": r"\bip\b|host|server|addr|login",
           "card": "card|visa|credit|debit|payment|account", "phone": "phone|tel|call|fax|mobile|cell|whatsapp"}
CONTEXT_CHARS = 40
#: How base spans are re-written for training: kind, pattern, replacement.
REWRITES = (("email", "@", " [at] "), ("email", "@", "(at)"), ("ip", r"\.", " . "), ("card", "[ -]", "."),
            ("card", "([0-9]{4})(?=[0-9])", "$1."), ("card", "([0-9]{4})(?=[0-9])", "$1_"),
            ("phone", r"^\+[0-9] ?", ""), ("phone", "[ ()-]+", "."), ("phone", r"^\+", "00"))

TREES, DEPTH = 10, 3
LEAF = 5                       # candidates of a leaf at least
PRECISION = 0.97               # wanted of a kind on held-out candidates
BLOCK = 512


def prefix_sums(values: Column) -> Column:
    """Sums of all earlier elements, for each element; in blocks, so the work stays
    close to linear in a long array."""
    def running(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest((F.size(values) - 1) / BLOCK, F.lit(0)).cast("int")),
                         lambda b: running(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    return F.element_at(F.transform(F.array(blocks), lambda sums: F.flatten(F.zip_with(
        sums, F.slice(running(F.transform(sums, lambda s: F.element_at(s, -1))), F.lit(1), F.size(sums)),
        lambda s, o: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda v: v + o)))), 1)


def spans_of(text: Column, pattern: str) -> Column:
    """All matches of a pattern: ``array<struct<start, end, value>>`` in code points. The
    gaps between matches and the matches themselves come from the same left-to-right scan."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def located(p: Column) -> Column:
        lengths = F.zip_with(p.gaps, p.found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        before = prefix_sums(F.slice(lengths, F.lit(1), F.size(p.found)))
        starts = F.zip_with(before, F.slice(p.gaps, F.lit(1), F.size(p.found)), lambda b, g: b + F.length(g))
        return F.zip_with(starts, p.found, lambda s, m: F.struct(
            s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))
    one = F.array(F.struct(gaps.alias("gaps"), found.alias("found")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.element_at(F.transform(one, lambda p: F.when(F.size(p.found) == 0, none).otherwise(located(p))), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    backwards = F.split(F.reverse(_digits(value)), "")

    def weigh(d: Column, i: Column) -> Column:
        n = F.coalesce(d.try_cast("int"), F.lit(0))
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, twice).otherwise(n)
    return F.aggregate(F.transform(backwards, weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def octets(value: Column) -> Column:
    """Whether all parts between dots are at most 255."""
    return F.forall(F.split(value, r"\."), lambda p: F.when(
        F.length(F.regexp_replace(p, "^0+", "")) <= 3,
        F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255).otherwise(False))


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {"email": lambda: F.lit(True), "ip": lambda: octets(value), "card": lambda: luhn(value),
            "phone": lambda: n.between(10, 15)}[kind]()


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that spares most texts the patterns."""
    return F.contains(text, F.lit({"email": "@", "phone": "+", "ip": "."}.get(kind, ""))) & (
        F.lit(True) if kind == "email" else text.rlike("[0-9]"))


def base_spans(text: Column) -> Column:
    """Base spans of a text, sorted by start and kind: ``array<struct<start, ord, end>>``
    with ``ord`` the place of the kind in ``KINDS``."""
    none = F.array().cast("array<struct<start:int,ord:int,end:int>>")

    def one_kind(i: int, k: str) -> Column:
        good = F.filter(spans_of(text, BASE[k]), lambda s: _valid(k, s.value))
        spans = F.transform(good, lambda s: F.struct(s.start.alias("start"), F.lit(i).alias("ord"), s.end.alias("end")))
        return F.when(_may_hold(k, text), spans).otherwise(none)
    return F.array_sort(F.concat(*(one_kind(i, k) for i, k in enumerate(KINDS))))


# ---------------------------------------------------------------- candidates and their features

FEATURES = ("digits", "letters", "dots", "marks", "size", "at", "written_at", "tld", "plus", "luhn", "four_parts",
            "octets", "groups", "before", "after", *(f"near_{k}" for k in KINDS), *(f"is_{k}" for k in KINDS))


def features(value: Column, left: Column, right: Column, kind: Column) -> Column:
    """Format and context features (doubles) of a span seen as a kind: ``left`` and
    ``right`` are the characters beside it."""
    num = {
        "digits": F.length(_digits(value)), "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        "dots": F.length(F.regexp_replace(value, r"[^.]", "")), "marks": F.length(F.regexp_replace(value, r"[^ ()/_-]", "")),
        "size": F.length(value), "at": value.contains("@"), "written_at": value.rlike(r"[\[(]at[\])]"),
        "tld": value.rlike(r"[A-Za-z0-9-]\.[A-Za-z]{2,}\W*$"), "plus": value.startswith("+"), "luhn": luhn(value),
        "four_parts": value.rlike(r"^[0-9]+ ?\. ?[0-9]+ ?\. ?[0-9]+ ?\. ?[0-9]+$"),
        "octets": octets(F.regexp_replace(value, " ", "")),
        "groups": F.size(F.split(value, "[^0-9]+")), "before": left.rlike(r"[\w]$"), "after": right.rlike(r"^[\w]"),
        **{f"near_{k}": F.lower(left).rlike(CONTEXT[k]) for k in KINDS},
        **{f"is_{k}": kind == i for i, k in enumerate(KINDS)},
    }
    return F.struct(*(num[f].cast("int").cast("double").alias(f) for f in FEATURES))


def candidates(text: Column) -> Column:
    """Loose spans as every kind they may be: ``array<struct<start, ord, end, value, left, right>>``."""
    out = []
    for name, (pattern, kinds) in GENERATORS.items():
        ords = F.array(*(F.lit(KINDS.index(k)) for k in kinds))
        maybe = text.rlike(r"@|[\[(]at[\])]") if name == "at" else text.rlike(r"[0-9][0-9()./_\x20-]{5}")
        seen = F.flatten(F.transform(spans_of(text, pattern), lambda s: F.transform(ords, lambda o: F.struct(
            s.start.alias("start"), o.alias("ord"), s.end.alias("end"), s.value.alias("value"),
            F.substring(text, F.greatest(s.start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s.start, F.lit(CONTEXT_CHARS))).alias("left"),
            F.substring(text, s.end + 1, F.lit(2)).alias("right")))))
        out.append(F.when(maybe, seen).otherwise(F.array().cast(
            "array<struct<start:int,ord:int,end:int,value:string,left:string,right:string>>")))
    return F.concat(*out)


def _overlaps(base: Column, s: Column) -> Column:
    return F.exists(base, lambda b: (b.start < s.end) & (s.start < b.end))


# ---------------------------------------------------------------- the trees

@dataclass
class SpanJudge:
    """Compiled trees: SQL text of the margin over the fields of a feature struct named
    ``f``, and the margin from which each kind is accepted (None: never)."""
    margin_sql: str
    thresholds: tuple[float | None, ...]

    def accepts(self, f: Column, kind: Column) -> Column:
        margin = F.element_at(F.transform(F.array(f), lambda x: _margin(self.margin_sql, x)), 1)
        need = F.lit(None).cast("double")
        for i, t in enumerate(self.thresholds):
            need = F.when(kind == i, F.lit(t).cast("double")).otherwise(need)
        return F.coalesce(margin >= need, F.lit(False))


def _margin(sql: str, x: Column) -> Column:
    """The margin expression over a struct column: its trees are nested ifs in a text of
    the form ``if(f3 <= 0.5, a, b)``."""
    import json
    out = F.lit(0.0)
    for weight, tree in json.loads(sql):
        out = out + F.lit(weight) * _branch(tree, x)
    return out


def _branch(node, x: Column) -> Column:
    if not isinstance(node, list):
        return F.lit(float(node))
    name, cut, low, high = node
    return F.when(x.getField(name) <= cut, _branch(low, x)).otherwise(_branch(high, x))


def _tree(node) -> list | float:
    """A fitted node as ``[feature, cut, low, high]`` or a leaf value."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return [FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())]


def train_judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SpanJudge:
    """Fit the trees on the candidates of all documents. Every fourth document calibrates:
    the lowest margin at which a kind's precision reaches ``PRECISION``. Without both labels
    nothing is ever added."""
    import json
    texts = prepared(docs, id_col, text_col).filter(F.col("text").rlike("@|[0-9]"))
    seen = (texts.select("doc_id", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("c"))
            .select("doc_id", "base", F.explode("c").alias("c")))
    exact = F.exists("base", lambda b: (b.start <= F.col("c.end")) & (F.col("c.start") <= b.end) & (b.ord == F.col("c.ord")))
    rows = seen.select("doc_id", exact.alias("y"), "c.ord", "c.value", "c.left", "c.right")
    spoken = F.array(*(F.struct(F.lit(KINDS.index(k)).alias("o"), F.regexp_replace("value", p, r).alias("v")) for k, p, r in REWRITES))
    other = F.transform(F.filter(spoken, lambda w: (w.o == F.col("ord")) & (w.v != F.col("value"))), lambda w: w.v)
    forms = F.concat(F.array("value"), F.when(F.col("y"), other).otherwise(F.array().cast("array<string>")))
    said = rows.withColumn("value", F.explode(forms))
    held = F.col("held")
    data = stored(said.select((F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("held"), "ord", F.col("y").cast("double").alias("label"),
                          features(F.col("value"), F.col("left"), F.col("right"), F.col("ord")).alias("f"))
                  .select("held", "ord", "label", "f.*").groupBy("held", "ord", "label", *FEATURES)
                  .agg(F.count(F.lit(1)).cast("double").alias("n")), "pii-candidates")
    try:
        seen_labels = {(r["held"], r["label"]): r["n"] for r in data.groupBy("held", "label").agg(F.sum("n").alias("n")).collect()}
        if len({label for _, label in seen_labels}) < 2:
            return SpanJudge("[]", (None,) * len(KINDS))
        points = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data)
        fitted = len([h for h, _ in seen_labels if not h]) == 2
        total = sum(n for (h, _), n in seen_labels.items() if not (fitted and h))
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=16, seed=3, stepSize=0.3, weightCol="n",
                              minWeightFractionPerNode=min(0.49, LEAF / total)).fit(
            points.filter(~held) if fitted else points)
        java = model._java_obj
        trees = [(float(w), _tree(t.rootNode())) for w, t in zip(java.treeWeights(), java.trees())]
        sql = json.dumps(trees)
        f = F.struct(*(F.col(c) for c in FEATURES))
        judged = data.filter(held).select("ord", "label", "n", F.round(_margin(sql, f), 3).alias("m"))
        curve = judged.groupBy("ord", "m").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    finally:
        dropped(data)
    thresholds: list[float | None] = []
    for i in range(len(KINDS)):
        good = n = 0.0
        best = None
        for r in sorted((r for r in curve if r["ord"] == i), key=lambda r: -r["m"]):
            good, n = good + r["good"], n + r["n"]
            if good / n >= PRECISION and r["m"] > 0:
                best = float(r["m"]) - 0.0005
        thresholds.append(best)
    return SpanJudge(sql, tuple(thresholds))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", judge: SpanJudge | None = None) -> DataFrame:
    """One row per input row: ``doc_id, text, base, added`` with both span lists sorted,
    ``array<struct<start, ord, end>>`` in code points, end exclusive.

    Base spans always stay; a candidate is added if the judge accepts it and it overlaps
    no base span. Null and empty texts have no spans; ids pass through, null ones too;
    repeated rows give repeated results; an empty table gives no rows. No shuffle: each
    row is judged where it is read.
    """
    judge = judge or train_judge(docs, id_col, text_col)
    rows = prepared(docs, id_col, text_col).select("doc_id", "text", base_spans(F.col("text")).alias("base"),
                                                   candidates(F.col("text")).alias("c"))
    loose = F.filter("c", lambda c: ~_overlaps(F.col("base"), c))
    judged = F.filter(F.transform(loose, lambda c: F.struct(
        c.start.alias("start"), c.ord.alias("ord"), c.end.alias("end"),
        judge.accepts(features(c.value, c.left, c.right, c.ord), c.ord).alias("yes"))), lambda c: c.yes)
    added = F.transform(judged, lambda c: F.struct(c.start.alias("start"), c.ord.alias("ord"), c.end.alias("end")))
    return rows.select("doc_id", "text", "base", F.array_sort(added).alias("added"))


def redact(found: DataFrame) -> DataFrame:
    """``doc_id, text`` with every span of :func:`find_pii` replaced by its kind in brackets;
    of overlapping spans the first one counts."""
    spans = F.array_sort(F.concat("base", "added"))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    done = F.aggregate(spans, state, lambda acc, s: F.when(s.start < acc.at, acc).otherwise(F.struct(
        F.concat(acc.out, F.substring(F.col("text"), acc.at + 1, s.start - acc.at), F.element_at(names, s.ord + 1)).alias("out"),
        s.end.alias("at"))))
    return (found.select("doc_id", "text", done.alias("d"))
            .select("doc_id", F.concat(F.col("d.out"), F.expr("substring(text, d.at + 1)")).alias("text")))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s.ord + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256`` of their
    list, and ``spans``, the list of all of them."""
    found = find_pii(docs, id_col, text_col)

    def number(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s.ord == i)).cast("long")
    return found.select(
        "doc_id", *(number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"))
