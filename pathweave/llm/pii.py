"""Personal data by weak supervision, in built-in functions only: labelers vote on spans, and what they agree on trains a classifier.

Spans come from patterns.  Four of them are the base: addresses of mail, IPv4
addresses, card numbers and phone numbers, whose matches stay as they are where
they pass their test.  Others are looser (spelled-out addresses, IPv6, phone
numbers without a plus, card numbers with other separators), and give
candidates only.

Five labelers vote for or against each span, or abstain: its form and its digits
(regular expressions and sums), its issuer, network, country or top domain
(gazetteers), the words before it, and the characters around it (context).
Expectation-maximisation over the counts of vote patterns, of which there are
972 at most however large the corpus is, estimates how reliable each labeler is
for each kind; the posteriors are the soft labels of a naive Bayes classifier
over features of the span, whose sums Spark makes.  A match of a looser pattern
that the classifier is sure of, and that overlaps neither a base span nor a
candidate before it of its kind, is added; base matches that fail their test are
examples for the training, and never added.

Offsets are code points.  A text is cut by a pattern into what lies between its
matches; the lengths of those pieces, summed in order, give the offsets, so that
only lengths, short heads and some context of each match leave the text.
Patterns begin at the start of a run or where the last match ended, and are
possessive, so that no run of characters is read more often than a few times and
long texts exhaust no stack.

Defined cases: null and empty texts have no spans; repeated rows and ids are
separate documents; very long texts are searched whole.  Equal starts are
ordered by kind.  An empty table gives no rows.  Extra columns are not read.
Where no span is found nothing is trained.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm import scratch
from pathweave.llm.expressions import let

KINDS = ["email", "ip", "card", "phone"]
#: By pattern: its kind, whether it is of the base, and the expression.
PATTERNS = {
    "email": ("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("card", True, r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    "spelled": ("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({](?:dot|DOT)[\])}]) ?[A-Za-z0-9-]++)++"),
    "ip6": ("ip", False, r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "dotted": ("card", False, r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9./_])"),
    "local": ("phone", False, r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
}
#: Tight forms.
FORMS = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$|[\])}]",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.|$)){4}$|:",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
    "phone": r"^(?:\+[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}$",
}
#: Common top domains; networks of hosts; card issuers by first digits; country calling codes, or an area code.
GAZETTEERS = {
    "email": r"(?i)(?:\.|dot[\])}] ?)(?:com|org|net|edu|gov|info|io|co|eu|uk|de|fr|es|it|nl|be|at|ch|pl|pt|se|dk|no|fi|ie|us|ca|mx|br|ar|cl|au|nz|jp|cn|kr|in|ru)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|^[23][0-9A-Fa-f]{3}:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)",
    "phone": r"^\+(?:1|7|2[07]|3[0-4]|36|39|4[0134]|4[5-9]|5[1-8]|6[0-6]|8[1246]|9[0-5]|98|21[1-8]|35[1-9]|37[0-8]|38[0-9]|42[01]|97[1-7]|99[2-8])|^\(?[2-9]",
}
#: Words before a span that speak for its kind, and numbers that are none of these.
CUES = {
    "email": r"\b(?:e-?mail|mail|contact|contacto|courriel|correo|kontakt|write)\b",
    "ip": r"\b(?:ip|ipv[46]|host|server|address|from|client|servidor|serveur|adresse)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte|kreditkarte|payment)\b",
    "phone": r"\b(?:phone|tel|telephone|mobile|cell|call|fax|whatsapp|tel[eé]fono|t[eé]l[eé]phone|telefon|m[oó]vil|handy)\b",
}
AGAINST = r"\b(?:version|release|isbn|issn|doi|order|invoice|section|chapter|page|serial|sku|part|build|total|price)\b[ :#.no]*$"
LABELERS = ["form", "digits", "gazetteer", "cue", "edge"]
#: A candidate is added from this probability on.
ADD = 0.95
HEAD, BEFORE, AFTER = 80, 40, 8
EM_ROUNDS = 50


def _luhn(digits: Column) -> Column:
    """Whether a number of 12 to 19 digits passes the check of card numbers."""
    values = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda c, i: let(
        c.cast("int") * (i % 2 + 1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    passes = F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0
    return F.when(F.length(digits).between(12, 19), passes).otherwise(False)


def _hits(text: Column, name: str) -> Column:
    """Matches of a pattern in order: array<struct>, null without any."""
    kind, base, pattern = PATTERNS[name]

    def one(pieces: Column):
        def at(match: Column, i: Column) -> Column:
            def made(digits: Column) -> Column:
                n = F.length(digits)
                test = {
                    "email": F.lit(True), "card": _luhn(digits), "phone": n.between(9, 15),
                    "ip": match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"),
                }[kind]
                return F.struct(
                    F.lit(name).alias("pattern"), F.lit(kind).alias("kind"), i.alias("n"), F.length(F.get(pieces, i)).cast("bigint").alias("gap"), F.length(match).cast("bigint").alias("size"),
                    F.substring(match, 1, HEAD).alias("head"), n.alias("n_digits"), (test if base or kind == "card" else F.lit(True)).alias("passes"),
                    F.right(F.get(pieces, i), F.lit(BEFORE)).alias("before"), F.substring(F.get(pieces, i + 1), 1, AFTER).alias("after"))
            return let(F.regexp_replace(match, "[^0-9]", ""), made)
        return at

    def found(matches: Column) -> Column:
        return F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), lambda pieces: F.transform(matches, one(pieces))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _matches(docs: DataFrame, id_column: str, column: str) -> tuple[DataFrame, str]:
    """(row, id, hits) of every document, stored; the texts are read once."""
    text = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text")).select("id", F.flatten(F.array_compact(F.array(*[_hits(F.col("text"), p) for p in PATTERNS]))).alias("hits"))
    return scratch.stored(rows.withColumn("row", F.monotonically_increasing_id()), "pii-matches")


def _spans(found: DataFrame) -> DataFrame:
    """A row for each match, with start and end."""
    rows = found.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    before = Window.partitionBy("row", "pattern").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    base = F.col("passes") & F.col("pattern").isin([name for name, (_, b, _) in PATTERNS.items() if b])
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).withColumn("base", base)


def _by_kind(choose) -> Column:
    out = F.lit(None).cast("int")
    for kind in KINDS:
        out = F.when(F.col("kind") == kind, choose(kind)).otherwise(out)
    return out


def votes() -> dict[str, Column]:
    """By labeler: 1 for, -1 against, 0 abstains."""
    head, before = F.col("head"), F.lower("before")
    sign = lambda c: F.when(c, 1).otherwise(-1)
    digits = {"email": ~head.rlike(r"@-|-\.|\.-|-$"), "ip": F.col("passes"), "card": F.col("passes"), "phone": F.col("n_digits").between(9, 15)}
    plain = F.regexp_replace(head, r"[^0-9]", "")
    cue = _by_kind(lambda kind: F.when(before.rlike(AGAINST), -1).when(before.rlike(CUES[kind]), 1).otherwise(0))
    edge = F.col("before").rlike(r"[A-Za-z0-9_/=#]$") | F.col("after").rlike(r"^[A-Za-z0-9_/=]")
    return {
        "form": _by_kind(lambda kind: sign(head.rlike(FORMS[kind]))), "digits": _by_kind(lambda kind: sign(digits[kind])),
        "gazetteer": _by_kind(lambda kind: sign((plain if kind == "card" else head).rlike(GAZETTEERS[kind]))), "cue": cue, "edge": sign(~edge),
    }


def features() -> Column:
    """What the classifier sees of a span, as words "name=value" of few values."""
    place = lambda c, at: F.when(F.length(c) == 0, "none").when(c.rlike(at.format(r"[A-Za-z0-9_]")), "word").when(c.rlike(at.format(r"\s")), "space").otherwise("mark")
    values = {
        "pattern": F.col("pattern"), "passes": F.col("passes").cast("string"), "digits": F.least(F.col("n_digits"), F.lit(24)).cast("string"), "size": F.floor(F.log2(F.col("size").cast("double"))).cast("string"),
        "before": place(F.col("before"), "{}$"), "after": place(F.col("after"), "^{}"), "marks": F.least(F.length(F.regexp_replace("head", r"[A-Za-z0-9]", "")), F.lit(8)).cast("string"),
        "first": F.substring(F.regexp_replace("head", r"[^0-9]", ""), 1, 1),
    }
    return F.array(*[F.concat(F.lit(f"{name}="), F.coalesce(v, F.lit(""))) for name, v in values.items()])


def estimate(counts: dict[tuple[int, ...], int]) -> tuple[dict[tuple[int, ...], float], list[dict[tuple[int, int], float]]]:
    """Posterior of each vote pattern, and by labeler the chance of each (vote, truth), by expectation-maximisation from the majority's view."""
    post = {v: 1 / (1 + math.exp(-2 * sum(v))) for v in counts}
    n_labelers = len(next(iter(counts), ()))
    chances: list[dict[tuple[int, int], float]] = []
    for _ in range(EM_ROUNDS):
        truth = [1.0 + sum(n * (p if y else 1 - p) for n, p in ((counts[v], post[v]) for v in counts)) for y in (0, 1)]
        chances = [defaultdict(lambda: 0.5) for _ in range(n_labelers)]
        for v, n in counts.items():
            for own, vote in zip(chances, v, strict=True):
                own[vote, 1] += n * post[v]
                own[vote, 0] += n * (1 - post[v])
        chances = [{(vote, y): (own[vote, y]) / (truth[y] + 0.5) for vote in (-1, 0, 1) for y in (0, 1)} for own in chances]
        for v in counts:
            odds = math.log(truth[1] / truth[0]) + sum(math.log(own[x, 1] / own[x, 0]) for own, x in zip(chances, v, strict=True))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, chances


def weights(sums: list[tuple[str, float, float]], n_features: int) -> tuple[float, dict[str, float]]:
    """(bias, weight by feature) of naive Bayes from (feature, sum of posteriors, sum of their complements) of one kind."""
    yes, no = (sum(s[i] for s in sums) / n_features + 1 for i in (1, 2))
    return math.log(yes / no), {f: math.log((a + 0.5) / (yes + 1)) - math.log((b + 0.5) / (no + 1)) for f, a, b in sums}


def _scored(spans: DataFrame) -> DataFrame:
    """The spans with ``score``: labelers, posteriors, classifier."""
    spark = spans.sparkSession
    named = votes()
    voted = spans.withColumns(named)
    counts: dict[str, dict[tuple[int, ...], int]] = defaultdict(dict)
    # 243 patterns of votes a kind at most
    for r in voted.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect():
        counts[r.kind][tuple(r[x] for x in LABELERS)] = r.n
    soft = [(kind, *v, p) for kind, own in counts.items() for v, p in estimate(own)[0].items()]
    if not soft:
        return spans.withColumn("score", F.lit(None).cast("double"))
    table = spark.createDataFrame(soft, f"kind string, {', '.join(f'{x} int' for x in LABELERS)}, p double")
    labelled = voted.join(F.broadcast(table), ["kind", *LABELERS]).select("kind", "p", F.explode(features()).alias("feature"))
    # features of few values
    sums = labelled.groupBy("kind", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    n_features = len({r.feature.split("=")[0] for r in sums})
    model = [(kind, *weights([(r.feature, r.yes, r.no) for r in sums if r.kind == kind], n_features)) for kind in sorted(counts)]
    model_table = spark.createDataFrame(model, "kind string, bias double, weight map<string,double>")
    odds = F.aggregate(F.transform(features(), lambda f: F.coalesce(F.try_element_at("weight", f), F.lit(0.0))), F.col("bias"), lambda a, x: a + x)
    return spans.join(F.broadcast(model_table), "kind").withColumn("score", 1 / (1 + F.exp(-odds))).drop("bias", "weight")


def _chosen(spans: DataFrame) -> DataFrame:
    """Base spans, and sure candidates that overlap no base span and no candidate of their kind before them."""
    loose = F.col("pattern").isin([name for name, (_, base, _) in PATTERNS.items() if not base])
    near = spans.filter(F.col("base") | (loose & F.col("passes") & (F.col("score") >= ADD)))
    order, text = ["start", "end", "pattern"], Window.partitionBy("row")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  (frames that run to the end of a partition take the square of its rows)
    held = F.max(F.when(F.col("base"), F.col("end"))).over(earlier(text.orderBy(*order)))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(earlier(text.orderBy(*[F.desc(c) for c in order])))
    own = earlier(Window.partitionBy("row", "kind", "base").orderBy(*order))
    free = F.coalesce(held <= F.col("start"), F.lit(True)) & F.coalesce(ahead >= F.col("end"), F.lit(True)) & F.coalesce(F.max("end").over(own) <= F.col("start"), F.lit(True))
    return near.withColumn("free", free).filter(F.col("base") | F.col("free")).drop("free")


def find_spans(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, spans) of every document: array<struct<start, kind_no, end, kind, base, score>> by start, then kind in the order of KINDS."""
    found, path = _matches(docs, id_column, column)
    spans, spans_path = scratch.stored(_spans(found), "pii-spans")
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct("start", number.alias("kind_no"), "end", "kind", "base", "score")
    lists = _chosen(_scored(spans)).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows = found.select("row", "id").join(lists, "row", "left")
    kind = lists.schema["spans"].dataType.simpleString()
    out, _ = scratch.stored(rows.select(F.col("id").alias(id_column), F.coalesce("spans", F.array().cast(kind)).alias("spans")), "pii")
    for p in (path, spans_path):
        scratch.remove(docs.sparkSession, p)
    return out


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, text) with each found span, in order, replaced by its kind in brackets; of overlapping spans the first. Ids are unique here."""
    spans = find_spans(docs, id_column, column)
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(
        F.concat(a["out"], F.substring(F.col(f"`{column}`"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))).otherwise(a)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    text = F.aggregate("spans", zero, step, lambda a: F.concat(a["out"], F.substring(F.col(f"`{column}`"), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return docs.join(spans, id_column).select(id_column, text.alias(column))
